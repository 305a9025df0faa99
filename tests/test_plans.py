"""Plan checks: filters reach the Parquet scan, scans read only the columns used, no single-partition
exchange in ordered operators, no nested-loop joins."""

import os

from pyspark.sql import functions as F

from duocount.operators import compare as cmp
from duocount.operators import profile as PR
from duocount.plans import adapters
from duocount.operators import insertions as I
from tests.conftest import SF_SMALL

KEYS = ["seq_id", "locus_tag", "type", "gene", "start_pos", "end_pos", "feat_length", "product"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_pushed_to_parquet(spark, tmp_out):
    path = os.path.join(tmp_out, "feat")
    adapters.features(spark, SF_SMALL).write.parquet(path)
    t = spark.read.parquet(path)
    p1 = plan_of(cmp.lookup(t, "LT7"))
    assert "PushedFilters" in p1 and "EqualTo(locus_tag,LT7)" in p1
    p2 = plan_of(PR.limit_genome(t, 1000, 50000))
    assert "GreaterThanOrEqual(start_pos,1000)" in p2  # the plan text truncates the pushed list
    assert "DataFilters" in p2 and "<= 50000)" in p2


def test_scan_reads_only_used_columns(spark):
    sites = I.insertion_sites(adapters.insertions(spark, SF_SMALL))
    tot = I.feature_totals(adapters.features(spark, SF_SMALL), sites, KEYS, bin_width=1024)
    p = plan_of(tot)
    assert "l_shipdate" not in p and "l_extendedprice" not in p and "p_retailprice" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_few_groups_are_not_shuffled_whole(spark):
    """With automatic broadcasts off, no data-sized side is joined on a key of a few values alone."""
    import re

    from duocount.operators import ordered as OR

    n = spark.range(2000).selectExpr("cast(id % 2 as string) as condition", "cast(id % 7 as string) as seq_id", "id as start_pos",
                                     "id + 5 as end_pos", "cast(id as string) as locus_tag", "cast(id * 37 % 101 as double) as a",
                                     "cast(id * 11 % 97 as double) as b")
    coords = n.selectExpr("condition", "seq_id", "start_pos as start", "case when condition = '0' then '.' else '2' end as score")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {"lead": plan_of(I.score_track(n, "a")), "mode": plan_of(I.profile_from_coordinates(coords)),
                 "quantile": plan_of(OR.exact_quantiles(n, "a", {"m": 0.5}, by=["condition"], few=True)),
                 "rank": plan_of(OR.ordered_distinct(n, "a", ["condition"], few=True))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for name, p in plans.items():
        assert "BroadcastHashJoin" in p, name
        assert not re.search(r"SortMergeJoin (\(skew=\w+\) )?\[[^,\]]+\], ", p), name

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duocount import ComparisonSpec, NotAComparisonError, SchemaError
from duocount.functions.scalar import log2_fold_change, round_half_even
from duocount.operators import compare as cmp

KEYS = ["seq_id", "locus_tag", "type", "gene", "start_pos", "end_pos", "feat_length", "product"]
SCHEMA = ("seq_id string, locus_tag string, type string, gene string, start_pos long, end_pos long, "
          "feat_length long, product string, nim_score double, nrm_score double")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_null_key_join_and_one_sided(spark):
    c = table(spark, [("1", "A", "CDS", None, 1, 10, 10, None, 1.0, 2.0), ("1", "B", "CDS", "b", 20, 30, 11, "p", 3.0, 4.0),
                      ("1", "C", "CDS", "c", 40, 50, 11, "p", 5.0, 6.0)])
    t = table(spark, [("1", "A", "CDS", None, 1, 10, 10, None, 2.0, 2.0), ("1", "B", "CDS", "b", 20, 30, 11, "p", 3.0, 4.0)])
    m = cmp.merge_conditions(c, t, ComparisonSpec())
    got = {r["locus_tag"] for r in m.collect()}
    assert got == {"A", "B"}  # null gene/product match (Q1); C only in control is dropped
    assert "nim_score_control" in m.columns and "nim_score_test" in m.columns
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_missing_key_raises(spark):
    c = spark.createDataFrame([("A", 1.0)], "locus_tag string, nim_score double")
    with pytest.raises(SchemaError):
        cmp.merge_conditions(c, c, ComparisonSpec())


def test_fold_change_zero_rules(spark):
    rows = [(0.0, 5.0), (5.0, 0.0), (0.0, 0.0), (8.0, 2.0), (None, 2.0), (None, 0.0), (0.0, None), (-4.0, 2.0)]
    df = spark.createDataFrame(rows, "t double, c double")
    got = [r[0] for r in df.select(log2_fold_change("t", "c")).collect()]
    assert got == [0.0, 0.0, 0.0, 2.0, None, 0.0, None, 0.0]


def test_percentile_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", None)], "k string, x double")
    from duocount.operators.ordered import min_rank_pct
    got = {r["k"]: r["p"] for r in min_rank_pct(df, "x", "p").collect()}
    assert got == {"a": 1 / 3, "b": 1 / 3, "c": 1.0, "d": None}
    s = pd.Series([1.0, 1.0, 2.0, np.nan]).rank(method="min", pct=True)
    assert [got[k] for k in "abc"] == list(s[:3])


def test_round_half_even_matches_numpy(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(0, 100, 2000), np.arange(-50, 50) * 0.000005 + 0.123])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = np.array([r[0] for r in df.select(round_half_even("x", 5)).collect()])
    assert np.array_equal(got, np.round(xs, 5))


def _merged(spark):
    c = table(spark, [("1", f"L{i}", "CDS", None if i % 3 == 0 else f"g{i}", i * 100, i * 100 + 50, 51, "p",
                       float(i % 7), float(i)) for i in range(40)])
    t = table(spark, [("1", f"L{i}", "CDS", None if i % 3 == 0 else f"g{i}", i * 100, i * 100 + 50, 51, "p",
                       float((i * 3) % 5), float(i + 1)) for i in range(40)])
    return c, t


def test_compare_metrics_match_pandas(spark):
    c, t = _merged(spark)
    df, spec = cmp.compare(c, t, ComparisonSpec())
    pdf = df.toPandas().sort_values("locus_tag")
    assert spec.metrics == ("fold_change", "pctl_rank")

    def fc(a, b):
        try:
            return math.log(float(a) / float(b), 2)
        except (ZeroDivisionError, ValueError):
            return 0
    exp_fc = [fc(a, b) for a, b in zip(pdf.nim_score_test, pdf.nim_score_control)]
    assert np.allclose(pdf.fold_change.values, exp_fc)
    exp_pr = pdf.nim_score_test.rank(method="min", pct=True) - pdf.nim_score_control.rank(method="min", pct=True)
    assert np.allclose(pdf.pctl_rank.values, exp_pr.values)


def test_score_columns_errors_and_control_only(spark):
    c, t = _merged(spark)
    df = cmp.merge_conditions(c, t, ComparisonSpec())
    with pytest.raises(SchemaError):
        cmp.score_columns(df.withColumn("x_nim_score_test", F.lit(1.0)), ComparisonSpec())
    spec0 = ComparisonSpec(test_suffix=None)
    only = cmp.merge_conditions(c, None, spec0)
    assert only.count() == 40 and "nim_score" in only.columns
    with pytest.raises(NotAComparisonError):
        cmp.score_columns(only, spec0)


def test_pluggable_metric_with_pandas_udf(spark):
    c, t = _merged(spark)
    df, spec = cmp.compare(c, t, ComparisonSpec())

    @F.pandas_udf("double")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return a - b
    out, spec2 = cmp.add_metric(df, spec, "diff", diff)
    assert "diff" in spec2.metrics
    r = out.select((F.col("diff") - (F.col("nim_score_test") - F.col("nim_score_control"))).alias("d")).collect()
    assert all(abs(x["d"]) < 1e-12 for x in r)
    again, _ = cmp.add_metric(out, spec2, "diff", lambda a, b: F.lit(0.0))  # present: not recomputed
    assert again.columns == out.columns


def test_visible_columns_and_page(spark):
    c, t = _merged(spark)
    df, spec = cmp.compare(c, t, ComparisonSpec())
    cols = cmp.visible_columns(df, spec, simple=True)
    assert "seq_id" not in cols and cols[-2:] == ["fold_change", "pctl_rank"]
    assert cmp.visible_columns(df, spec, simple=True, metric="pctl_rank")[-1] == "pctl_rank"
    with pytest.raises(SchemaError):
        cmp.visible_columns(df, spec, metric="nope")
    p = cmp.page(df, [F.col("nim_score_test").desc()], ["locus_tag"], 1, 10).collect()
    full = df.orderBy(F.col("nim_score_test").desc(), "locus_tag").collect()
    assert [r.locus_tag for r in p] == [r.locus_tag for r in full[10:20]]


def test_zero_in_one(spark):
    c, t = _merged(spark)
    df, spec = cmp.compare(c, t, ComparisonSpec())
    pdf = cmp.flag_zero_in_one(df, spec).toPandas()
    exp = ((pdf.nim_score_control == 0) & (pdf.nim_score_test > 0)) | ((pdf.nim_score_control > 0) & (pdf.nim_score_test == 0))
    assert (pdf.zero_in_one == exp).all()


def test_row_numbers_are_dense_whole_and_by_group(spark):
    from duocount.operators.compare import add_row_number
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), "id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    rows = sorted(add_row_number(df, ["a", "id"]).collect(), key=lambda r: (r.a, r.id))
    assert [r.row_number for r in rows] == list(range(500))
    inside = {}
    for r in sorted(add_row_number(df, ["a", "id"], ["g"], "n").collect(), key=lambda r: (r.a, r.id)):
        assert r.n == inside.get(r.g, 0)
        inside[r.g] = r.n + 1
    assert set(inside) == {None, 1, 2}

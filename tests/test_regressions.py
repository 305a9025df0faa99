"""Cases that once lost, altered or misplaced rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from duocount.functions.attributes import attribute_pairs, parse_attributes, widen_attributes
from duocount.operators import insertions as I
from duocount.operators.diffexp import dispersion as D
from duocount.operators.diffexp import fit as FT
from duocount.operators.ordered import next_in_order
from duocount.sources.scores import read_scores


def rows_for_lead(kind):
    rng = random.Random(5)
    out = []
    for i in range(3000):
        start = rng.randrange(200) * (10 ** 10 if kind == "epoch" else 1)
        end = {"epoch": start + 6 * 10 ** 9 + rng.randrange(10 ** 9), "huge": rng.randrange(2 ** 60),
               "null": None if rng.random() < 0.3 else rng.randrange(10 ** 6), "fraction": rng.randrange(1000)}[kind]
        out.append(("a" if i % 3 else "b", start + (rng.random() if kind == "fraction" else 0), end, i))
    return out


@pytest.mark.parametrize("kind", ["epoch", "huge", "null", "fraction"])
def test_next_in_order_equals_a_plain_lead(spark, kind):
    start = "double" if kind == "fraction" else "long"
    df = spark.createDataFrame(rows_for_lead(kind), f"g string, s {start}, e long, i long")
    got = {(r.i): r.n for r in next_in_order(df, ["g"], ["s", "e", "i"], "i", "n", 16).collect()}
    want = {(r.i): r.n for r in df.withColumn("n", F.lead("i").over(Window.partitionBy("g").orderBy("s", "e", "i"))).collect()}
    assert got == want


def test_profile_keeps_null_groups_and_null_scores(spark):
    rows = [("control", "1", 5, "."), ("control", "1", 5, "."), ("test", "1", 7, None), (None, "1", 9, "."), ("mixed", "1", 3, "."), ("mixed", "1", 4, None)]
    got = {(r.condition, r.position, r["count"]) for r in I.profile_from_coordinates(
        spark.createDataFrame(rows, "condition string, seq_id string, start long, score string")).collect()}
    assert got == {("control", 5, 2.0), ("test", 7, None), (None, 9, 1.0), ("mixed", 3, None), ("mixed", 4, None)}


def test_totals_keep_fractions_and_features_without_bounds(spark):
    ins = spark.createDataFrame([("1", "control", 15, 2.7), ("1", "control", 16, 0.5)], "seq_id string, condition string, position long, cnt double")
    feats = spark.createDataFrame([("1", "g1", 10, 20), ("1", "g2", None, None)], "seq_id string, locus_tag string, start_pos long, end_pos long")
    got = {(r.locus_tag, r.condition): r.total_reads for r in I.feature_totals(feats, I.insertion_sites(ins), ["seq_id", "locus_tag"]).collect()}
    assert got == {("g1", "control"): pytest.approx(3.2), ("g1", "test"): 0, ("g2", "control"): 0, ("g2", "test"): 0}


def test_more_than_a_thousand_attribute_names(spark):
    df = spark.createDataFrame([(i, f"k{i}=v{i}") for i in range(1200)], "id int, attributes string").withColumn("attr_map", parse_attributes())
    wide = widen_attributes(df.select("id", "attr_map"))
    assert len(wide.columns) == 1201 and wide.where("id = 7").first()["k7"] == "v7"
    assert attribute_pairs(df, ["id"]).count() == 1200


def test_score_files_with_another_column_order_are_refused(spark, tmp_path):
    head = "seq_id,locus_tag,type,gene,start_pos,end_pos,feat_length,product"
    for name, columns, values in (("a", "nim,nrm", "1,2"), ("b", "nrm,nim", "2,1")):
        (tmp_path / f"{name}.csv").write_text(f"{head},{columns}\n1,{name},CDS,g,1,2,2,p,{values}\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_scores(spark, str(tmp_path)).collect()


def test_outliers_are_told_by_the_residual_spread(spark):
    counts = np.array([[30, 80, 45, 120, 20, 60]])
    import pandas as pd
    gw = pd.DataFrame({"entity_id": ["x"], "counts": list(counts), "baseMean": counts.mean(axis=1), "allZero": [False], "dispGeneEst": [0.9]})
    one = lambda sd: next(FT.wald_mapper([1.0] * 6, [0, 0, 0, 1, 1, 1], (0.2, 0.0), 0.25, sd)(iter([gw]))).dispersion[0]
    assert one(0.7) == pytest.approx(0.9)  # log(0.9 / 0.2) = 1.5 > 2 * 0.7
    assert one(0.8) < 0.9


def test_a_trend_that_does_not_settle_is_a_failed_fit(spark, monkeypatch):
    df = spark.createDataFrame([(False, 0.1 + 0.3 * (i % 7), 5.0 + i) for i in range(200)], "allZero boolean, dispGeneEst double, baseMean double")
    monkeypatch.setattr(D, "TREND_MAX_INNER", 1)
    assert D.fit_trend(df, 6) is None


def test_first_duplicate_decides_before_nulls_go(spark):
    from duocount.operators.diffexp import counts as DC

    df = spark.createDataFrame([("a", 1, None, 5), ("a", 2, 3, 4), ("b", 2, 9, 9), ("b", 1, 1, 2), (None, 1, 1, 1)],
                               "id string, line int, x_MP_control int, x_MP_test int")
    got = {(r.entity_id, r.sample, r.condition, r.cnt) for r in DC.long_counts_from_wide(df, "id", order=["line"]).collect()}
    # a's first row is incomplete, so a goes although its second row is whole; a null id is incomplete too
    assert got == {("b", "x_MP_control", "control", 1), ("b", "x_MP_test", "test", 2)}


def test_failing_run_leaves_its_log_row(spark):
    from duocount.operators.diffexp.run import logged_run, run_log

    df = spark.createDataFrame([("a", "s_MP_control", "control", 1.5), ("a", "s_MP_test", "test", 2.0)],
                               "entity_id string, sample string, condition string, cnt double")
    result, row = logged_run("r", df)
    assert result is None and run_log(spark, [row]).first().reason == "1 counts are negative or not integers"


def test_attached_results_are_metrics(spark):
    from duocount import ComparisonSpec
    from duocount.operators import compare as cmp
    from duocount.operators.diffexp.run import attach_results
    from duocount.schemas import DE_RESULT_COLUMNS

    genes = spark.createDataFrame([("g1", 1.0), ("g2", 2.0)], "locus_tag string, other double")
    res = spark.createDataFrame([("g1", *[0.5] * 6)], "entity_id string, " + ", ".join(f"{c} double" for c in DE_RESULT_COLUMNS))
    df, spec = attach_results(genes, res, "locus_tag", ComparisonSpec())
    for c in DE_RESULT_COLUMNS:
        shown = cmp.visible_columns(df, spec, metric=f"de_{c}")
        assert f"de_{c}" in shown and sum(x.startswith("de_") for x in shown) == 1
    assert {r.locus_tag: r.de_pvalue for r in df.collect()} == {"g1": 0.5, "g2": None}


def test_gene_blocks_do_not_change_rows():
    import pandas as pd

    from duocount.operators.diffexp import nbmath as M

    whole = pd.DataFrame({"x": range(1000)})
    parts = list(M.gene_blocks([whole, whole.iloc[:0]], M.BLOCK_VALUES // (M.COARSE * 300)))
    assert max(map(len, parts)) == 300 and len(parts[-1]) == 0
    assert pd.concat(parts).x.tolist() == list(range(1000))

import numpy as np
import pytest
from pyspark.sql import functions as F

from duocount import ComparisonSpec
from duocount.operators import profile as PR
from duocount.operators import sets as S

SCH = ("locus_tag string, nim_score_control double, first_insert_pct_control double, last_insert_pct_control double, "
       "nim_score_test double, first_insert_pct_test double, last_insert_pct_test double")


def sets_df(spark):
    return spark.createDataFrame([
        ("both", 0.0, 1.0, 50.0, 0.0, 2.0, 60.0),
        ("c_only", 0.0, 1.0, 50.0, 9.0, 2.0, 60.0),
        ("t_only", 9.0, 1.0, 50.0, 0.0, 2.0, 60.0),
        ("none", 9.0, 1.0, 50.0, 9.0, 2.0, 60.0),
        ("nan", float("nan"), 1.0, 50.0, None, 2.0, 60.0),
    ], SCH).withColumn("nim_score_control", F.when(F.isnan("nim_score_control"), None).otherwise(F.col("nim_score_control")))


def test_regions_and_counts(spark):
    spec = ComparisonSpec()
    df = S.add_set_membership(sets_df(spark), spec, threshold=0.0, pct_range=(0, 100))
    lab = {r.locus_tag: r.set_label for r in df.collect()}
    assert lab == {"both": "AB", "c_only": "Ab", "t_only": "aB", "none": None, "nan": None}
    c = S.venn_counts(df).first()
    assert (c.only_control, c.only_test, c.both) == (1, 1, 1)
    assert S.filter_region(df, "Ab").count() == 1


def test_sweep_equals_per_threshold(spark):
    rng = np.random.default_rng(2)
    rows = [(f"L{i}", float(a), float(f), float(f + l), float(b), float(g), float(g + m)) for i, (a, b, f, g, l, m) in
            enumerate(zip(rng.integers(0, 20, 400), rng.integers(0, 20, 400), rng.integers(0, 30, 400),
                          rng.integers(0, 30, 400), rng.integers(0, 70, 400), rng.integers(0, 70, 400)))]
    df = spark.createDataFrame(rows, SCH)
    spec = ComparisonSpec()
    ts = [0, 3, 5.5, 10, 19]
    sweep = {r.threshold: (r.only_control, r.only_test, r.both) for r in S.threshold_sweep(df, spec, ts, (5, 90)).collect()}
    for t in ts:
        c = S.venn_counts(S.add_set_membership(df, spec, t, (5, 90))).first()
        assert sweep[float(t)] == (c.only_control, c.only_test, c.both)


def test_truncation_and_set_ops(spark):
    spec = ComparisonSpec()
    f = S.add_truncation_flags(sets_df(spark), spec).where("locus_tag = 'both'").first()
    assert not f.control_last_lt10 and not f.test_first_gt90
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "id string")
    b = spark.createDataFrame([("y",), ("z",)], "id string")
    assert [r.id for r in S.set_difference(a, b).collect()] == ["x"]
    assert [r.id for r in S.set_intersection(a, b).collect()] == ["y"]


def _sides(spark, c, t):
    return (spark.createDataFrame([(float(x),) for x in c], "v double"),
            spark.createDataFrame([(float(x),) for x in t], "v double"))


def test_fixed_histogram_empty_bins(spark):
    c, t = _sides(spark, [0.0, 3.0], [0.0, 3.0])
    h = {(r.condition, r.bin): r["count"] for r in PR.paired_histogram(c, t, "v", 1.0).collect()}
    assert [h[("control", i)] for i in range(3)] == [1, 0, 1]


def test_fixed_and_auto_histograms_match_numpy(spark):
    rng = np.random.default_rng(4)
    cv, tv = rng.gamma(2.0, 30.0, 700), rng.gamma(2.5, 25.0, 900)
    c, t = _sides(spark, cv, tv)
    w = 25.0
    edges = np.arange(0, max(cv.max(), tv.max()) + w, w)
    hf = PR.paired_histogram(c, t, "v", w).toPandas()
    for name, vals in (("control", cv), ("test", tv)):
        got = hf[hf.condition == name].sort_values("bin")["count"].to_numpy()
        assert np.array_equal(got, np.histogram(vals, bins=edges)[0])
    has = PR.paired_histogram(c, t, "v", None, "test")
    ha = has.toPandas()
    et = np.histogram(tv, bins="auto")[1]
    for name, vals in (("control", cv), ("test", tv)):
        got = ha[ha.condition == name].sort_values("bin")["count"].to_numpy()
        assert np.array_equal(got, np.histogram(vals, bins=et)[0])
    yr = PR.histogram_y_range(has).first()
    assert yr.y_max == ha["count"].max()


def test_grouped_histogram_ranges_rings(spark):
    df = spark.createDataFrame([("control", 0.5), ("control", 2.5), ("test", 2.0), ("test", -1.0)], "condition string, v double")
    g = {(r.condition, r.bin): r["count"] for r in PR.grouped_histogram(df, "v", 2.0).collect()}
    assert g == {("control", 0): 1, ("control", 1): 1, ("test", 1): 1}
    genes = spark.createDataFrame([("1", 0, 10, "A", 0.0, 0.0, 1.0), ("1", 20, 30, "B", 1.0, 0.0, 2.0),
                                   ("1", 90, 100, "C", 3.0, 4.0, 5.0)],
                                  "seq_id string, start_pos long, end_pos long, locus_tag string, c double, t double, m double")
    r = PR.genome_range(genes).first()
    assert (r.genome_range, r.ring_length) == (100, 90)
    rings = PR.ring_tables(genes, "c", "t", "m", (0.0, 0.5), hide_zeros=True).collect()
    assert [x.locus_tag for x in rings] == ["B"]
    assert PR.window_bounds(100, (0.15, 0.55)) == (15, 55)

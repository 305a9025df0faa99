import numpy as np
from pyspark.sql import functions as F

from duocount.operators import insertions as I
from duocount.operators.intervals import MAX_BINS, bin_levels, in_interval, interval_join

KEYS = ["seq_id", "locus_tag", "type", "gene", "start_pos", "end_pos", "feat_length", "product"]
FEAT = ("seq_id string, locus_tag string, type string, gene string, start_pos long, end_pos long, "
        "feat_length long, product string")


def interval_join_naive(points, intervals, *, pos, lo, hi, on=(), bounds="open"):
    """Plain theta join (a nested loop), to hold the binned one against."""
    i, p = intervals.alias("_i"), points.alias("_p")
    cond = [F.col(f"_i.{k}") == F.col(f"_p.{k}") for k in on]
    cond.append(in_interval(F.col(f"_p.{pos}"), F.col(f"_i.{lo}"), F.col(f"_i.{hi}"), bounds))
    return i.join(p, cond, "inner").select("_i.*", *[F.col(f"_p.{c}") for c in points.columns if c not in on])


def test_binned_equals_naive_random(spark):
    rng = np.random.default_rng(11)
    iv = [(f"s{int(s)}", int(a), int(a) + int(l)) for s, a, l in
          zip(rng.integers(0, 2, 300), rng.integers(0, 100000, 300), rng.integers(0, 3000, 300))]
    pts = [(f"s{int(s)}", int(p)) for s, p in zip(rng.integers(0, 2, 4000), rng.integers(0, 103000, 4000))]
    I_ = spark.createDataFrame(iv, "seq string, lo long, hi long").withColumn("iid", F.monotonically_increasing_id())
    P_ = spark.createDataFrame(pts, "seq string, pos long").withColumn("pid", F.monotonically_increasing_id())
    for bounds in ("open", "closed"):
        for w in (64, 1024, None):
            a = interval_join(P_, I_, pos="pos", lo="lo", hi="hi", on=["seq"], bounds=bounds, bin_width=w)
            b = interval_join_naive(P_, I_, pos="pos", lo="lo", hi="hi", on=["seq"], bounds=bounds)
            ka = sorted((r.iid, r.pid) for r in a.select("iid", "pid").collect())
            kb = sorted((r.iid, r.pid) for r in b.select("iid", "pid").collect())
            assert ka == kb
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_features_take_wide_bins(spark):
    """A feature over the whole sequence beside short ones, reversed and boundless ones: few rows each, same pairs."""
    rng = np.random.default_rng(12)
    iv = [("s", int(a), int(a) + 19) for a in rng.integers(0, 50_000_000, 400)]
    iv += [("s", 0, 50_000_000), ("s", -7, 2_000_000), ("s", 30_000_000, 30_090_000), ("s", 900, 5), ("s", None, 40), ("s", 40, None),
           ("t", 0, 3_000_000_000_000), ("s", 17, 17)]
    pts = [("s", int(a) + int(d)) for (_, a, _), d in zip(iv[:300], rng.integers(-1, 21, 300))]
    pts += [("s", int(p)) for p in rng.integers(-10, 50_000_010, 500)] + [("t", 2_999_999_999_999), ("s", 17), ("s", None)]
    I_ = spark.createDataFrame([(k, *r) for k, r in enumerate(iv)], "iid int, seq string, lo long, hi long")
    P_ = spark.createDataFrame([(k, *r) for k, r in enumerate(pts)], "pid int, seq string, pos long")
    base, levels = bin_levels(I_, "lo", "hi")
    assert base == 5 and len(levels) <= 5
    for bounds in ("open", "closed"):
        of = dict(pos="pos", lo="lo", hi="hi", on=["seq"], bounds=bounds)
        want = sorted((r.iid, r.pid) for r in interval_join_naive(P_, I_, **of).collect())
        assert sorted((r.iid, r.pid) for r in interval_join(P_, I_, **of).collect()) == want
        left = interval_join(P_, I_, how="left", **of).collect()
        assert sorted((r.iid, r.pid) for r in left if r.pid is not None) == want
        assert {r.iid for r in left} == set(range(len(iv)))
        assert len(left) - len(want) <= len(iv) * (MAX_BINS + 1)


def test_base_width_is_the_quantile_of_spans(spark):
    I_ = spark.createDataFrame([(0, n - 1) for n in [1, 1, 16, 17, 32, 33, 33, 64, 64, 5000]], "lo long, hi long")
    assert bin_levels(I_, "lo", "hi") == (6, [0, 1]) and bin_levels(I_, "lo", "hi", quantile=0.2) == (0, [0, 1, 2])
    assert bin_levels(I_, "lo", "hi", bin_width=8192) == (13, [0])
    assert bin_levels(I_.limit(0), "lo", "hi") == (0, [0])


def _feat(spark, rows):
    return spark.createDataFrame(rows, FEAT)


def test_boundary_hits_open_and_closed(spark):
    feat = _feat(spark, [("1", "G", "CDS", "g", 100, 200, 101, "p")])
    ins = spark.createDataFrame([("1", "control", 100, 1), ("1", "control", 101, 1), ("1", "control", 200, 1)],
                                "seq_id string, condition string, position long, cnt long")
    sites = I.insertion_sites(ins)
    op = I.feature_totals(feat, sites, KEYS, conditions=("control",)).first()
    cl = I.feature_totals(feat, sites, KEYS, conditions=("control",), bounds="closed").first()
    assert (op.n_rows, op.first_pos, op.last_pos) == (1, 101, 101)
    assert (cl.n_rows, cl.first_pos, cl.last_pos) == (3, 100, 200)


def test_two_sequences_kept_apart_and_zero_genes(spark):
    feat = _feat(spark, [("1", "A", "CDS", None, 10, 50, 41, None), ("2", "B", "CDS", "b", 10, 50, 41, "p"),
                         ("2", "C", "CDS", "c", 1000, 1100, 101, "p")])
    ins = spark.createDataFrame([("1", "control", 20, 3), ("2", "control", 20, 4), ("2", "test", 30, 5)],
                                "seq_id string, condition string, position long, cnt long")
    t = {(r.locus_tag, r.condition): (r.total_reads, r.n_rows) for r in
         I.feature_totals(feat, I.insertion_sites(ins), KEYS).collect()}
    assert t[("A", "control")] == (3, 1) and t[("B", "control")] == (4, 1) and t[("B", "test")] == (5, 1)
    assert t[("A", "test")] == (0, 0) and t[("C", "control")] == (0, 0) and len(t) == 6


def test_gene_scores_formula(spark):
    feat = _feat(spark, [("1", "A", "CDS", "a", 1, 2000, 2000, "p"), ("1", "B", "CDS", "b", 5001, 6000, 1000, "p")])
    ins = spark.createDataFrame([("1", "control", 10, 5), ("1", "control", 10, 1), ("1", "control", 20, 2),
                                 ("1", "control", 5500, 2), ("1", "control", 9000, 10)],
                                "seq_id string, condition string, position long, cnt long")
    s = {r.locus_tag: r for r in I.gene_scores(feat, ins, KEYS, conditions=("control",)).collect()}
    # 4 distinct sites in the condition, 20 reads in total
    assert s["A"].unique_sites == 2 and s["A"].n_rows == 3 and s["A"].total_reads == 8
    assert abs(s["A"].nim_score - (2 / 2.0) / (4 / 1e6)) < 1e-6
    assert abs(s["A"].nrm_score - (8 / 2.0) / (20 / 1e6)) < 1e-6
    assert abs(s["B"].first_insert_pct - 100 * (5500 - 5001) / 1000) < 1e-9


def test_profile_modes_and_dedupe(spark):
    coords = spark.createDataFrame([
        ("control", "1", 5, "."), ("control", "1", 5, "."), ("control", "2", 5, "."),
        ("test", "1", 7, "3"), ("test", "1", 7, "4")], "condition string, seq_id string, start long, score string")
    prof = {(r.condition, r.seq_id, r.position, r["count"]) for r in I.profile_from_coordinates(coords).collect()}
    assert ("control", "1", 5, 2.0) in prof and ("control", "2", 5, 1.0) in prof
    assert len([p for p in prof if p[0] == "test"]) == 2  # repeated position kept (Q11)
    summed = I.profile_from_coordinates(coords, dedupe="sum").where("condition = 'test'").collect()
    assert len(summed) == 1 and summed[0]["count"] == 7.0
    ign = I.profile_from_coordinates(coords, ignore_seq=True).where("condition = 'control'").collect()
    assert len(ign) == 1 and ign[0]["count"] == 3.0  # seq ignored (Q10 reproduced)


def test_score_track_gaps(spark):
    g = spark.createDataFrame([("1", 10, 20, "A", 5.0), ("1", 30, 40, "B", 7.0)],
                              "seq_id string, start_pos long, end_pos long, locus_tag string, nim_score double")
    got = sorted((r.seg_start, r.seg_end, r.value) for r in I.score_track(g, "nim_score").collect())
    assert got == [(10, 20, 5.0), (20, 30, 0.0), (30, 40, 7.0)]


def test_window_table_and_align(spark):
    feat = _feat(spark, [("1", "A", "CDS", "a", 10, 100, 91, "p")])
    ins = spark.createDataFrame([("1", "control", 20, 3), ("1", "test", 20, 1), ("1", "test", 50, 2)],
                                "seq_id string, condition string, position long, cnt long")
    w = {r.position: (r.control_count, r.test_count, r.within_cds) for r in
         I.gene_window_table(feat, I.insertion_sites(ins), KEYS).collect()}
    assert w == {20: (3.0, 1.0, True), 50: (0.0, 2.0, True)}
    c = spark.createDataFrame([("1", 1, 2.0)], "seq_id string, position long, count double")
    t = spark.createDataFrame([("1", 2, 5.0)], "seq_id string, position long, count double")
    a = sorted(tuple(r) for r in I.align_profiles(c, t).collect())
    assert a == [("1", 1, 2.0, 0.0), ("1", 2, 0.0, 5.0)]
    st = I.stack_conditions(c, t)
    assert sorted(r.group for r in st.select("group").distinct().collect()) == ["Control", "Test"]


def test_strand_aware_percentiles(spark):
    feat = spark.createDataFrame([("1", "P", "CDS", "p", 1001, 2000, 1000, "x", "+"), ("1", "M", "CDS", "m", 3001, 4000, 1000, "x", "-")],
                                 FEAT + ", strand string")
    ins = spark.createDataFrame([("1", "control", 1101, 1), ("1", "control", 1901, 1),
                                 ("1", "control", 3101, 1), ("1", "control", 3901, 1)],
                                "seq_id string, condition string, position long, cnt long")
    plain = {r.locus_tag: (r.first_insert_pct, r.last_insert_pct)
             for r in I.gene_scores(feat, ins, KEYS, conditions=("control",)).collect()}
    aware = {r.locus_tag: (r.first_insert_pct, r.last_insert_pct)
             for r in I.gene_scores(feat, ins, KEYS, conditions=("control",), strand_col="strand").collect()}
    assert plain["M"] == (10.0, 90.0) and aware["M"] == (9.9, 89.9) and aware["P"] == plain["P"] == (10.0, 90.0)

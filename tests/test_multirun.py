"""Many experiments in one job: results per run equal the single-run results."""

from pyspark.sql import functions as F

from duocount import ComparisonSpec
from duocount.operators import compare as cmp
from duocount.operators import insertions as I
from duocount.operators import sets as S
from duocount.plans import adapters, views

KEYS = ["seq_id", "locus_tag", "type", "gene", "start_pos", "end_pos", "feat_length", "product"]
SF = "/root/testdata/sf0.001"


def _runs(spark):
    feat = adapters.features(spark, SF)
    ins = adapters.insertions(spark, SF)
    feats = feat.withColumn("run_id", F.lit("a")).unionByName(feat.withColumn("run_id", F.lit("b")))
    ins_b = ins.where(F.col("position") % 3 != 0)  # run b: a different insertion set
    inss = ins.withColumn("run_id", F.lit("a")).unionByName(ins_b.withColumn("run_id", F.lit("b")))
    return feat, ins, ins_b, feats, inss


def test_multi_run_scores_and_metrics(spark):
    feat, ins, ins_b, feats, inss = _runs(spark)
    spec = ComparisonSpec(run_cols=("run_id",))
    multi = I.gene_scores(feats, inss, KEYS, by=["run_id"], bin_width=256)
    c = multi.where("condition = 'control'").drop("condition")
    t = multi.where("condition = 'test'").drop("condition")
    merged, spec = cmp.compare(c, t, spec)
    got = {(r.run_id, r.locus_tag): (r.nim_score_control, r.fold_change, r.pctl_rank) for r in merged.collect()}
    for run, i in (("a", ins), ("b", ins_b)):
        single = I.gene_scores(feat, i, KEYS, bin_width=256)
        m1, _ = cmp.compare(single.where("condition = 'control'").drop("condition"),
                            single.where("condition = 'test'").drop("condition"), ComparisonSpec())
        for r in m1.collect():
            g = got[(run, r.locus_tag)]
            assert abs(g[0] - r.nim_score_control) < 1e-9 and abs(g[1] - r.fold_change) < 1e-9
            assert abs(g[2] - r.pctl_rank) < 1e-12
    counts = S.venn_counts(S.add_set_membership(merged, spec), by=["run_id"]).collect()
    assert {r.run_id for r in counts} == {"a", "b"}
    sweep = S.threshold_sweep(merged, spec, [0, 100, 1000], by=["run_id"]).collect()
    assert len(sweep) == 6


def test_gene_viewer_view(spark):
    feat, ins, *_ = _runs(spark)
    wide, totals = views.gene_viewer(feat, ins, KEYS)
    one = views.one_gene(wide, "LT7").collect()
    tot = totals.where("locus_tag = 'LT7' and condition = 'control'").first()
    assert sum(r.control_count for r in one if r.within_cds) == tot.total_reads
    assert tot.label.startswith("LT7")

"""Composed plans: the questions a user of the reference answers, each one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duocount.operators import compare as cmp
from duocount.operators import insertions as ins_ops
from duocount.plans import adapters
from duocount.session import cut_lineage
from duocount.spec import FEATURE_KEYS, ComparisonSpec

SPEC = ComparisonSpec()


def score_tables(spark: SparkSession, sf_dir: str, bin_width=None, materialise: bool = True) -> DataFrame:
    """Per-gene score table, long form (J04 -> A04 -> C04/C05).

    Materialised in the checkpoint folder by default: it is one row per gene and condition (small
    next to the insertions it summarises), it is read twice by every comparison (control and test
    side), and cutting the lineage here keeps later plans from re-running the interval join.
    """
    feat = adapters.features(spark, sf_dir)
    ins = adapters.insertions(spark, sf_dir)
    scores = ins_ops.gene_scores(feat, ins, FEATURE_KEYS, bin_width=bin_width, materialise_sites=materialise)
    return cut_lineage(scores) if materialise else scores


def condition_table(scores: DataFrame, condition: str) -> DataFrame:
    return scores.where(F.col("condition") == condition).drop("condition")


def comparison(spark: SparkSession, sf_dir: str, bin_width=None, materialise: bool = False):
    """Merged comparison: control and test score tables joined null-safely, with fold change and
    percentile-rank difference. Returns ``(df, spec)``.

    The merged table (one row per gene) is written once before ranking, so the rank's cut-point
    pass and its main pass both read it instead of re-running the merge. ``materialise`` also writes
    the ranked result, for callers that stack further ordered operators on it.
    """
    scores = score_tables(spark, sf_dir, bin_width)
    merged = cmp.merge_conditions(condition_table(scores, "control"), condition_table(scores, "test"), SPEC)
    merged, spec = cmp.add_fold_change(merged, SPEC)
    df, spec = cmp.add_pctl_rank_diff(cut_lineage(merged, "merged"), spec)
    return (cut_lineage(df, "compared") if materialise else df), spec


def top_changes(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """Which genes change most between control and test?."""
    df, spec = comparison(spark, sf_dir)
    cols = cmp.visible_columns(df, spec, simple=True)
    view = cmp.round_numeric(df.select(*cols), 5)
    return view.orderBy(F.abs(F.col("fold_change")).desc(), F.col("locus_tag")).limit(k)

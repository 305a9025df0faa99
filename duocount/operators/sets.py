"""Threshold sets and Venn regions (F08, F09, F11, U01-U04, A07, threshold sweep).

Sets are never materialised as id lists: membership is a boolean column on the entity row and
region sizes are one aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duocount.functions.scalar import round_half_even, set_label, truncated_first, truncated_last
from duocount.operators.compare import condition_columns, score_columns
from duocount.operators.ordered import count_below
from duocount.spec import ComparisonSpec, SchemaError


def percentile_columns(df: DataFrame, spec: ComparisonSpec) -> tuple:
    """(first, last) percentile columns per condition, found by substring: ((t_first, t_last), (c_first, c_last))."""
    spec.require_comparison()
    t = condition_columns(df, spec.test_suffix, spec.pct_marker)
    c = condition_columns(df, spec.control_suffix, spec.pct_marker)
    if len(t) != 2 or len(c) != 2:
        raise SchemaError(f"expected two {spec.pct_marker!r} columns per condition, found test={t} control={c}")
    return (t[0], t[1]), (c[0], c[1])


def _member(score: Column, first: Column, last: Column, threshold: float, lo: float, hi: float,
            rounded: bool) -> Column:
    if rounded:  # thresholds compare the values as shown, rounded to 5 places (rule Q5)
        score, first, last = (round_half_even(x, 5) for x in (score, first, last))
    return F.coalesce((score <= F.lit(float(threshold))) & (first >= F.lit(float(lo))) & (last <= F.lit(float(hi))),
                      F.lit(False))


def add_set_membership(df: DataFrame, spec: ComparisonSpec, threshold: float = 0.0,
                       pct_range: Sequence[float] = (0.0, 100.0), rounded: bool = True) -> DataFrame:
    """Membership per condition and region label (F08, U02). A null score or percentile is in no set (Q6)."""
    nim_t, nim_c = score_columns(df, spec)
    (tf, tl), (cf, cl) = percentile_columns(df, spec)
    lo, hi = pct_range
    return (df.withColumn("in_control_set", _member(F.col(nim_c), F.col(cf), F.col(cl), threshold, lo, hi, rounded))
            .withColumn("in_test_set", _member(F.col(nim_t), F.col(tf), F.col(tl), threshold, lo, hi, rounded))
            .withColumn("set_label", set_label("in_control_set", "in_test_set")))


def filter_region(df: DataFrame, region: str = "all") -> DataFrame:
    """Keep one Venn region (AB, Ab, aB) or all."""
    if region == "all":
        return df
    if region not in ("AB", "Ab", "aB"):
        raise ValueError(f"unknown region {region!r}")
    return df.where(F.col("set_label") == region)


def venn_counts(df: DataFrame, by: Sequence[str] = (), a: str = "in_control_set", b: str = "in_test_set") -> DataFrame:
    """Region sizes only-A, only-B, both in one pass."""
    ca, cb = F.col(a), F.col(b)
    return df.groupBy(*by).agg(
        F.count_if(ca & ~cb).alias("only_control"),
        F.count_if(cb & ~ca).alias("only_test"),
        F.count_if(ca & cb).alias("both"))


def threshold_sweep(df: DataFrame, spec: ComparisonSpec, thresholds: Sequence[float],
                    pct_range: Sequence[float] = (0.0, 100.0), rounded: bool = True,
                    by: Sequence[str] = ()) -> DataFrame:
    """Venn region sizes for every score threshold in one job.

    A row enters a condition's set at the first threshold >= its score (if its percentiles pass), so
    each row is reduced to the pair (k_control, k_test) of entry indices; one grouped count gives at
    most (T+1)^2 cells, which are expanded over the T thresholds. No row is multiplied by T and no
    join is needed.
    """
    ts = sorted(float(t) for t in thresholds)
    T_ = len(ts)
    arr = F.array(*[F.lit(t) for t in ts])
    nim_t, nim_c = score_columns(df, spec)
    (tf, tl), (cf, cl) = percentile_columns(df, spec)
    lo, hi = pct_range

    def entry(score, first, last):
        s, f, l_ = (round_half_even(F.col(x), 5) if rounded else F.col(x) for x in (score, first, last))
        ok = F.coalesce((f >= F.lit(float(lo))) & (l_ <= F.lit(float(hi))) & s.isNotNull(), F.lit(False))
        return F.when(ok, count_below(ts, f"_s_{score}")).otherwise(F.lit(T_))

    shown = df.select(*by, *[(round_half_even(F.col(x), 5) if rounded else F.col(x)).alias(f"_s_{x}")
                             for x in (nim_c, nim_t)], nim_c, nim_t, cf, cl, tf, tl)
    cells = (shown.select(*by, entry(nim_c, cf, cl).alias("kc"), entry(nim_t, tf, tl).alias("kt"))
             .groupBy(*by, "kc", "kt").agg(F.count(F.lit(1)).alias("n")))
    k = F.col("k")
    per = (cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(T_ - 1))))
           .groupBy(*by, "k").agg(
               F.coalesce(F.sum(F.when((F.col("kc") <= k) & (F.col("kt") > k), F.col("n"))), F.lit(0)).alias("only_control"),
               F.coalesce(F.sum(F.when((F.col("kt") <= k) & (F.col("kc") > k), F.col("n"))), F.lit(0)).alias("only_test"),
               F.coalesce(F.sum(F.when((F.col("kc") <= k) & (F.col("kt") <= k), F.col("n"))), F.lit(0)).alias("both")))
    return per.select(*by, F.element_at(arr, k + 1).alias("threshold"), "only_control", "only_test", "both")


def add_truncation_flags(df: DataFrame, spec: ComparisonSpec) -> DataFrame:
    """Genes whose insertions stop early or start late, per condition."""
    (tf, tl), (cf, cl) = percentile_columns(df, spec)
    return (df.withColumn("control_last_lt10", truncated_last(cl))
            .withColumn("test_last_lt10", truncated_last(tl))
            .withColumn("control_first_gt90", truncated_first(cf))
            .withColumn("test_first_gt90", truncated_first(tf)))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in ``a`` and not in ``b``, as a set (U01): distinct semantics like Python sets."""
    return a.subtract(b)


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def distinct_groups(df: DataFrame, col: str = "group") -> DataFrame:
    """Groups present."""
    return df.select(col).distinct()

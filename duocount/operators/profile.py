"""Distributions and genome layouts: histograms (A08-A11), ranges (A06), rings.

Bin edges are a handful of numbers computed in one aggregate pass and reach the driver as literals;
the per-row work (bin assignment, counting) stays in the plan.
"""

from __future__ import annotations

import math
from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.functions.scalar import fraction_bound
from duocount.operators.ordered import exact_quantiles


def genome_range(df: DataFrame, by: Sequence[str] = (), start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """``max(end) - min(start)`` and ring length ``max(start) - min(start)``."""
    return df.groupBy(*by).agg((F.max(end) - F.min(start)).alias("genome_range"),
                               (F.max(start) - F.min(start)).alias("ring_length"))


def _two_sides(control: DataFrame, test: DataFrame, value: str) -> DataFrame:
    return (control.select(F.lit("control").alias("condition"), F.col(value).cast("double").alias("x"))
            .unionByName(test.select(F.lit("test").alias("condition"), F.col(value).cast("double").alias("x")))
            .where(F.col("x").isNotNull() & ~F.isnan("x")))


def _bin_counts(sides: DataFrame, first: float, width: float, n_bins: int, top: float) -> DataFrame:
    """Right-open bins ``[first + i*w, first + (i+1)*w)``, the last one closed; outside values dropped.

    The bin index from ``floor((x - first) / w)`` is corrected against the edges themselves, so a value
    lying on an edge lands where a search over the edge array would put it.
    """
    x = F.col("x")
    b = F.floor((x - F.lit(first)) / F.lit(width)).cast("bigint")
    edge = lambda i: F.lit(first) + i.cast("double") * F.lit(width)
    b = F.when(x < edge(b), b - 1).otherwise(b)
    b = F.when(x >= edge(b + 1), b + 1).otherwise(b)
    top = F.lit(float(top))
    b = F.when(x >= edge(F.lit(n_bins - 1)), F.lit(n_bins - 1)).otherwise(b)
    counted = (sides.where((x >= F.lit(first)) & (x <= top))
               .select("condition", b.alias("bin"))
               .groupBy("condition", "bin").agg(F.count(F.lit(1)).alias("count")))
    return counted


def _emit(counts: DataFrame, first: float, width: float, n_bins: int) -> DataFrame:
    """Every (condition, bin), zero for empty bins: the grid is a small generated table (n_bins x 2)."""
    spark = counts.sparkSession
    grid = (spark.range(0, n_bins).select(F.col("id").alias("bin"))
            .withColumn("condition", F.explode(F.array(F.lit("control"), F.lit("test")))))
    return (grid.join(counts, ["condition", "bin"], "left")
            .select("condition", "bin",
                    (F.lit(first) + F.col("bin").cast("double") * F.lit(width)).alias("bin_lo"),
                    (F.lit(first) + (F.col("bin") + 1).cast("double") * F.lit(width)).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def paired_histogram(control: DataFrame, test: DataFrame, value: str, bin_size: Optional[float] = None,
                     edges_from: str = "test") -> DataFrame:
    """Control and test histograms on common edges.

    Fixed width: edges ``0, w, 2w, ...`` up to the first edge past the larger maximum of the two sides.
    Automatic (``bin_size=None``): numpy's ``auto`` rule (the narrower of Freedman-Diaconis and
    Sturges) on the values of ``edges_from`` ("test", as the reference, rule Q16, or "both"); values
    outside the edges are dropped.
    """
    sides = _two_sides(control, test, value)
    if bin_size is not None:
        w = float(bin_size)
        mx = sides.agg(F.max("x")).first()[0]
        if mx is None:
            mx = 0.0
        n_edges = max(1, int(math.ceil((mx + w) / w)))
        n_bins = max(1, n_edges - 1)
        return _emit(_bin_counts(sides, 0.0, w, n_bins, n_bins * w), 0.0, w, n_bins)
    src = sides if edges_from == "both" else sides.where(F.col("condition") == edges_from)
    st = src.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    q = exact_quantiles(src, "x", {"q25": 0.25, "q75": 0.75}).first()
    first, last, n = st["lo"], st["hi"], st["n"]
    if not n:
        raise ValueError("no values to bin")
    first, last, width, n_bins = auto_edges(n, first, last, q["q25"], q["q75"])
    return _emit(_bin_counts(sides, first, width, n_bins, last), first, width, n_bins)


def auto_edges(n: int, lo: float, hi: float, q25: float, q75: float):
    """numpy ``histogram_bin_edges(bins='auto')`` from n, min, max and the quartiles."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
        return lo, hi, (hi - lo), 1
    ptp = hi - lo
    sturges = ptp / (math.log2(n) + 1.0)
    fd = 2.0 * (q75 - q25) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd else sturges
    n_bins = max(1, int(math.ceil(ptp / width))) if width else 1
    return lo, hi, ptp / n_bins, n_bins


def histogram_y_range(hist: DataFrame) -> DataFrame:
    """Common y-range of two histograms: max and min bin count (A10)."""
    return hist.agg(F.max("count").alias("y_max"), F.min("count").alias("y_min"))


def grouped_histogram(df: DataFrame, value: str, bin_size: float, group: str = "condition") -> DataFrame:
    """Bars of width ``w`` from 0 with no upper end, per group (A11); values below 0 are dropped."""
    w = float(bin_size)
    x = F.col(value).cast("double")
    return (df.where(x >= 0).select(group, F.floor(x / F.lit(w)).cast("bigint").alias("bin"))
            .groupBy(group, "bin").agg(F.count(F.lit(1)).alias("count"))
            .select(group, "bin", (F.col("bin") * F.lit(w)).alias("bin_lo"), "count"))


def limit_genome(df: DataFrame, start: int, end: int, s: str = "start_pos", e: str = "end_pos") -> DataFrame:
    """Intervals fully inside ``[start, end]`` (F06); pushed to the scan when columns come from Parquet."""
    return df.where((F.col(s) >= F.lit(start)) & (F.col(e) <= F.lit(end)))


def not_both_zero(a: str, b: str):
    """Predicate keeping rows where not both values are 0 (F07); a null counts as not zero."""
    return ~F.coalesce((F.col(a) == 0) & (F.col(b) == 0), F.lit(False))


def window_bounds(genome_span: int, fractions: Sequence[float]) -> tuple:
    """Integer window from two fractions of the genome range, truncated (C06, rule Q18)."""
    f0, f1 = fractions
    return int(f0 * genome_span), int(f1 * genome_span)


def ring_tables(df: DataFrame, control_value: str, test_value: str, metric: str,
                fractions: Sequence[float] = (0.0, 1.0), hide_zeros: bool = False,
                by: Sequence[str] = ()) -> DataFrame:
    """Three ring layouts on one row per feature.

    ``block_id`` (sequence as text), ``start_pos``, ``end_pos``, ``locus_tag``, ``inner`` (control),
    ``outer`` (test), ``hist`` (metric). The window is ``int(f * (max end - min start))`` per group,
    not shifted by the first start; computed in-plan from a per-group range joined on the group keys.
    """
    by = list(by)
    rng = genome_range(df, by)
    f0, f1 = fractions
    base = df.join(rng, by, "left") if by else df.withColumn(
        "genome_range", F.lit(df.agg((F.max("end_pos") - F.min("start_pos"))).first()[0]))
    lo, hi = fraction_bound(f0, "genome_range"), fraction_bound(f1, "genome_range")
    out = base.where((F.col("start_pos") >= lo) & (F.col("end_pos") <= hi)).select(
        *by, F.col("seq_id").cast("string").alias("block_id"), "start_pos", "end_pos", "locus_tag",
        F.col(control_value).alias("inner"), F.col(test_value).alias("outer"), F.col(metric).alias("hist"))
    if hide_zeros:
        out = out.where(not_both_zero("inner", "outer"))
    return out


def coordinates_ring(coords: DataFrame) -> DataFrame:
    """Coordinate rows as a ring track: ``start - 1`` so single-base hits have width."""
    return coords.select(F.col("seq_id").cast("string").alias("block_id"), (F.col("start") - 1).alias("start"),
                         "end", F.expr("try_cast(score as double)").alias("value"))

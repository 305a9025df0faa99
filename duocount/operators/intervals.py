"""Point-in-interval join as an equi-join on hierarchical bins.

A bare range predicate plans as a CartesianProduct / nested loop. Bins come in levels, each MAX_BINS times
as wide as the one below; an interval takes the lowest level at which it touches at most MAX_BINS + 1 bins, so a
feature over a whole sequence is a few dozen rows beside genes that touch one or two bins. Each point falls
into exactly one bin of every level that some interval uses (one or two on most tables), so the equi-join on
``(keys, level, bin)`` plus the residual interval predicate returns every (point, interval) pair exactly once, with no
de-duplication step; a long interval's points stay spread over its bins. The join is a shuffle (sort-merge) join;
AQE turns it into a broadcast join at run time when the exploded interval side is measured small, and splits
skewed bins otherwise.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_QUANTILE = 0.9
LEVEL_BITS = 5                  # a level's bins are 2 ** LEVEL_BITS times as wide as the ones below
MAX_BINS = 1 << LEVEL_BITS


def _span_bits(lo: Column, hi: Column) -> Column:
    """b with 2 ** (b - 1) < span <= 2 ** b; 0 for a span of one position, or a reversed interval."""
    over = F.ceil(hi - lo).cast("bigint")
    return F.when(over <= 0, F.lit(0)).otherwise(F.length(F.bin(over)))


def _level(bits: Column, base: int) -> Column:
    """Lowest level (of base width 2 ** base) at which 2 ** bits positions are at most MAX_BINS widths."""
    return F.greatest(F.ceil((bits - F.lit(base)) / F.lit(LEVEL_BITS)).cast("int") - 1, F.lit(0))


def bin_levels(intervals: DataFrame, lo: str, hi: str, quantile: float = DEFAULT_QUANTILE,
               bin_width=None) -> tuple[int, list[int]]:
    """Base width (as a power of two: log2) and the levels that intervals use.

    The base width is the least power of two that is no less than the ``quantile`` of interval span (or
    than ``bin_width``): most intervals touch 1-2 bins. One aggregate by span bits; at most 64 rows reach the driver.
    """
    bits = _span_bits(F.col(lo), F.col(hi))
    counts = intervals.select(bits.alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("n")).collect()
    seen = sorted((r["b"], r["n"]) for r in counts)
    if bin_width:
        base = (max(1, int(bin_width)) - 1).bit_length()
    else:
        base, left = 0, quantile * sum(n for _, n in seen)
        for b, n in seen:
            base, left = b, left - n
            if left <= 0:
                break
    return base, sorted({max(-((base - b) // LEVEL_BITS) - 1, 0) for b, _ in seen}) or [0]


def in_interval(pos: Column, lo: Column, hi: Column, bounds: str = "open") -> Column:
    if bounds == "open":
        return (pos > lo) & (pos < hi)
    if bounds == "closed":
        return (pos >= lo) & (pos <= hi)
    raise ValueError(f"bounds must be 'open' or 'closed', not {bounds!r}")


def interval_join(points: DataFrame, intervals: DataFrame, *, pos: str, lo: str, hi: str,
                  on: Sequence[str] = (), bounds: str = "open", bin_width=None,
                  how: str = "inner") -> DataFrame:
    """Pairs (point, interval) with ``lo < pos < hi`` (or closed), matched on the ``on`` keys.

    ``how='left'`` keeps every interval (intervals on the left, points on the right), so intervals
    with no point come out once per bin, at most MAX_BINS + 1 times, with null point columns. A reversed interval, or
    one without bounds, holds no point.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    on = list(on)
    base, levels = bin_levels(intervals, lo, hi, bin_width=bin_width)

    def width(level):
        return F.pow(F.lit(2.0), F.lit(float(base)) + level * F.lit(float(LEVEL_BITS)))

    def bin_at(position: str, level) -> Column:
        return F.floor(F.col(position) / width(level)).cast("bigint")

    # a left join keeps intervals without bounds too: they lie in no bin
    spread = F.explode_outer if how == "left" else F.explode
    ib = intervals.withColumn("_level", _level(_span_bits(F.col(lo), F.col(hi)), base))
    first, last = bin_at(lo, F.col("_level")), bin_at(hi, F.col("_level"))
    ib = ib.withColumn("_bin", spread(F.sequence(first, F.greatest(first, last))))
    pb = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels])) if len(levels) > 1 else F.lit(levels[0]))
    pb = pb.withColumn("_bin", bin_at(pos, F.col("_level")))
    i, p = ib.alias("_i"), pb.alias("_p")
    cond = [F.col(f"_i.{k}") == F.col(f"_p.{k}") for k in on + ["_level", "_bin"]]
    cond.append(in_interval(F.col(f"_p.{pos}"), F.col(f"_i.{lo}"), F.col(f"_i.{hi}"), bounds))
    j = i.join(p, cond, how)
    point_cols = [c for c in points.columns if c not in on]
    return j.select("_i.*", *[F.col(f"_p.{c}") for c in point_cols]).drop("_level", "_bin")

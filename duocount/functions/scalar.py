"""Column expressions (JVM-side, inside whole-stage codegen). No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duocount.functions.util import col_of


def log2_fold_change(test, control) -> Column:
    """log2(test / control) with the zero rules of the comparison (C01, rule Q2).

    control == 0 -> 0 (even when test is null); either side null -> null; ratio <= 0 -> 0.
    The divide sits behind the guards, so ANSI mode never sees x / 0.
    """
    a, b = col_of(test), col_of(control)
    ratio = a / b
    return (F.when(b == 0, F.lit(0.0))
            .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(ratio <= 0, F.lit(0.0))
            .otherwise(F.log(ratio) / F.log(F.lit(2.0))))


def round_half_even(c, places: int = 5) -> Column:
    """numpy-style rounding (half to even on the scaled value): rint(x * 10^p) / 10^p (P05, rule Q4)."""
    scale = float(10 ** places)
    return F.rint(col_of(c) * F.lit(scale)) / F.lit(scale)


def nan_to_null(c) -> Column:
    """NaN sorts above every number in Spark (NaN >= 0 is true), so NaN becomes null at the edge (Q6)."""
    x = col_of(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def group_label(c) -> Column:
    """Text after the last underscore: the condition of a replicate column name (P10)."""
    return F.substring_index(col_of(c), "_", -1)


def gene_label(locus_tag="locus_tag", gene="gene") -> Column:
    """``locus - gene``, or the locus alone when there is no gene name."""
    g = col_of(gene)
    return F.when(g.isNull() | (g == ""), col_of(locus_tag)).otherwise(
        F.concat_ws(" - ", col_of(locus_tag), g))


def bar_centre(start="start_pos", end="end_pos") -> Column:
    """Centre of an interval as drawn by a bar."""
    s, e = col_of(start), col_of(end)
    return (e - s) / F.lit(2) + s


def bar_width(start="start_pos", end="end_pos") -> Column:
    return col_of(end) - col_of(start)


def fraction_bound(fraction: float, span) -> Column:
    """Integer genome bound from a fraction of a range, truncated like ``int(f * span)``."""
    return (F.lit(float(fraction)) * col_of(span)).cast("bigint")


def zero_in_exactly_one(control, test) -> Column:
    """Entity is zero in one condition and positive in the other."""
    c, t = col_of(control), col_of(test)
    return F.coalesce(((c == 0) & (t > 0)) | ((c > 0) & (t == 0)), F.lit(False))


def truncated_last(last_pct) -> Column:
    """Last insertion in (0, 10) percent of the gene."""
    x = col_of(last_pct)
    return F.coalesce((x < 10) & (x > 0), F.lit(False))


def truncated_first(first_pct) -> Column:
    """First insertion beyond 90 percent of the gene."""
    return F.coalesce(col_of(first_pct) > 90, F.lit(False))


def set_label(in_a, in_b) -> Column:
    """Venn region of a row: AB, Ab (only A), aB (only B) or null."""
    a, b = col_of(in_a), col_of(in_b)
    return (F.when(a & b, F.lit("AB")).when(a, F.lit("Ab")).when(b, F.lit("aB"))
            .otherwise(F.lit(None).cast("string")))


def readable_name(name: str) -> str:
    """Heading shown for a column: underscores become spaces."""
    return name.replace("_", " ")

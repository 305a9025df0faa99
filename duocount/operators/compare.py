"""Merge of two per-entity tables and the comparison metrics on top."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duocount.functions.scalar import log2_fold_change, round_half_even, zero_in_exactly_one
from duocount.operators.ordered import min_rank_pct_many
from duocount.operators.ranges import number_rows
from duocount.spec import ComparisonSpec, SchemaError


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SchemaError(f"{what} lacks required columns {missing}")


def add_suffix(df: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Append ``suffix`` to every non-key column."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keys})


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null."""
    return df.na.drop(how="all")


def merge_conditions(control: DataFrame, test: Optional[DataFrame], spec: ComparisonSpec = ComparisonSpec()) -> DataFrame:
    """Inner join of control and test on the entity keys, null matching null (J01, rule Q1).

    The join condition is a conjunction of ``<=>``; Catalyst plans it as a sort-merge join on
    ``(coalesce(k), isnull(k))`` pairs, never a nested loop. Keys are taken from the control side.
    A control-only spec returns the cleaned control table unchanged (S09).
    """
    keys = spec.all_keys
    require_columns(control, keys, "control table")
    control = drop_empty_rows(control)
    if spec.control_only or test is None:
        return control
    require_columns(test, keys, "test table")
    test = drop_empty_rows(test)
    c = add_suffix(control, keys, spec.control_suffix).alias("_c")
    t = add_suffix(test, keys, spec.test_suffix).alias("_t")
    cond = reduce(lambda a, b: a & b, [F.col(f"_c.{k}").eqNullSafe(F.col(f"_t.{k}")) for k in keys])
    c_rest = [x for x in c.columns if x not in keys]
    t_rest = [x for x in t.columns if x not in keys]
    return c.join(t, cond, "inner").select(
        *[F.col(f"_c.{k}").alias(k) for k in keys],
        *[F.col(f"_c.{x}") for x in c_rest], *[F.col(f"_t.{x}") for x in t_rest])


def condition_columns(df: DataFrame, suffix: str, containing: Optional[str] = None) -> list:
    """Columns of one condition, optionally containing a substring (P02; substring test, rule Q13)."""
    return [c for c in df.columns if suffix in c and (containing is None or containing in c)]


def score_columns(df: DataFrame, spec: ComparisonSpec, marker: Optional[str] = None) -> tuple:
    """The single (test, control) column pair containing ``marker`` (P03); typed error otherwise."""
    spec.require_comparison()
    marker = marker or spec.score_marker
    t = condition_columns(df, spec.test_suffix, marker)
    c = condition_columns(df, spec.control_suffix, marker)
    both = set(t) & set(c)
    if both:
        raise SchemaError(f"columns {sorted(both)} match both condition suffixes")
    if len(t) != 1 or len(c) != 1:
        raise SchemaError(f"expected one {marker!r} column per condition, found test={t} control={c}")
    return t[0], c[0]


def add_metric(df: DataFrame, spec: ComparisonSpec, name: str,
               fn: Callable[[Column, Column], Column], marker: Optional[str] = None):
    """Pluggable comparison metric of (test, control) score columns, computed only if absent.

    ``fn`` returns a Column; a ``pandas_udf`` of two series is a Column-returning callable too.
    Returns ``(df, spec)`` with the metric registered in ``spec.metrics``.
    """
    if name not in df.columns:
        t, c = score_columns(df, spec, marker)
        df = df.withColumn(name, fn(F.col(t), F.col(c)))
    return df, spec.with_metric(name)


def add_fold_change(df: DataFrame, spec: ComparisonSpec, name: str = "fold_change"):
    """log2(test/control) with the zero rules."""
    return add_metric(df, spec, name, log2_fold_change)


def add_pctl_rank_diff(df: DataFrame, spec: ComparisonSpec, name: str = "pctl_rank", n_buckets=None):
    """Percentile rank of test minus percentile rank of control (W01, W02), per run."""
    if name in df.columns:
        return df, spec.with_metric(name)
    t, c = score_columns(df, spec)
    ranked = min_rank_pct_many(df, {"_pct_t": t, "_pct_c": c}, spec.run_cols, n_buckets)
    out = ranked.withColumn(name, F.col("_pct_t") - F.col("_pct_c")).drop("_pct_t", "_pct_c")
    return out, spec.with_metric(name)


def compare(control: DataFrame, test: Optional[DataFrame], spec: ComparisonSpec = ComparisonSpec()):
    """Merge and add the two standard metrics; the one-call form of a comparison run."""
    df = merge_conditions(control, test, spec)
    if spec.control_only or test is None:
        return df, spec
    df, spec = add_fold_change(df, spec)
    df, spec = add_pctl_rank_diff(df, spec)
    return df, spec


def flag_zero_in_one(df: DataFrame, spec: ComparisonSpec, name: str = "zero_in_one") -> DataFrame:
    """Entities zero in exactly one condition."""
    t, c = score_columns(df, spec)
    return df.withColumn(name, zero_in_exactly_one(F.col(c), F.col(t)))


def round_numeric(df: DataFrame, places: int = 5) -> DataFrame:
    """Round every floating column half-to-even at ``places`` (P05, rule Q4)."""
    return df.select(*[round_half_even(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def visible_columns(df: DataFrame, spec: ComparisonSpec, simple: bool = False, metric: Optional[str] = "all") -> list:
    """Columns shown for a comparison (P04): all, or keys + 4 scores + metrics; never seq_id.

    ``metric`` names one metric to keep among the registered ones; unknown names raise.
    """
    if metric not in list(spec.metrics) + [None, "all"]:
        raise SchemaError(f"metric {metric!r} is not a comparison column")
    if simple:
        nim_t, nim_c = score_columns(df, spec, spec.score_marker)
        nrm_t, nrm_c = score_columns(df, spec, spec.reads_marker)
        cols = list(spec.keys) + [nrm_t, nrm_c, nim_t, nim_c] + [m for m in spec.metrics if m in df.columns]
    else:
        cols = list(df.columns)
    cols = [c for c in cols if c != "seq_id"]
    if metric and metric != "all":
        cols = [c for c in cols if c not in spec.metrics] + [metric]
    return cols


def page(df: DataFrame, order: Sequence, tiebreak: Sequence[str], page_index: int, page_size: int,
         condition: Optional[Column] = None) -> DataFrame:
    """User filter, sort and one page of rows (F13, O03); the key is appended as a tie-break so pages
    are stable."""
    page_size = max(1, int(page_size))
    if condition is not None:
        df = df.where(condition)
    return df.orderBy(*order, *tiebreak).offset(int(page_index) * page_size).limit(page_size)


def insert_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append a column at the end."""
    return df.withColumn(name, value)


def add_row_id(df: DataFrame, name: str = "row_id", keys: Optional[Sequence[str]] = None) -> DataFrame:
    """A unique row id (P06): the entity key when given (stable across runs), else a
    ``monotonically_increasing_id`` (unique, not consecutive, not stable across re-reads)."""
    if keys:
        return df.withColumn(name, F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return df.withColumn(name, F.monotonically_increasing_id())


def add_row_number(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_number") -> DataFrame:
    """A dense row id from 0 in ``order`` (P06, O01), within ``by`` if given: counts of range partitions give every
    partition its offset, so the rows are never sorted in one task. ``order`` should identify rows (add a tie-break)."""
    numbered = number_rows(df, by, [F.col(c).asc() for c in order], name, "_total")
    return numbered.select(*df.columns, F.col(name).cast("bigint").alias(name))


def lookup(df: DataFrame, value, key: str = "locus_tag") -> DataFrame:
    """Rows of one entity (F12); on a Parquet table the equality is pushed to the scan."""
    return df.where(F.col(key) == F.lit(value))

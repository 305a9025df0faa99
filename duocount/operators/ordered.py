"""Order statistics over a whole table without an ``Exchange SinglePartition``.

A plain ``Window.orderBy(x)`` with no partition, or with few, moves whole groups into one task each. Here
values are first reduced to distinct values with multiplicities (ties collapse, partial aggregation runs
map-side) and dealt by range over (group, value), so a group has as many tasks as its values fill. Running counts
inside a partition are offset by prefix sums over the (partition, group) cells, and results go back to the
rows by a key join that spreads hot values (:mod:`duocount.operators.ranges`). No number of partitions or
groups is fixed, results never depend on them, and a null group key is a group like others.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duocount.operators.ranges import BROADCAST_ROWS, deal_by_range, join_by_count
from duocount.session import cut_lineage

FEW_GROUPS = 1000           # groups known to be so few have few (partition, group) cells, which are broadcast
CELL = ["_part", "_g"]


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_double(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def count_below_sql(at, n: int, x_sql: str) -> str:
    """SQL text of a balanced CASE tree counting entries ``at(0..n-1)`` (ascending) below ``x_sql``."""
    def rec(lo, hi):
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {at(mid)} < {x_sql} THEN {rec(mid + 1, hi)} ELSE {rec(lo, mid)} END"
    return rec(0, n)


def count_below(cuts, x: str, n: int = None):
    """Number of entries of the ascending ``cuts`` strictly below column ``x``.

    ``cuts`` is a Python list (literals) or the name of an array column of known length ``n``.
    A balanced CASE tree: log2(n) comparisons per row inside whole-stage codegen, where a lambda over
    the array would be evaluated row by row outside it; built as one SQL expression so the driver
    makes one call instead of one per node.
    """
    if isinstance(cuts, (list, tuple)):
        vals = [float(c) for c in cuts]
        return F.expr(count_below_sql(lambda i: _sql_double(vals[i]), len(vals), x))
    return F.expr(count_below_sql(lambda i: f"element_at({_sql_name(cuts)}, {i + 1})", n, x))


def _cells(cells: DataFrame, by: Sequence[str], few: bool) -> DataFrame:
    """Per-cell results, broadcast where the partitions and groups they come from are few."""
    if not by or few or cells.count() <= BROADCAST_ROWS:
        return F.broadcast(cells)
    return cells


def ordered_distinct(df: DataFrame, value: str, by: Sequence[str] = (), n_buckets=None, few: bool = False) -> DataFrame:
    """Distinct non-null values per group with their position in the group's sorted order. ``n_buckets``: range
    partitions (default: the session's shuffle partitions); ``few``: at most FEW_GROUPS groups, by the caller's parameters.

    Columns: ``by..., value, _m`` (multiplicity), ``_part, _g`` (range partition and group), ``_below`` (rows with a
    smaller value), ``_tot`` (non-null rows in the group). min-rank = _below + 1, max-rank = _below + _m.
    """
    by = list(by)
    vals = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_m"))
    dealt = deal_by_range(vals, by, [F.col(value).asc()], n_buckets)
    group = Window.partitionBy("_g")
    cells = dealt.groupBy(*CELL).agg(F.sum("_m").alias("_n"))
    cells = cells.select(*CELL, F.sum("_n").over(group).alias("_tot"), (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_off"))
    inside = Window.partitionBy(*CELL).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_in", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
            .join(_cells(cells, by, few), CELL)
            .withColumn("_below", F.col("_off") + F.col("_in")).drop("_off", "_in"))


def _back_to_rows(df: DataFrame, found: DataFrame, value: str, out: str, by: Sequence[str]) -> DataFrame:
    """``df`` with ``out`` of its (group, value) from ``found``, which has every present value and its multiplicity
    ``_m``; a null value gets null. Nulls and hot values are spread."""
    nulls = df.where(F.col(value).isNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_m"), F.lit(None).cast("double").alias(out))
    keyed = found.select(*by, value, "_m", out).unionByName(nulls)
    return join_by_count(df, cut_lineage(keyed, "found"), [*by, value], "_m")


def min_rank_pct(df: DataFrame, value: str, out: str, by: Sequence[str] = (), n_buckets=None) -> DataFrame:
    """Percentile rank: lowest rank of a tie / number of non-null values; null stays null.

    This is not ``percent_rank()`` ((rank-1)/(n-1)).
    """
    by = list(by)
    ranks = ordered_distinct(df, value, by, n_buckets).withColumn(out, (F.col("_below") + 1) / F.col("_tot"))
    return _back_to_rows(df, ranks, value, out, by)


def min_rank_pct_many(df: DataFrame, values: dict, by: Sequence[str] = (), n_buckets=None) -> DataFrame:
    """Several percentile ranks: ``values`` maps output column -> input column. All columns are ranked by
    one plan, written once, and read back for each column."""
    by = list(by)
    sides = list(values.items())
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(out).alias("_side"), F.col(src).cast("double").alias("_v")) for out, src in sides
    ])).alias("_e")).select(*by, "_e._side", "_e._v")
    ranks = (ordered_distinct(long, "_v", by + ["_side"], n_buckets, few=not by)
             .select(*by, "_side", "_v", "_m", ((F.col("_below") + 1) / F.col("_tot")).alias("_pct")))
    nulls = long.where("_v is null").groupBy(*by, "_side", "_v").agg(F.count(F.lit(1)).alias("_m"), F.lit(None).cast("double").alias("_pct"))
    ranks = cut_lineage(ranks.unionByName(nulls), "ranks")
    out = df
    for name, src in sides:
        r = ranks.where(F.col("_side") == name).select(*by, "_v", "_m", F.col("_pct").alias(name))
        out = join_by_count(out.withColumn("_v", F.col(src).cast("double")), r, [*by, "_v"], "_m").drop("_v")
    return out


def bh_adjust(df: DataFrame, p: str, out: str, by: Sequence[str] = (), n_buckets=None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values.

    q(p) = p * n / r, r = the highest rank of a tie (number of p-values <= p); then the running
    minimum from the largest p down, capped at 1. Null p-values stay null and do not count in n.
    """
    by = list(by)
    od = ordered_distinct(df, p, by, n_buckets)
    od = od.withColumn("_q", F.col(p) * F.col("_tot") / (F.col("_below") + F.col("_m")))
    w_in = Window.partitionBy(*CELL).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    od = od.withColumn("_qmin_in", F.min("_q").over(w_in))
    w_hi = Window.partitionBy("_g").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = od.groupBy(*CELL).agg(F.min("_q").alias("_bq")).withColumn("_qmin_hi", F.min("_bq").over(w_hi)).drop("_bq")
    adj = od.join(above, CELL).withColumn(out, F.least(F.lit(1.0), F.col("_qmin_in"), F.coalesce("_qmin_hi", "_qmin_in")))
    return _back_to_rows(df, adj, p, out, by)


def next_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], take: str, out: str,
                  n_buckets=None) -> DataFrame:
    """``lead(take)`` over rows ordered by ``order`` within ``by``, without one task per group.

    Rows are dealt by range over the whole order key, so rows sharing its first columns still spread by the
    others; inside a partition a windowed ``lead``; the last row of a (partition, group) cell takes the first row
    of the group's next cell. ``order`` must identify rows uniquely within a group (add a tie-breaker).
    """
    by, order = list(by), list(order)
    dealt = deal_by_range(df, by, [F.col(c).asc() for c in order], n_buckets)
    inside = F.lead(F.struct(F.col(take).alias("v"))).over(Window.partitionBy(*CELL).orderBy(*order))
    firsts = dealt.groupBy(*CELL).agg(
        F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(take).alias("v"))).alias("_first"))
    following = F.lead("_first.v").over(Window.partitionBy("_g").orderBy("_part"))
    firsts = firsts.select(*CELL, following.alias("_following"))
    return (dealt.withColumn("_lead", inside).join(_cells(firsts, by, False), CELL)
            .withColumn(out, F.when(F.col("_lead").isNull(), F.col("_following")).otherwise(F.col("_lead.v")))
            .drop(*CELL, "_lead", "_following"))


def _lerp(a, b, t):
    """numpy's linear interpolation (a + (b-a)t, or b - (b-a)(1-t) for t >= 0.5)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def exact_quantiles(df: DataFrame, value: str, probs: dict, by: Sequence[str] = (), n_buckets=None,
                    few: bool = False) -> DataFrame:
    """Exact quantiles with numpy's default (linear) interpolation, one row per group.

    ``probs`` maps output column -> probability. Spark's exact ``percentile`` keeps every value of
    a group in one aggregation buffer; here the values go through :func:`ordered_distinct` and each
    distinct value emits only the probabilities whose neighbouring ranks it holds (about two rows
    per probability in total), so nothing is multiplied by the number of probabilities.
    """
    by = list(by)
    od = ordered_distinct(df, value, by, n_buckets, few)
    items = list(probs.items())
    parr = F.array(*[F.lit(float(p)) for _, p in items])
    n1 = (F.col("_tot") - F.lit(1)).cast("double")
    idx = lambda i: F.element_at(parr, i + 1) * n1
    holds = lambda r: (F.col("_below") <= r) & (r < F.col("_below") + F.col("_m"))
    def holds_sql(r):
        return f"(_below <= {r} AND {r} < _below + _m)"
    cases = []
    for i, (_, p) in enumerate(items):
        ix = f"({_sql_double(p)} * CAST(_tot - 1 AS DOUBLE))"
        cases.append(f"CASE WHEN {holds_sql(f'FLOOR({ix})')} OR {holds_sql(f'CEIL({ix})')} THEN {i} END")
    hit = F.expr(f"array_compact(array({', '.join(cases)}))")
    x = (od.select(*by, value, "_below", "_m", "_tot", F.explode(hit).alias("_pi"))
         .withColumn("_idx", F.element_at(parr, F.col("_pi") + 1) * n1)
         .withColumn("_rlo", F.floor("_idx")).withColumn("_rhi", F.ceil("_idx")))
    covers = lambda r: holds(F.col(r))
    g = x.groupBy(*by, "_pi").agg(
        F.max(F.when(covers("_rlo"), F.col(value).cast("double"))).alias("_a"),
        F.max(F.when(covers("_rhi"), F.col(value).cast("double"))).alias("_b"),
        F.first("_idx").alias("_idx"), F.first("_rlo").alias("_rlo"))
    g = g.withColumn("_q", _lerp(F.col("_a"), F.col("_b"), F.col("_idx") - F.col("_rlo")))
    return g.groupBy(*by).agg(*[F.expr(f"max(CASE WHEN _pi = {i} THEN _q END)").alias(name)
                                for i, (name, _) in enumerate(items)])

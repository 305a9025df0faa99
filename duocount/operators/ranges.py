"""Row positions and key joins that no single group, value or key can pile into one task.

``number_rows`` deals rows by range over the whole order key, counts every (partition, group) cell and
adds prefix offsets, so a group of any size is numbered by as many tasks as it has partitions.
``join_by_count`` joins rows to a table of one row per key that says how many rows each key has: keys
above a share of all rows are few by counting and are broadcast, the others are joined by a shuffle.
Groups and keys are compared as structs, in which a null equals a null.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duocount.session import cut_lineage

BROADCAST_ROWS = 100_000   # a key table of at most so many rows is broadcast whole
HOT_KEYS = 100_000         # keys holding more than 1 / HOT_KEYS of the rows: fewer than HOT_KEYS by counting


def group_key(by: Sequence[str]) -> Column:
    """The group columns as one struct (a constant for no columns): null groups are groups like others."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))


def deal_by_range(df: DataFrame, by: Sequence[str], order: Sequence, partitions: int = None) -> DataFrame:
    """``df`` with ``_g`` (its group) and ``_part``, written once: partitions are consecutive ranges of
    (group, order), so lower numbers hold the earlier rows. ``order`` takes names or sort columns.

    Rows equal in the whole order share a partition: end it with a tie-breaker where they may be many."""
    keyed = df.withColumn("_g", group_key(by))
    spread = [partitions] if partitions else []
    dealt = keyed.repartitionByRange(*spread, F.col("_g").asc(), *order)
    return cut_lineage(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence, position: str, total: str,
                partitions: int = None) -> DataFrame:
    """Add ``position`` (from 0 in the group's order) and ``total`` (rows of the group)."""
    dealt = deal_by_range(df, by, order, partitions)
    cells = dealt.groupBy("_part", "_g").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_g")
    cells = cells.select("_part", "_g", F.sum("_n").over(group).alias(total),
                         (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", "_g").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(cells, ["_part", "_g"])
            .withColumn(position, F.col("_before") + F.col("_inside")).drop("_part", "_g", "_before", "_inside"))


def join_by_count(rows: DataFrame, keyed: DataFrame, on: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left_semi``) to ``keyed``, one row per key, null-safe on the columns
    ``on``; its column ``weight`` (not returned) says how many of ``rows`` have that key, or a bound of it.

    ``keyed`` is read up to three times: pass a table. Its columns should be of fixed width: up to HOT_KEYS rows
    are broadcast. The result has the columns of ``rows`` and, for ``inner``, the other columns of ``keyed``."""
    payload = [c for c in keyed.columns if c not in (*on, weight)]
    side = keyed.select(group_key(on).alias("_k"), F.struct(F.lit(1).alias("met"), *payload).alias("_p"), weight)
    size = side.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).first()
    found = rows.withColumn("_k", group_key(on))
    if size["n"] <= BROADCAST_ROWS:
        found = found.join(F.broadcast(side.drop(weight)), "_k")
    else:
        limit = max(1, int(size["w"]) // HOT_KEYS)
        hot = side.where(F.col(weight) > limit).select("_k", F.col("_p").alias("_hot"))
        cold = side.where(F.col(weight) <= limit).select(F.struct("_k", F.lit(0).cast("long").alias("salt")).alias("_s"), "_p")
        # rows that met a hot key are spread over all tasks; the others meet their key
        salted = F.when(F.col("_hot").isNull(), F.struct("_k", F.lit(0).cast("long").alias("salt"))).otherwise(
            F.struct(F.lit(None).cast(rows.select(group_key(on).alias("_k")).schema["_k"].dataType).alias("_k"),
                     F.xxhash64(*rows.columns).alias("salt")))
        found = (found.join(F.broadcast(hot), "_k", "left").withColumn("_s", salted).join(cold, "_s", "left")
                 .withColumn("_p", F.coalesce("_hot", "_p")).where("_p is not null").drop("_s", "_hot"))
    keep = [F.col(c) for c in rows.columns]
    return found.select(*keep, *([F.col(f"_p.{c}") for c in payload] if how == "inner" else []))

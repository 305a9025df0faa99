"""Attribute strings ``k=v;k=v`` as maps (C02) and as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duocount.functions.util import col_of


def parse_attributes(attr="attributes") -> Column:
    """MAP<STRING,STRING> of an attribute string.

    Pieces without ``=`` are skipped; the value is the text between the first and second ``=``
    (``a=b=c`` gives ``b``); the last piece with a repeated key wins. Duplicates are removed inside
    the array (keep a key only if no later piece has it), so no session setting is touched.
    """
    pieces = F.filter(F.split(col_of(attr), ";"), lambda p: p.contains("="))
    kv = F.transform(pieces, lambda p: F.struct(
        F.split(p, "=").getItem(0).alias("key"),
        F.split(p, "=").getItem(1).alias("value")))
    last_wins = F.filter(kv, lambda e, i: ~F.exists(
        F.slice(kv, i + 2, F.greatest(F.size(kv) - i - 1, F.lit(1))),
        lambda later: later["key"] == e["key"]) | (i + 1 == F.size(kv)))
    return F.map_from_entries(last_wins)


def attribute_pairs(df: DataFrame, keep, map_col: str = "attr_map") -> DataFrame:
    """Long form of C03: ``keep`` columns, ``key``, ``value``, one row per attribute. Needs no list of
    names, so it suits tables with very many of them."""
    return df.select(*keep, F.explode(map_col))


def widen_attributes(df: DataFrame, map_col: str = "attr_map", keys=None, drop: bool = True) -> DataFrame:
    """One column per attribute key (C03). Keys come from one distinct pass unless given.

    The distinct key set is the vocabulary of attribute names (the columns of the result), not the rows.
    """
    if keys is None:
        keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(map_col)).alias("k")).distinct().collect())
    out = df.select("*", *[F.element_at(F.col(map_col), F.lit(k)).alias(k) for k in keys])
    return out.drop(map_col) if drop else out

"""Views of the driver's tables in the library's input layouts (features, insertions, pools, attributes).

Each view is a lazy projection of a Parquet scan, so column pruning and filters reach the scan.
The same views are written in SQL for the DuckDB oracle in ``__spark_entry__.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with the footer schema remembered per path (skips a schema-inference job)."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _condition():
    return F.when(F.col("l_linestatus") == "F", F.lit("control")).otherwise(F.lit("test"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval per part, never overlapping; gene null for every fifth part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit("1").alias("seq_id"),
        F.concat(F.lit("LT"), F.col("p_partkey").cast("string")).alias("locus_tag"),
        F.col("p_type").alias("type"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("gene"),
        (F.col("p_partkey") * 1000 + 1).cast("bigint").alias("start_pos"),
        (F.col("p_partkey") * 1000 + F.col("p_size") * 18).cast("bigint").alias("end_pos"),
        (F.col("p_size") * 18).cast("bigint").alias("feat_length"),
        F.col("p_name").alias("product"),
    )


def insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One insertion per line item; condition from the line status."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("1").alias("seq_id"),
        _condition().alias("condition"),
        (F.col("l_partkey") * 1000 + 1 + (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 1000)
        .cast("bigint").alias("position"),
        F.col("l_quantity").cast("bigint").alias("cnt"),
    )


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions as coordinate (GFF3) rows: control carries no scores (``.``: count mode), test does."""
    ins = insertions(spark, sf_dir)
    return ins.select(
        "condition", "seq_id", F.lit("sf").alias("source"), F.lit("misc_feature").alias("type"),
        F.col("position").alias("start"), F.col("position").alias("end"),
        F.when(F.col("condition") == "control", F.lit(".")).otherwise(F.col("cnt").cast("string")).alias("score"),
        F.lit(".").alias("strand"), F.lit(".").alias("phase"), F.lit("note=insertion;").alias("attributes"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicates per condition, long form: entity_id, sample, condition, cnt."""
    li = table(spark, sf_dir, "lineitem")
    cond = _condition()
    return (li.select(
        F.col("l_partkey").cast("string").alias("entity_id"),
        F.concat(F.lit("rep"), (F.col("l_linenumber") % 3).cast("string"), F.lit("_MP_"), cond).alias("sample"),
        cond.alias("condition"), "l_quantity")
        .groupBy("entity_id", "sample", "condition")
        .agg(F.sum("l_quantity").cast("bigint").alias("cnt")))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute strings with a double '=', a bare word and a repeated key."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.concat(
        F.lit("ID="), F.col("event_id").cast("string"), F.lit(";type="), F.col("event_type"),
        F.lit(";k=v=w;flag;type="), F.upper(F.col("event_type")), F.lit(";")).alias("attributes"))

"""Training-data pipeline over ``documents``: quality classifier, quality rules, n-gram Jaccard join,
benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``docs``. Every stage inherits the defined results of its operator for nulls,
empty and very long texts, ties, repeated rows, empty tables and clashing columns; beyond those:

* rules and classifier keep or drop row by row; a null or empty text fails the rules (no words);
* of linked documents the one with the least id stays, and of rows with one id and equal text one; rows
  with a null id or without words link nothing and stay;
* a document that contains a benchmark item goes, with a null id too;
* both decide row by row: rows that share an id but not the text don't share their fate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duocount.llm import decontaminate, jaccard_join, packing, quality, quality_rules
from duocount.llm.queries import QUALITY_AT, TOKEN_LIMIT, quality_samples, table, tokenizer_path
from duocount.operators.ranges import number_rows
from duocount.session import checkpoint_dir, cut_lineage


def keyed_rows(docs: DataFrame, null_ids: bool) -> DataFrame:
    """``key`` (long) and ``row``, the columns of ``docs`` as a struct. The key is the id where no id is repeated (or null, with
    ``null_ids``); else the row's position in the order of ids, so that a lesser key still means a lesser id. Without
    ``null_ids`` a null id stays a null key."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    unsure = "doc_id is null or n > 1" if null_ids else "doc_id is not null and n > 1"
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(unsure)
    if not shared.limit(1).count():
        return docs.select(F.col("doc_id").cast("long").alias("key"), whole)
    # equal rows spread by a number of their own
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nr"), whole)
    placed = number_rows(rows, [], ["doc_id", "hash", "nr"], "key", "total")
    key = F.col("key") if null_ids else F.when(F.col("doc_id").isNotNull(), F.col("key"))
    return cut_lineage(placed.select(key.cast("long").alias("key"), "row"), "row-keys")


def without(keyed: DataFrame, gone: DataFrame, columns: list) -> DataFrame:
    """The rows whose key is not in ``gone``."""
    return keyed.join(gone, "key", "left_anti").select([F.col("row").getField(c).alias(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores QUALITY_AT or more."""
    positives, unlabelled = quality_samples(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, quality.train_on_texts(docs, positives, unlabelled), QUALITY_AT)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the limits of their language and source."""
    return quality_rules.judge(docs, docs.columns).where("kept").select("row.*")


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    keyed = keyed_rows(docs, null_ids=False)
    classes = jaccard_join.jaccard_classes(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    gone = cut_lineage(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct(), "copies")
    left = without(keyed, gone, docs.columns)
    # rows of one id without words link nothing: of those with equal text one stays as well
    twice = cut_lineage(left.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeats")
    if not twice.limit(1).count():
        return left
    once = left.join(twice, "doc_id", "left_anti")
    again = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(docs.columns).union(again.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    keyed = keyed_rows(docs, null_ids=True)
    texts = keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))
    found = decontaminate.contained_items(texts, table(spark, sf_dir, "benchmark"))
    leaks = cut_lineage(found.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return without(keyed, leaks, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of TOKEN_LIMIT tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, limit=TOKEN_LIMIT)


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("n-gram Jaccard join", jaccard_dedup),
          ("benchmark decontamination", decontamination), ("packing", pack)]

#: Learnt weights and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/duocount-pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

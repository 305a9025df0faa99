"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duocount.llm import (binary_ids, decontaminate, jaccard_join, lm_score, merkle, packing, quality, quality_rules,
                          substring_dedup, token_count, toxicity, url_filter, vector_codes)
from duocount.llm.oracle import ORACLES

URL_RULES = [url_filter.rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                                           ("allow", "com/fr/"), ("block", "com/de/"))]
TOKEN_LIMIT = 4096
TOXIC_AT, QUALITY_AT = 0.7, 0.3


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def op1_quality_rules(spark, sf_dir):
    """Adaptive quality rules per language and source."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_binary_ids(spark, sf_dir):
    """Token ids written as Arrow sequence files and read back per document."""
    docs = table(spark, sf_dir, "documents")
    store = binary_ids.write_sequences(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return binary_ids.read_documents(spark, store)


def op3_jaccard_join(spark, sf_dir):
    """Classes of documents linked by a 5-word shingle Jaccard similarity of 0.75 or more."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    """Url verdicts by rule, else by trust and distrust over host edges."""
    out = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_decontaminate(spark, sf_dir):
    """Benchmark items contained in documents."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark, sf_dir):
    """Masked pseudo-likelihood of every document."""
    docs = table(spark, sf_dir, "documents")
    vocab = lm_score.vocabulary(docs)
    return lm_score.score(docs, vocab, lm_score.train(docs, vocab))


def op7_packing(spark, sf_dir):
    """Documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, limit=TOKEN_LIMIT)


def op8_toxicity(spark, sf_dir):
    """Toxicity scores from document labels, sentence by sentence."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold(3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "sentences")


def quality_samples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_ids of trusted positives and of unlabelled rows, both of the training fold."""
    seen = labels.where(fold(5) != 0)
    positives = seen.where("quality = 1").select("doc_id")
    # only label 1 is read: every other row of the fold is unlabelled web text
    unlabelled = docs.where(fold(5) != 0).select("doc_id").join(positives, "doc_id", "left_anti")
    return positives, unlabelled


def op9_quality(spark, sf_dir):
    """Quality scores by positive-unlabelled learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    features = quality.feature_table(docs)
    scored = quality.score(features, quality.train(features, *quality_samples(features, labels)))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


def op10_token_count(spark, sf_dir):
    """Token counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(docs, tokenizer_path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op11_merkle_manifest(spark, sf_dir):
    """Merkle leaves, roots and proofs of every document, checked against a tampered copy."""
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark, sf_dir):
    """Documents without the passages of 35 words or more that occur more than once."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_vector_codes(spark, sf_dir):
    """Product codes of the embeddings and what they lose."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_quality_rules, op2_binary_ids, op3_jaccard_join, op4_url_filter, op5_decontaminate, op6_lm_score,
           op7_packing, op8_toxicity, op9_quality, op10_token_count, op11_merkle_manifest,
           op12_substring_dedup, op13_vector_codes]
    return {**{q.__name__: q for q in own}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {**ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search (DataFrame
functions only).

An item is contained in a document when at least 75 % of the item's distinct 5-word shingles are
shingles of the document, however long that is. Items are partitioned by size (powers of two of their
shingle count). An item's signature is its bottom-k MinHash, the k least hashes, with
``k = n - ceil(0.75 n) + 1``: a document with 75 % of the shingles misses at most ``k - 1`` of them, so
it shares a signature value and no true pair is lost. A partition's ceiling is its greatest signature
value; a document only sends hashes up to the highest ceiling into the search, and a hit counts in the
partitions whose ceiling it is under. Candidates are verified by exact containment.

The signature table is broadcast only after its rows have been counted (``BROADCAST_ROWS``); beyond
that the join shuffles both sides on the hash.

Words are runs of anything but 0x20 and 0x09-0x0D, lower-cased. Defined results: null and empty texts
have no shingles and match nothing; a text of one to four words has its whole sequence as one shingle;
repeated items and documents with one id each match on their own, the greatest containment of an
(id, item) pair is reported once; rows with a null id are not reported; clashing columns are not read;
an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duocount.llm.quality_rules import SPACE
from duocount.session import cut_lineage

BROADCAST_ROWS = 1_000_000  # 16 bytes each


def shingle_hashes(words: Column, k: int = 5) -> Column:
    """Hashes of all k-word windows of an array of words; of the whole sequence if it is shorter."""
    n = F.size(words)
    window = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
                         lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return (F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < k, F.array(F.xxhash64(F.lit(k), F.array_join(words, " ")))).otherwise(window))


def words_of(text: str) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+", -1))


def shingle_table(rows: DataFrame, row_id: str, text: str, k: int = 5) -> DataFrame:
    """(id, distinct shingle hashes ``sh``) of every row with an id."""
    words = rows.where(F.col(f"`{row_id}`").isNotNull()).select(F.col(f"`{row_id}`").alias("id"), words_of(text).alias("w"))
    return words.select("id", F.array_distinct(shingle_hashes(F.col("w"), k)).alias("sh"))


def signatures(items: DataFrame, percent: int = 75) -> DataFrame:
    """(item_id, n, size_class, ceiling, value): one row a signature value of an item."""
    n = F.size("sh")
    k = n - F.ceil(n * percent / 100).cast("int") + 1
    signed = (items.where(n > 0).select("item_id", n.alias("n"), F.length(F.bin(n.cast("long"))).alias("size_class"),
                                        F.slice(F.sort_array("sh"), F.lit(1), k).alias("values")))
    ceilings = signed.groupBy("size_class").agg(F.max(F.element_at("values", -1)).alias("ceiling"))
    return (signed.join(ceilings, "size_class")
            .select("item_id", "n", "size_class", "ceiling", F.explode("values").alias("value")))


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document that contains an item."""
    items = cut_lineage(shingle_table(benchmark, item_id, item_text).withColumnRenamed("id", "item_id"), "items")
    signed = cut_lineage(signatures(items, percent), "signatures")
    size = signed.agg(F.count("*").alias("rows"), F.max("ceiling").alias("top")).first()
    table = shingle_table(docs, doc_id, text)
    # explode_outer: explode would put a filter on the size of the array below the projections, which
    # would then split the text again for every word
    values = (table.select(F.col("id").alias("doc_id"), F.explode_outer("sh").alias("value"))
              .where(F.col("value") <= F.lit(size["top"]).cast("long")))
    search = F.broadcast(signed) if size["rows"] <= BROADCAST_ROWS else signed
    found = (values.join(search, "value").where(F.col("value") <= F.col("ceiling")).select("doc_id", "item_id").distinct())
    candidates = cut_lineage(found, "leak-candidates")
    # exact containment, over the documents that have a candidate
    some = (docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .join(candidates.select("doc_id").distinct(), "doc_id", "left_semi"))
    whole = shingle_table(some, "doc_id", "text").withColumnRenamed("id", "doc_id")
    wanted = items.select("item_id", F.col("sh").alias("item_sh"))
    pairs = candidates.join(whole, "doc_id").join(wanted, "item_id")
    checked = pairs.select("doc_id", "item_id", F.size("item_sh").cast("long").alias("n_shingles"),
                           F.size(F.array_intersect("item_sh", "sh")).cast("long").alias("n_shared"))
    best = checked.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shingles", "m.n_shared", "m.containment")

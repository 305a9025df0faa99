"""Operator 1: quality rules with adaptive thresholds (DataFrame functions only).

Counts of each whole text become whole-number measures (per thousand words, lines or bytes). A quantile
sketch is kept per language, source and measure: a histogram whose bucket is the value itself below 64
and its leading six bits above (relative error 1/32). Sketches merge by adding counts, so they are one
partial aggregation whatever the skew, and a language's or the corpus' sketch is the sum of its
sources'. A measure's limits come from the TOP, middle and BOTTOM quantiles of its own group's sketch,

    high = top + REACH * (top - middle)        low = bottom - REACH * (middle - bottom)

Each quantile is drawn towards that of the language, and the language's towards the corpus', with weight n / (n + PRIOR) on
the finer one of n documents: small groups lean on their parents, large ones hardly, and no size switches between them.
Where nearly all documents of a group have none of something, its limit is near none. Limits are joined back to
the documents. Sketches cover all documents that pass the base rules.

Defined results: null text counts as empty (0 everywhere, base_failed); null language or source is a
group of its own; ties and repeated rows are judged row by row; clashing columns of the documents are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duocount.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS, PRIOR, REACH = 50, 200, 3
BOTTOM, MIDDLE, TOP = 10, 500, 990   # quantiles in thousandths
BROADCAST_ROWS = 50_000  # limits of about 200 bytes each
#: measure -> whether a low limit holds too
MEASURES = {"word_length": True, "symbols": False, "dup_lines": False, "repeat_words": False, "capitals": False, "bangs": False}


def text_counts(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang",
                source: str = "source") -> DataFrame:
    """``row`` (a struct of the columns to keep), lang, source and the counts of each whole text."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    space = F.lit(SPACE)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{lang}`").alias("lang"),
                       F.col(f"`{source}`").alias("source"), t.alias("t"))
    trimmed = F.btrim("t", space)
    split = base.select(
        "row", "lang", "source",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+", -1)).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, space) != "").alias("lines"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_bangs"))
    counted = split.select(
        "row", "lang", "source", "n_symbols", "n_capitals", "n_bangs",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))),
                        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("h"))
    # positions sorted by window; only for texts where some window occurs twice
    ordered = counted.withColumn("s", F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = ordered.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda v, k: (F.get("s", k - 1)["x"] == v["x"]) | (F.get("s", k + 1)["x"] == v["x"])),
        lambda v: v["i"])))
    covered = F.aggregate(
        F.transform("p", lambda v, k: F.least(F.coalesce(F.get("p", k + 1) - v, F.lit(3)), F.lit(3))),
        F.lit(0), lambda total, x: total + x)
    return same.select("row", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
                       "n_lines", "n_capitals", "n_bangs")


def bucket(value: Column) -> Column:
    """Sketch bucket of a whole number >= 0."""
    shift = F.length(F.bin(value)).cast("long") - 6
    return F.when(value < 64, value).otherwise(shift * 32 + F.call_function(
        "shiftright", value, shift.cast("int")))


def bucket_value(b: Column) -> Column:
    """The least value of a bucket."""
    shift = F.floor((b - 32) / 32)
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b - shift * 32).cast("long"), shift.cast("int")))


def measures() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))

    def share(n: Column, of: Column, times: int = 1000) -> Column:
        return F.floor(n * times / of).cast("long")

    return {"word_length": share(F.col("word_chars"), words, 100), "symbols": share(F.col("n_symbols"), words),
            "dup_lines": share(F.col("n_dup_lines"), lines), "repeat_words": share(F.col("n_repeat_words"), words),
            "capitals": share(F.col("n_capitals"), F.greatest(F.col("word_chars"), F.lit(1))),
            "bangs": share(F.col("n_bangs"), words)}


def sketches(judged: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of a table with the measure columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return (judged.select("lang", "source", pairs.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket")
            .agg(F.count("*").alias("n")))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, low, high) maps by measure for every group of a sketch."""
    keys = ["lang", "source", "measure"]
    levels = []
    for depth, own in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])):
        merged = sketch.groupBy(*own, "measure", "bucket").agg(F.sum("n").alias("n"))
        # the cells of one sketch, at most a few hundred, in bucket order with running counts
        cells = merged.groupBy(*own, "measure").agg(
            F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("total"))

        def at(share: int) -> Column:
            found = F.aggregate(
                "cells", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bucket")),
                lambda acc, c: F.struct(
                    (acc["seen"] + c["n"]).alias("seen"),
                    F.when(acc["bucket"].isNull() & ((acc["seen"] + c["n"]) * 1000 >= F.col("total") * share), c["bucket"])
                    .otherwise(acc["bucket"]).alias("bucket")))
            return bucket_value(found["bucket"]).cast("double")

        levels.append((depth, own, cells.select(
            *own, "measure", (F.col("total").cast("double") / (F.col("total") + PRIOR)).alias("weight"),
            at(BOTTOM).alias("bottom"), at(MIDDLE).alias("middle"), at(TOP).alias("top"))))
    groups = sketch.select(*keys).distinct()
    for depth, own, table in levels:
        on = groups["measure"] == table["measure"]
        for k in own:
            on = on & groups[k].eqNullSafe(table[k])
        kept = [groups[c] for c in groups.columns]
        groups = groups.join(table, on, "left").select(
            *kept, F.struct(*[table[c] for c in ("weight", "bottom", "middle", "top")]).alias(f"q_{depth}"))

    def drawn(name: str) -> Column:
        fine, coarse, all_ = (F.col(f"q_{d}") for d in (2, 1, 0))
        parent = coarse["weight"] * coarse[name] + (1 - coarse["weight"]) * all_[name]
        return fine["weight"] * fine[name] + (1 - fine["weight"]) * parent

    low = F.create_map(*[F.lit(x) for m, b in MEASURES.items() for x in (m, b)])[F.col("measure")]
    bottom, middle, top = (drawn(c) for c in ("bottom", "middle", "top"))
    fences = groups.select(*keys, (top + REACH * (top - middle)).alias("high"),
                           F.when(low, bottom - REACH * (middle - bottom)).otherwise(-1.0).alias("low"))
    return fences.groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("fence"))


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``row`` (a struct of the columns ``keep``), the counts, ``base_failed``, ``kept`` and ``failed``
    (names of the measures outside their limits). Counts are written once, with the kept columns; the
    limits, one row a (language, source), are broadcast only after they have been counted."""
    counts = cut_lineage(text_counts(docs, keep, text, lang, source), "quality-counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counts.withColumns({"base_failed": failed, **measures()})
    fence = cut_lineage(limits(sketches(judged.where(~F.col("base_failed")))), "quality-limits")
    g = fence.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "fence")
    g = F.broadcast(g) if g.count() <= BROADCAST_ROWS else g
    joined = judged.join(g, judged["lang"].eqNullSafe(F.col("g_lang")) & judged["source"].eqNullSafe(F.col("g_source")), "left")
    outside = F.filter(F.array(*[
        F.when((F.col(m) > F.col("fence")[m]["high"]) | (F.col(m) < F.col("fence")[m]["low"]), F.lit(m)) for m in MEASURES]),
        lambda x: x.isNotNull())
    out = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(outside)
    return joined.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.size(out) == 0)).alias("kept"), out.alias("failed"))

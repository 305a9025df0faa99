"""Operator 12: removal of word passages that occur more than once, by seed and extend.

A window is ``length`` consecutive words of one text; words covered by a window that also starts anywhere
else (same text included) are removed. All windows are judged on the input.

* Seeds: of every window, the least hash among its ``SEED``-word grams (the rightmost of equal ones) is its
  anchor. The choice depends on the window's words alone, so equal windows have equal anchors at equal
  offsets: no repeat of ``length`` words is without a common anchor. About one word in 14 is an anchor, and
  consecutive windows share one; their *span* is what they cover together.
* Joining: occurrences are joined on the anchor. An anchor met once is dropped by counting. Where all spans of an anchor
  are equal (64 bits each of gram and span), the match extends over the whole span both ways and all its windows repeat:
  a group of any number of copies is settled by one count, without pairs.
* Extending: where one anchor has several spans, one occurrence of each is extended from the anchor, to
  every number of words left and right of it that make up a window inside its span, again by counting equal ones.
* Windows found are merged to maximal repeats per text and cut out.

Counts are partial aggregates. Keys that hold a large share of the rows are joined by broadcast, bounded by counting
(``operators/ranges.py``); a text's own anchors and windows are the largest group ever brought together. Between the
steps a text goes by its id and 64-bit hash; where at most ``KEY_ROWS`` texts are needed again, their keys are broadcast,
so that only their words are shuffled. The seeds are computed twice, which costs less than writing them all.

Defined results: a null, empty or blank text has no words, nothing removed and the hash of the empty
string; a text under ``length`` words has no window; repeated rows, null or repeated ids are texts like others,
and repeat each other; a text of any length is one unit, its words within one task; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.llm.batches import tidy
from duocount.llm.words import buffers, mix, slices, word_hashes
from duocount.operators.ranges import group_key, join_by_count
from duocount.session import cut_lineage

LENGTH, SEED = 35, 8
KEY_ROWS = 1_000_000   # texts whose keys (two 64-bit numbers) are broadcast
_U = np.uint64
_GRAM, _RANGE = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642B)   # odd: invertible modulo 2 ** 64

TEXT = ["doc_id", "mark"]
_OCCURRENCE = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_OCCURRENCE_SQL = "anchor long, span long, doc_id long, mark long, start int, n int"


class Rolling:
    """64-bit hashes of word ranges of one slice in constant time, independent of their place."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        power = np.full(len(words) + 1, base, _U)
        power[0] = 1
        back = np.full(len(words) + 1, _U(pow(int(base), -1, 2 ** 64)))
        back[0] = 1
        self._sum = np.zeros(len(words) + 1, _U)
        np.cumsum(words * np.multiply.accumulate(power)[:-1], out=self._sum[1:])
        self._unshift = np.multiply.accumulate(back)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._unshift[start] + (end - start).astype(_U))


def _rightmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of ``width`` consecutive values, the rightmost of equal ones, for every start."""
    value, place, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        n = len(value) - step
        right = value[step:] <= value[:n]
        value, place, have = np.where(right, value[step:], value[:n]), np.where(right, place[step:], place[:n]), have + step
    return place


def occurrences(words: np.ndarray, row: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """(anchor, span, first window, windows, row) of every run of windows with one anchor in a slice."""
    none = np.zeros(0, np.int64)
    if len(words) < length:
        return none.astype(_U), none.astype(_U), none, none, none
    grams = np.arange(len(words) - seed + 1)
    gram = Rolling(words, _GRAM).at(grams, grams + seed)
    place = _rightmost_min(gram, length - seed + 1)
    text = np.repeat(np.arange(len(row) - 1), np.diff(row))[:len(place)]
    start = np.flatnonzero(np.arange(len(place)) + length <= row[1:][text])
    if not len(start):
        return none.astype(_U), none.astype(_U), none, none, none
    at, text = place[start], text[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.concatenate([first, [len(start)]]))
    low, at, text = start[first], at[first], text[first]
    span = mix(Rolling(words, _RANGE).at(low, low + n + length - 1) + (at - low).astype(_U))
    return gram[at], span, low, n, text


def _seed_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").cast(pa.int64()), batch.column("mark")
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                words, row = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lower=False)
                anchor, span, low, n, text = occurrences(words, row, length)
                which = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), ids.take(which), marks.take(which),
                    pa.array((low - row[text]).astype(np.int32)), pa.array(n.astype(np.int32))], schema=_OCCURRENCE)
    return run


_WINDOW = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()),
                     ("alone", pa.bool_())])
_WINDOW_SQL = "anchor long, window long, doc_id long, mark long, start int, alone boolean"


def _lists(col: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, fields) of a list-of-structs column; null lists are empty."""
    flat = col.flatten()
    size = np.array([0 if x is None else x for x in pc.list_value_length(col).to_pylist()], np.int64)
    return np.concatenate([[0], np.cumsum(size)]), {f.name: flat.field(k).to_numpy(zero_copy_only=False)
                                                     for k, f in enumerate(col.type.value_type)}


def _extend_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").cast(pa.int64()), batch.column("mark")
            first, seeds = _lists(batch.column("seeds"))
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                words, row = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lower=False)
                own = slice(first[a], first[b])
                text = np.repeat(np.arange(b - a), np.diff(first[a:b + 1]))
                n = seeds["n"][own].astype(np.int64)
                each = np.repeat(np.arange(len(n)), n)
                start = seeds["start"][own].astype(np.int64)[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = row[text[each]] + start
                window = Rolling(words, _RANGE).at(at, at + length)
                which = pa.array(text[each] + a)
                yield pa.RecordBatch.from_arrays([
                    pa.array(seeds["anchor"][own][each]), pa.array(window.view(np.int64)), ids.take(which), marks.take(which),
                    pa.array(start.astype(np.int32)), pa.array(seeds["alone"][own][each].astype(bool))], schema=_WINDOW)
    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                   ("repeats", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])
_KEPT_SQL = "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<start:int,length:int>>"


def _cut_batches(length: int):
    def cut(words: list, starts: np.ndarray, n: np.ndarray) -> tuple[int, bytes, list]:
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + n + length - 1, -1)
        gone = np.cumsum(edge)[:-1] > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
        return int(gone.sum()), kept, [{"start": i, "length": j - i} for i, j in zip(turn[::2].tolist(), turn[1::2].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            first, found = _lists(batch.column("found"))
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                out = []
                for k in range(a, b):
                    words = data[offsets[k]:offsets[k + 1]].tobytes().split()   # splits at 0x20 and 0x09-0x0D
                    i, j = first[k], first[k + 1]
                    out.append((len(words), *(cut(words, found["start"][i:j].astype(np.int64), found["n"][i:j].astype(np.int64))
                                              if j > i else (0, b" ".join(words), []))))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2].decode() for x in out], pa.string()), pa.array([x[3] for x in out], _KEPT.field("repeats").type)], schema=_KEPT)
    return run


def _with_lists(texts: DataFrame, lists: DataFrame, name: str, rest: bool) -> DataFrame:
    """``texts`` with the column ``name`` of ``lists`` by text; with ``rest``, also texts that have none (null)."""
    side = lists.select(group_key(TEXT).alias("_k"), name)
    keyed = texts.withColumn("_k", group_key(TEXT))
    if lists.count() > KEY_ROWS:
        return keyed.join(side, "_k", "left" if rest else "inner").drop("_k")
    few = F.broadcast(side.select("_k"))
    needed = keyed.join(few, "_k", "left_semi").join(side, "_k").drop("_k")
    if not rest:
        return needed
    none = keyed.join(few, "_k", "left_anti").drop("_k").withColumn(name, F.lit(None).cast(lists.schema[name].dataType))
    return needed.unionByName(none)


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, mark, start, n): runs of n windows of the texts that also start elsewhere."""
    occurrence = texts.mapInArrow(tidy(_seed_batches(length)), _OCCURRENCE_SQL)
    anchors = cut_lineage(occurrence.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("times"), (F.min("span") != F.max("span")).alias("apart")).where("times > 1"), "anchors")
    met = cut_lineage(join_by_count(occurrence, anchors, ["anchor"], "times"), "met")
    apart = met.where("apart")
    spans = cut_lineage(apart.groupBy("anchor", "span").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct(*TEXT, "start", "n")).alias("one")), "spans")
    settled = met.where("not apart").drop("apart").unionByName(
        join_by_count(apart.drop("apart"), spans.where("times > 1").drop("one"), ["anchor", "span"], "times", "left_semi"))
    seeds = cut_lineage(spans.groupBy(*[F.col(f"one.{c}").alias(c) for c in TEXT]).agg(F.collect_list(F.struct(
        "anchor", F.col("one.start").alias("start"), F.col("one.n").alias("n"), (F.col("times") == 1).alias("alone"))).alias("seeds")), "seeds")
    windows = cut_lineage(_with_lists(texts, seeds, "seeds", False).mapInArrow(tidy(_extend_batches(length)), _WINDOW_SQL), "windows")
    key = ["anchor", "window"]
    twice = cut_lineage(windows.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeats")
    extended = join_by_count(windows.where("alone"), twice, key, "times", "left_semi")
    return settled.select(*TEXT, "start", "n").union(extended.select(*TEXT, "start", F.lit(1)))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, repeats) of every row: ``kept_text`` has the kept words joined by one
    space, ``repeats`` the removed passages as (first word, words)."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    found = cut_lineage(repeated_windows(texts, length).groupBy(*TEXT).agg(F.collect_set(F.struct("start", "n")).alias("found")), "found")
    return _with_lists(texts, found, "found", True).mapInArrow(tidy(_cut_batches(length)), _KEPT_SQL)

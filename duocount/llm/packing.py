"""Operator 7: shortest-pack-first packing over the length histogram.

Each document is encoded once and cut into pieces of at most ``limit`` tokens (full pieces and one
remainder). The histogram of piece lengths (at most ``limit`` entries, whatever the input) goes to the
driver, where lengths are placed longest first, each into the packs that are shortest so far; a group
of packs with one packing pattern is a range of sequence numbers with a count, and placing a length
splits a group and moves the taken part to its new total. The result is a list of slots

    (length, first rank, first sequence, offset, count)

and a piece finds its sequence and offset from its length and its rank among the pieces of that length.
Ranks are a rank inside the writing task plus the count of the same length in earlier tasks, so no
length, however common, meets in one task.

Defined results: null text counts as empty (the end id alone: one piece of length 1); null, tied and
repeated document ids are packed row by row; a document of any length gives ceil(tokens / limit)
pieces; columns other than the id and the text are not read, so clashing names do not matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duocount.llm.batches import small_batches, tidy
from duocount.llm.encode import encoder
from duocount.llm.words import buffers, slices
from duocount.session import cut_lineage

SLOT = np.dtype([("length", "<i8"), ("rank", "<i8"), ("sequence", "<i8"), ("offset", "<i8"), ("count", "<i8")])


def shortest_pack_first(histogram: dict[int, int], limit: int) -> np.ndarray:
    """Slots (length, rank, sequence, offset, count), sorted by length and rank.

    ``histogram``: pieces by length. Packs of one total are kept as ranges of sequence numbers; the
    heap holds the totals, so the shortest packs come first."""
    groups: dict[int, list[tuple[int, int]]] = {}
    totals: list[int] = []
    slots, sequences = [], 0

    def put(total: int, first: int, count: int) -> None:
        if total not in groups:
            groups[total] = []
            heapq.heappush(totals, total)
        groups[total].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if not totals or totals[0] + length > limit:
                first, total, count = sequences, 0, left  # no pack has room: open as many as are left
                sequences += left
            else:
                total = totals[0]
                first, count = groups[total].pop()
                if count > left:
                    groups[total].append((first + left, count - left))
                    count = left
                if not groups[total]:
                    del groups[total]
                    heapq.heappop(totals)
            slots.append((length, rank, first, total, count))
            put(total + length, first, count)
            rank += count
            left -= count
    return np.sort(np.array(slots, dtype=SLOT), order=["length", "rank"])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens, and (task, rank_in_task)
    of the piece among those of its length in the writing task."""
    source = small_batches(docs).select(
                         F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(limit + 1, np.int64)
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                rows, start, length, crc, total = [], [], [], [], []
                for row, raw in enumerate(encode(batch.column(1)[a:b])):
                    ids = memoryview(raw + end)
                    n = len(ids) // 4
                    for at in range(0, n, limit):
                        part = ids[4 * at:4 * min(n, at + limit)]
                        rows.append(row)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                length = np.array(length, dtype=np.int64)
                order = np.argsort(length, kind="stable")  # rank among equal lengths, in row order
                run = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(run, run) + seen[run]
                seen += np.bincount(length, minlength=limit + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(total, pa.int64()),
                     pa.array(np.full(len(length), task, np.int32)), pa.array(rank)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank_in_task"])

    return source.mapInArrow(tidy(cut, caches=True), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "task int, rank_in_task long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 4096, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    made = cut_lineage(pieces(docs, tokenizer, end_id, limit, doc_id, text), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = shortest_pack_first(histogram, limit)
    ranked = (made.join(base, ["length", "task"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("rank_in_task") + F.col("base")).alias("rank")))
    width = 40  # bits of a rank beside the length
    key = (slots["length"] << width) + slots["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = slots[np.searchsorted(key, (length << width) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slot["sequence"] + rank - slot["rank"]), pa.array(slot["offset"])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long")

"""Operator 13: product codes of vectors, with nearest codebook entries found through a GNAT.

A vector's components become integers and are cut into ``PARTS`` equal parts; each part is coded by the
nearest of up to ``ENTRIES`` codebook entries (squared Euclidean distance, ties to the lower index).
Codebooks start from the vectors with the least ids and are moved to the floored mean of what they were
given, ``rounds`` times.

Nearest entries come from a geometric near-neighbour access tree (GNAT) over each part's entries: a node
picks split points, every other entry goes to its nearest split point, and each (split point, subtree)
pair stores the range of distances between them. For a query, a subtree is dropped whole where its range
for any split point lies *strictly* outside [d - best, d + best]. Ranges and query distances are rounded
outwards, so rounding can only keep a subtree, and what is left is compared by exact integer squared
distances with the entry index as tie-breaker: the result is that of comparing all entries. Queries go
through the tree a batch at a time.

Every step works on all vectors: a round is one pass that gives sums and counts per entry and task, added up by
Spark; only the codebooks (at most PARTS * ENTRIES entries) reach the driver.

Defined results: vectors that are null, hold null or non-finite components, are empty, or whose length is not that of the
first kept vector (by id) are dropped, as are all if that length is no multiple of ``PARTS``. Of rows with one id the
lesser vector comes first; null ids are coded and come last for the start of the codebooks. With fewer
than ``ENTRIES`` vectors the codebooks are that short. Null labels are one label. Other columns are not read; no kept rows give no
rows. Components over ``LIMIT`` in magnitude raise an error: integer sums would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple, Optional

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duocount.llm.batches import tidy
from duocount.operators.ranges import join_by_count
from duocount.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SPLITS, LEAF = 16, 32        # split points of a node; entries that are compared without a further node
LIMIT = float(1 << 13)       # |x|: integers of 2 ** 23, squared distances of 2 ** 48 a component


class Node(NamedTuple):
    """Split points, the distance ranges of split point i to subtree j, and the subtrees (a node, or entry indexes)."""

    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list


def _fits_doubles(top: float, width: int) -> bool:
    return top ** 2 * 4 * max(width, 1) < 2 ** 53


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer squared distances of rows of ``a`` to rows of ``b``."""
    return np.stack([((a - e) ** 2).sum(1) for e in b], axis=1)


def _below(d2: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded down."""
    return np.maximum(np.nextafter(np.sqrt(d2.astype(np.float64)) * (1 - 1e-12), -np.inf), 0.0)


def _above(d2: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded up."""
    return np.nextafter(np.sqrt(d2.astype(np.float64)) * (1 + 1e-12), np.inf)


def build(entries: np.ndarray, members: np.ndarray):
    """A GNAT over ``entries[members]``; a few members are a leaf. Split points are far from each other."""
    if len(members) <= LEAF:
        return members
    points = entries[members]
    picked, far = [0], _squared(points, points[:1])[:, 0]
    while len(picked) < SPLITS and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _squared(points, points[picked[-1:]])[:, 0])
    if len(picked) == 1:  # all entries are equal
        return members
    distance = _squared(points, points[picked])
    home = distance.argmin(1)
    home[picked] = -1
    low, high = (np.full((len(picked), len(picked)), fill) for fill in (np.inf, -np.inf))
    children = []
    for j in range(len(picked)):
        inside = home == j
        children.append(build(entries, members[inside]))
        if inside.any():
            low[:, j], high[:, j] = _below(distance[inside].min(0)), _above(distance[inside].max(0))
    order = np.argsort(members[picked])   # split points in ascending index order
    return Node(members[picked][order], low[np.ix_(order, order)], high[np.ix_(order, order)], [children[j] for j in order])


class Gnat:
    """Exact nearest entries: squared distance and index, the lower index of equally near ones."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.tree = build(entries, np.arange(len(entries)))
        self.top = float(np.abs(entries).max(initial=0))
        self.compared = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers are held in doubles where every sum of products fits into one, else in 64-bit integers."""
        fits = _fits_doubles(max(self.top, float(np.abs(queries).max(initial=0))), queries.shape[1])
        kind = np.float64 if fits else np.int64
        q, e = queries.astype(kind), self.entries.astype(kind)
        search = _Search(q, (q * q).sum(1), e, (e * e).sum(1))
        search.visit(self.tree, np.arange(len(q)))
        self.compared += search.compared
        return search.best.astype(np.int64), search.index


class _Search:
    """One batch of queries on its way through a tree: their least squared distance and its entry so far."""

    def __init__(self, queries, query_norm, entries, entry_norm):
        self.q, self.qn, self.e, self.en = queries, query_norm, entries, entry_norm
        self.best = np.full(len(queries), 2 ** 62, queries.dtype)
        self.index = np.full(len(queries), len(entries), np.int64)
        self.compared = 0

    def compare(self, members: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer verification of ``members`` (ascending) against the best so far: whole squared distances, ties by index."""
        d2 = self.q[rows] @ self.e[members].T
        d2 *= -2
        d2 += self.en[members]
        pick = d2.argmin(1)  # the first of equal ones: the lowest index
        near, who = d2[np.arange(len(rows)), pick] + self.qn[rows], members[pick]
        best, index = self.best[rows], self.index[rows]
        better = (near < best) | ((near == best) & (who < index))
        self.best[rows] = np.where(better, near, best)
        self.index[rows] = np.where(better, who, index)
        self.compared += d2.size
        return d2

    def visit(self, node, rows: np.ndarray):
        if not isinstance(node, Node):
            if len(node) and len(rows):
                self.compare(node, rows)
            return
        d2 = self.compare(node.splits, rows) + self.qn[rows][:, None]
        home = d2.argmin(1)
        under, over = _below(d2), _above(d2)
        gap = np.full(d2.shape, -np.inf)   # how far a subtree's ranges keep it away from the query, at least
        for i in range(len(node.splits)):
            np.maximum(gap, under[:, i, None] - node.high[i], out=gap)
            np.maximum(gap, node.low[i] - over[:, i, None], out=gap)
        for j, child in enumerate(node.children):   # the subtree of the nearest split point first: a small best early
            self.visit(child, rows[home == j])
        reach = _above(self.best[rows])
        for j, child in enumerate(node.children):
            live = (gap[:, j] <= reach) & (home != j)
            self.visit(child, rows[live])


def codebook_sums(gnats: list[Gnat], vectors: np.ndarray):
    """(entry of each part, squared distance of each part) of integer vectors."""
    parts = np.split(vectors, len(gnats), axis=1)
    found = [g.nearest(p) for g, p in zip(gnats, parts)]
    return np.stack([i for _, i in found], 1), np.stack([d for d, _ in found], 1)


def integers(column: pa.Array, width: Optional[int] = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, integer vectors) of a list column, the vectors of ``width`` components only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    size = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    value = flat.to_numpy(zero_copy_only=False).astype(np.float64)   # a null component is NaN here
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    bad = np.bincount(row[~np.isfinite(value)], minlength=len(size)) > 0
    keep = ~bad & (size > 0 if width is None else size == width)
    value = value[keep[row]]
    if np.abs(value).max(initial=0) > LIMIT:
        raise ValueError(f"components over {LIMIT} in magnitude")
    whole = np.floor(value * SCALE).astype(np.int64)
    rows = np.flatnonzero(keep)
    return rows, whole.reshape(len(rows), width) if width else whole


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, _ = integers(batch.column("embedding"))
        yield batch.take(pa.array(rows))


class Codebooks(NamedTuple):
    """Integer entries by part: an array of (parts, entries, components)."""

    entries: np.ndarray

    def gnats(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Optional[Codebooks]:
    """The parts of the kept vectors with the least ids, at most ``entries`` of them."""
    sound = vectors.select("vec_id", "embedding").mapInArrow(_kept_batches, vectors.select("vec_id", "embedding").schema)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    first = sound.orderBy(*order).limit(1).first()
    if first is None or len(first.embedding) % parts:
        return None
    width = len(first.embedding)
    rows = sound.where(F.size("embedding") == width).orderBy(*order).limit(entries).collect()
    whole = np.floor(np.array([r.embedding for r in rows], np.float64) * SCALE).astype(np.int64)
    return Codebooks(np.stack(np.split(whole, parts, axis=1)))


def _sum_batches(books: Codebooks):
    """Per task: sums and counts of what every entry is given."""
    n_parts, n_entries, width = books.entries.shape
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gnats = books.gnats()
        sums, count = np.zeros((n_parts, n_entries, width), np.int64), np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            _, whole = integers(batch.column("embedding"), n_parts * width)
            if len(whole):
                code, _ = codebook_sums(gnats, whole)
                for p, part in enumerate(np.split(whole, n_parts, axis=1)):
                    order = np.argsort(code[:, p], kind="stable")
                    who, first = np.unique(code[order, p], return_index=True)
                    sums[p, who] += np.add.reduceat(part[order], first, axis=0)
                    count[p] += np.bincount(code[:, p], minlength=n_entries)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([
                pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
                pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Optional[Codebooks]:
    """Codebooks after ``rounds`` rounds over all kept vectors; None if there are none."""
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        given = vectors.select("embedding").mapInArrow(tidy(_sum_batches(books)), "part int, entry int, n long, sums array<long>")
        width = books.entries.shape[2]
        total = given.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[
            F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums")).collect()
        moved = books.entries.copy()
        for r in total:
            moved[r.part, r.entry] = np.array(r.sums, np.int64) // r.n   # floors, also below zero
        books = Codebooks(moved)
    return books


_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("codes", pa.list_(pa.int32())), ("error", pa.int64())])


def _code_batches(books: Codebooks):
    n_parts, _, width = books.entries.shape
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gnats = books.gnats()
        for batch in batches:
            rows, whole = integers(batch.column("embedding"), n_parts * width)
            if len(rows):
                code, d2 = codebook_sums(gnats, whole)
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([
                    kept.column("vec_id").cast(pa.int64()), kept.column("label").cast(pa.int32()),
                    pa.array(list(code.astype(np.int32)), _CODED.field("codes").type), pa.array(d2.sum(1))], schema=_CODED)
    return run


def encode(spark: SparkSession, vectors: DataFrame, books: Optional[Codebooks]) -> DataFrame:
    """(vec_id, label, codes, error) of every kept vector: entry indexes by part, squared error in all."""
    schema = "vec_id long, label int, codes array<int>, error long"
    if books is None:
        return spark.createDataFrame([], schema)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(tidy(_code_batches(books)), schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    books = train(vectors, parts, entries, rounds)
    coded = cut_lineage(encode(vectors.sparkSession, vectors, books), "codes")
    by_label = cut_lineage(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "labels")
    hexes = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return join_by_count(coded, by_label, ["label"], "n").select(
        "vec_id", hexes.alias("code"), "error", "label_error", F.lit(books.sha256 if books else None).alias("codebooks_sha256"))

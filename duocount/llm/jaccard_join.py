"""Operator 3: exact n-gram Jaccard join in metric space.

Points are the distinct sets of 5-word shingles (equal sets are one point), the metric is
``d = 1 - |x & y| / |x | y|``, and two points link when ``d <= r = 0.25``.

1. *Distance to the rest.* A point's partner holds at least three quarters of its shingles, so a point
   of which fewer are held by any other point lies farther than r from all of them and is alone. Which
   shingles are held twice is counted by hash range; a task sends a shingle that several of its own points
   hold once, so a shingle of a third of all documents is not gathered anywhere.
2. *Pivots and regions.* With a point's shingles ordered from rare to common, linked points share one of
   their first ``n - ceil(0.75 n) + 1``. Every such shingle elects as pivot the point holding it whose
   shingles are shared most, and a point lies in the regions of the pivots it meets. (Two linked points
   meet a common pivot, so some region has both.) Distances to pivots are computed exactly; those within
   r are links and are contracted first, so what is left of a region is compared only across components.
3. *Triangle windows.* ``|d(x, p) - d(y, p)| <= d(x, y)``, so a region is ordered by distance to its
   pivot and cut into blocks of at most BLOCK points; a block is joined with itself and replicated to
   the later blocks that begin within r of its end.
4. *Recursion.* Inside a block pair the join recurses: a local pivot splits the points at the median
   distance, both sides are joined on their own, and only the points within r of the split are joined
   across, until few points or no split are left and overlaps are counted exactly.

Links across components and the first links together give the classes.

Words are runs of anything but 0x20 and 0x09-0x0D with A-Z lower-cased. Defined results: a text with
fewer than five words has its whole sequence as one shingle; a null or empty text has an empty set and
links with nothing; repeated rows and equal sets are linked; repeated ids are one node's names; a null
id keeps its row, links nothing and has a null component; clashing columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duocount.llm.batches import small_batches, tidy
from duocount.llm.components import components
from duocount.llm.words import shingle_sets
from duocount.session import cut_lineage

PERCENT, WORDS = 75, 5
BUCKET_SHINGLES = 1_500_000  # shingles in one hash range, on average
SEND_BYTES = 4 << 20  # text behind one message to each hash range
BLOCK, LEAF = 512, 48
SALTS = 16  # parts of a class when its least id is handed back


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _key(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_keys(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n, node): the size and the identity of every text's shingle set; node null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, first in shingle_sets(batch.column(1), k):
                keys = [_key(values[s:e]) if e > s else None for s, e in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(first)), pa.array(keys, pa.int64())],
                                                 names=["doc_id", "n", "node"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, node long")


def shared_shingles(docs: DataFrame, buckets: int, k: int = WORDS) -> DataFrame:
    """(node, held): how many of a set's shingles some other set holds too - never too few; too many
    where equal sets lie in different slices, which the next step sorts out."""
    shift = np.uint64(64 - 24)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32  # slices are numbered by task
        for batch in batches:
            for _, _, values, first in shingle_sets(batch.column(1), k, SEND_BYTES):
                spans = [(_key(values[s:e]), s, e) for s, e in zip(first[:-1], first[1:]) if e > s]
                once = {key: (s, e) for key, s, e in spans}
                if not once:
                    continue
                keys = np.array(list(once), dtype=np.int64)
                size = np.array([e - s for s, e in once.values()])
                v = np.concatenate([values[s:e] for s, e in once.values()])
                owner = np.repeat(np.arange(len(keys)), size)
                order = np.argsort(v, kind="stable")
                v, owner = v[order], owner[order]
                new = np.ones(len(v), dtype=bool)
                new[1:] = v[1:] != v[:-1]
                at = np.flatnonzero(new)
                several = np.diff(np.append(at, len(v))) > 1
                here = np.bincount(owner[np.repeat(several, np.diff(np.append(at, len(v))))], minlength=len(keys))
                # one message a shingle: its only owner, or none (it is known to be shared)
                v, owner = v[at], np.where(several, -1, owner[at])
                bucket = ((v >> shift) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                low = (v & np.uint64(0xFFFFFFFFFF)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                part += 1
                rows = [(-1, keys.tobytes(), here.astype("<i4").tobytes(), b"")]
                for g in range(buckets):
                    s, e = cut[g], cut[g + 1]
                    if e > s:
                        held, place = np.unique(owner[s:e], return_inverse=True)
                        names = np.where(held >= 0, keys[np.maximum(held, 0)], 0)
                        rows.append((g, names.tobytes(), place.astype("<u2" if len(held) < 65536 else "<u4").tobytes(), low[s:e].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                     *[pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3)]],
                    names=["slice", "bucket", "names", "places", "hashes"])

    schema = "slice long, bucket int, names binary, places binary, hashes binary"
    sent = docs.mapInArrow(tidy(send), schema).repartition(F.when(F.col("bucket") < 0, F.col("slice")).otherwise(F.col("bucket")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                names = np.frombuffer(row["names"], np.int64)
                if row["bucket"] < 0:
                    yield _counts([(row["slice"], names, np.frombuffer(row["places"], "<i4"))])
                    continue
                raw = np.frombuffer(row["hashes"], np.uint8).reshape(-1, 5)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :5] = raw
                place = np.frombuffer(row["places"], "<u2" if len(row["places"]) == 2 * len(raw) else "<u4")
                ranges.setdefault(row["bucket"], []).append((row["slice"], wide.view("<u8").ravel(), names[place]))
        for parts in ranges.values():
            v, owner = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
            order = np.argsort(v, kind="stable")
            same = v[order][1:] == v[order][:-1]
            other = owner[order][1:] != owner[order][:-1]
            # a run of equal shingles is shared if it has two owners, or none (known to be shared)
            new = np.concatenate([[True], ~same])
            run = np.cumsum(new) - 1
            shared = np.bincount(run[1:][same & other], minlength=run[-1] + 1) > 0
            shared[run[owner[order] == 0]] = True
            held = np.empty(len(v), dtype=bool)
            held[order] = shared[run]
            out, at = [], 0
            for part, hashes, names in parts:
                mine = names[held[at:at + len(hashes)] & (names != 0)]
                at += len(hashes)
                if len(mine):
                    out.append((part, *np.unique(mine, return_counts=True)))
            yield _counts(out)

    answers = sent.mapInArrow(tidy(count), "slice long, names binary, counts binary").repartition("slice")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                slices.setdefault(row["slice"], []).append((np.frombuffer(row["names"], np.int64), np.frombuffer(row["counts"], "<i4")))
        for parts in slices.values():
            names, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            held = np.bincount(place, weights=np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(held.astype(np.int64))], names=["node", "held"])

    return answers.mapInArrow(tidy(add), "node long, held long").groupBy("node").agg(F.sum("held").alias("held"))


def _counts(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()),
         pa.array([r[2].astype("<i4").tobytes() for r in rows], pa.binary())], names=["slice", "names", "counts"])


def point_sets(docs: DataFrame, points: DataFrame, k: int = WORDS) -> DataFrame:
    """(node, n, sh) of the points (node, doc_id), their shingle hashes sorted; sets read again from
    the texts of one document each."""
    some = docs.join(points.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, first in shingle_sets(batch.column(1), k):
                rows = [(_key(values[s:e]), s, e) for s, e in zip(first[:-1], first[1:]) if e > s]
                if rows:
                    flat = np.concatenate([values[s:e] for _, s, e in rows]).view(np.int64)
                    cut = np.concatenate([[0], np.cumsum([e - s for _, s, e in rows])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.diff(cut).astype(np.int64)),
                         pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], names=["node", "n", "sh"])

    sets = some.mapInArrow(tidy(run), "node long, n long, sh array<bigint>")
    return sets.join(points.select("node"), "node", "left_semi").dropDuplicates(["node"])


def first_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, rest, prefix): of each point that can have a partner, the shared shingles among its
    first ``n - ceil(percent n) + 1`` from rare to common; rest is the share of unshared ones."""
    each = sets.select("node", "n", F.explode("sh").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    held = (each.join(common, "s").groupBy("node", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("held")))  # one document's shingles
    kept = F.size("held")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - kept)).cast("int")
    return (held.where(kept * 100 >= F.col("n") * percent)
            .select("node", "n", ((F.col("n") - kept) / F.col("n")).alias("rest"),
                    F.slice(F.col("held.s"), F.lit(1), F.greatest(length, F.lit(0))).alias("prefix")))


def regions(prefixes: DataFrame) -> DataFrame:
    """(node, pivot): the pivots every point meets, itself left out."""
    each = prefixes.select("node", "rest", F.explode("prefix").alias("s"))
    elected = each.groupBy("s").agg(F.min(F.struct("rest", "node")).alias("p"), F.count("*").alias("n")).where("n > 1")
    return each.join(elected.select("s", F.col("p.node").alias("pivot")), "s").where("node <> pivot").select("node", "pivot").distinct()


def _overlaps(pairs: DataFrame) -> DataFrame:
    """(node, pivot, n, pivot_n, shared) of pairs with both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sh"), batch.column("pivot_sh")
            both = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                at = np.minimum(np.searchsorted(y.view(np.uint64), x.view(np.uint64)), len(y) - 1)
                both[i] = np.count_nonzero(y[at] == x)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot"), batch.column("n"), batch.column("pivot_n"),
                                              pa.array(both)], names=["node", "pivot", "n", "pivot_n", "shared"])

    return pairs.select("node", "pivot", "n", "pivot_n", "sh", "pivot_sh").mapInArrow(
        tidy(run), "node long, pivot long, n long, pivot_n long, shared long")


def pivot_distances(met: DataFrame, sets: DataFrame) -> DataFrame:
    mine = sets.select("node", "n", "sh")
    theirs = sets.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sh").alias("pivot_sh"))
    return _overlaps(met.join(mine, "node").join(theirs, "pivot"))


def _close(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= (a + b - shared) * percent


class _Region:
    """The points of one block pair, in memory: exact recursive join across components."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        self.sets, self.percent, self.r = sets, percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        _, self.root = np.unique(labels, return_inverse=True)
        self.links: list[tuple[int, int]] = []

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """Overlap of one point with each of the others."""
        flat = np.concatenate([self.sets[i] for i in others])
        mine = self.sets[one]
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        first = np.concatenate([[0], np.cumsum(self.size[others])])
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[first[1:]] - total[first[:-1]]

    def link(self, one: int, others: np.ndarray) -> np.ndarray:
        """Overlaps of one point with others; links to points of other components are recorded."""
        both = self.shared(one, others)
        close = both * 100 >= (self.size[one] + self.size[others] - both) * self.percent
        for i in others[close]:
            if self.root[i] != self.root[one]:
                self.links.append((one, int(i)))
                self.root[self.root == self.root[i]] = self.root[one]
        return both

    def leaf(self, left: np.ndarray, right: np.ndarray | None) -> None:
        for k, i in enumerate(left):
            others = left[k + 1:] if right is None else right
            others = others[self.root[others] != self.root[i]]
            fit = np.minimum(self.size[others], self.size[i]) * 100 >= np.maximum(self.size[others], self.size[i]) * self.percent
            if fit.any():
                self.link(int(i), others[fit])

    def join(self, points: np.ndarray) -> None:
        if len(points) < 2 or (self.root[points] == self.root[points[0]]).all():
            return
        if len(points) <= LEAF:
            return self.leaf(points, None)
        pivot, rest = int(points[0]), points[1:]
        d = self._distance(pivot, rest)
        mid = np.median(d)
        low, high = rest[d < mid], rest[d >= mid]
        if not len(low):
            return self.leaf(rest, None)
        self.join(low)
        self.join(high)
        self.across(low[d[d < mid] >= mid - self.r - 1e-9], high[d[d >= mid] <= mid + self.r + 1e-9])

    def across(self, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs with one point on either side."""
        if not len(left) or not len(right):
            return
        both = np.concatenate([left, right])
        if (self.root[both] == self.root[both[0]]).all():
            return
        if min(len(left), len(right)) <= LEAF:
            return self.leaf(left, right) if len(left) <= len(right) else self.leaf(right, left)
        pivot = int(left[0])
        dl, dr = self._distance(pivot, left[1:]), self._distance(pivot, right)
        left = left[1:]
        mid = np.median(np.concatenate([dl, dr]))
        if dl.max() - dl.min() <= self.r or not (dl < mid).any() or not (dr < mid).any() or not (dl >= mid).any():
            return self.leaf(left, right)
        self.across(left[dl < mid], right[dr < mid])
        self.across(left[dl >= mid], right[dr >= mid])
        self.across(left[(dl < mid) & (dl >= mid - self.r - 1e-9)], right[(dr >= mid) & (dr <= mid + self.r + 1e-9)])
        self.across(left[(dl >= mid) & (dl <= mid + self.r + 1e-9)], right[(dr < mid) & (dr >= mid - self.r - 1e-9)])

    def _distance(self, one: int, others: np.ndarray) -> np.ndarray:
        both = self.link(one, others)
        return 1 - both / (self.size[one] + self.size[others] - both)


def region_links(distances: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between points of different components that share a region."""
    r = 1 - percent / 100
    own = F.coalesce("label", "node")
    members = distances.select("pivot", "node", (1 - F.col("shared") / (F.col("n") + F.col("pivot_n") - F.col("shared"))).alias("d"))
    # the pivot itself has been compared with every member
    marked = cut_lineage(members.join(labels, "node", "left").select("pivot", "node", "d", own.alias("label")), "regions")
    mixed = marked.groupBy("pivot").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("size")).where("a <> b")
    open_ = marked.join(mixed.select("pivot", "size"), "pivot")
    # block by rank of the distance; only regions above BLOCK points have more than one
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy("d", "node")) - 1
    ranked = open_.where(F.col("size") > BLOCK).withColumn("block", F.floor(rank / BLOCK).cast("int"))
    blocked = cut_lineage(open_.where(F.col("size") <= BLOCK).withColumn("block", F.lit(0)).unionByName(ranked), "blocks")
    ends = blocked.groupBy("pivot", "block").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    a, b = ends.alias("a"), ends.alias("b")
    pairs = a.join(b, (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.block") <= F.col("b.block"))
                   & (F.col("b.low") - F.col("a.high") <= r + 1e-9)).select(
        F.col("a.pivot").alias("pivot"), F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    sides = pairs.select("pivot", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("block"))
    rows = sides.join(blocked, ["pivot", "block"]).join(sets.select("node", "sh"), "node").select("pivot", "x", "y", "block", "node", "label", "sh")

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")  # whatever order the shuffle gave
        sh = table.column("sh").combine_chunks()
        sets_ = [np.sort(sh[int(i)].values.to_numpy().view(np.uint64)) for i in order]
        block = table.column("block").to_numpy()[order]
        region = _Region(sets_, table.column("label").to_numpy()[order], percent)
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        if x == y:
            region.join(np.arange(len(order)))
        else:
            region.across(np.flatnonzero(block == x), np.flatnonzero(block == y))
        nodes = nodes[order]
        links = np.array(region.links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(nodes[links[:, 0]]), "v": pa.array(nodes[links[:, 1]])})

    return rows.groupBy("pivot", "x", "y").applyInArrow(run, "u long, v long")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least id reachable over links."""
    source = _source(docs, doc_id, text)
    keys = cut_lineage(set_keys(source, k), "set-keys")
    named = keys.where("doc_id is not null and node is not null")
    points = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    present = source.where("doc_id is not null")
    held = shared_shingles(present, max(1, -(-int(total) // BUCKET_SHINGLES)), k)
    able = cut_lineage(points.join(held, "node").where(F.col("held") * 100 >= F.col("n") * percent).select("node", "doc_id"), "points")
    sets = cut_lineage(point_sets(present, able, k), "sets")
    prefixes = cut_lineage(first_shingles(sets, percent), "prefixes")
    distances = cut_lineage(pivot_distances(regions(prefixes), sets), "pivot-distances")
    near = distances.where(_close(F.col("shared"), F.col("n"), F.col("pivot_n"), percent)).select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    labels = cut_lineage(components(near), "labels")
    far = cut_lineage(region_links(distances, sets, labels, percent), "region-links")
    if far.limit(1).count():
        labels = cut_lineage(components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(far.select("u", "v"))), "labels")
    # a class of a third of all points is spread over SALTS tasks; a point without links is its own class
    member = points.join(labels, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), F.col("label").isNotNull().alias("linked"), "doc_id",
        F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    least = member.where("linked").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    salted = least.select("label", "component_id", F.expr(f"explode(sequence(0L, {SALTS - 1}L))").alias("salt"))
    class_of = member.join(salted, ["label", "salt"], "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    joined = keys.join(class_of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))

"""Merkle manifest, substring dedup and vector codes: brute force, odd rows, hot groups."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duocount.llm import merkle, substring_dedup, vector_codes
from duocount.operators import ranges
from tests.llm.test_cases import SCHEMA, nothing, odd, small  # noqa: F401  (fixtures)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    out = ""
    for v in (row.doc_id, row.source, row.lang, row.n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def fold_up(digests):
    """(root, siblings of each leaf as (left, right) level by level) of a list of digests."""
    owners, paths = [[i] for i in range(len(digests))], [[] for _ in digests]
    while len(digests) > 1:
        up, up_owners = [], []
        for a in range(0, len(digests), 16):
            run = digests[a:a + 16]
            for k in range(len(run)):
                for o in owners[a + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            up_owners.append([o for part in owners[a:a + 16] for o in part])
        digests, owners = up, up_owners
    return digests[0], paths


def brute_manifest(docs):
    rows = docs.collect()
    ascii_lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = fold_up([x[2] for x in groups[name]])
    root, tops = fold_up([trees[name][0] for name in names]) if names else (None, [])
    out = []
    for name, top in zip(names, tops):
        for (_, _, leaf, r), path in zip(groups[name], trees[name][1]):
            whole = path + top
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            at = leaf_of(r, r.text.translate(ascii_lower)) if hit and r.text is not None else leaf
            for left, right in whole:
                at = sha(left + at + right)
            out.append((r.doc_id, leaf, trees[name][0], root, sha("".join(a + b for a, b in whole)), at, at == root))
    return sorted(out, key=str)


def found_manifest(docs):
    return sorted((tuple(r) for r in merkle.document_manifest(docs).collect()), key=str)


def test_manifest_equals_brute_force_on_odd_rows(spark, odd, nothing):  # noqa: F811
    assert found_manifest(odd) == brute_manifest(odd)
    assert merkle.document_manifest(nothing).collect() == []
    assert merkle.document_manifest(nothing).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    one = spark.createDataFrame([(None, None, None, None, None, 1.0, 1, 1, 1)], SCHEMA)
    got = found_manifest(one)
    assert got == brute_manifest(one)
    assert got[0][1] == got[0][3] == sha("-----") and got[0][4] == sha("")   # a lone leaf is the root, with no siblings


def test_manifest_of_a_hot_source_with_many_blocks(spark):
    """Three stages of blocks in one source, block edges (256, 257, 4096 and 1 digests), null source, many sources."""
    def rows(n, source, at):
        return spark.range(at, at + n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"), F.lit("en").alias("lang"),
                                              F.lit(source).cast("string").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    docs = rows(66_000, "hot", 0)
    for k, (n, s) in enumerate([(256, "b"), (257, None), (4096, "é"), (1, "z"), (16, "B"), (17, "")]):
        docs = docs.union(rows(n, s, 100_000 * (k + 1)))
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"),
                                   F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(None).cast("long").alias("n_chars"))
    docs = docs.union(many)
    assert found_manifest(docs) == brute_manifest(docs)


def brute_repeats(docs, length):
    rows = [(r.doc_id, [w.decode() for w in (r.text or "").encode().split()]) for r in docs.collect()]
    seen = {}
    for k, (_, w) in enumerate(rows):
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i:i + length]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + length))
    return sorted(((d, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (d, w), g in zip(rows, gone)), key=str)


def found_repeats(docs, length):
    out = substring_dedup.remove_repeats(docs, length).collect()
    for r in out:
        assert sum(x.length for x in r.repeats) == r.n_removed and all(x.length >= length for x in r.repeats)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out), key=str)


def test_repeats_equal_brute_force(spark, odd, nothing, small):  # noqa: F811
    for docs, length in ((odd, 10), (odd, 35), (small, 35)):
        assert found_repeats(docs, length) == brute_repeats(docs, length)
    assert substring_dedup.remove_repeats(nothing).collect() == []


def test_repeats_of_few_words_periods_and_shared_passages(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b"], n)) for n in rng.integers(0, 60, 60)]          # many partial overlaps
    texts += ["x " * 40, "x y " * 30, "p q r " * 20, "x " * 11]                              # periodic: windows repeat in one text
    common = " ".join(f"c{i}" for i in range(14))
    texts += [f"left{i} more{i} {common} right{i}" for i in range(80)]                      # one passage, 80 different surroundings
    texts += [f"{common} only{i}" for i in range(20)] + [f"only{i} {common}" for i in range(20)] + [common] * 30
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    for length in (9, 10, 12, 20):
        assert found_repeats(docs, length) == brute_repeats(docs, length)


def test_hot_keys_go_another_way_with_the_same_result(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    wanted = sorted((r.k, r.id, 0 if r.k is None else 1 if r.k == 7 else r.id) for r in rows.collect() if r.k is not None)
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(ranges, "HOT_KEYS", 10)
    got = ranges.join_by_count(rows, keyed, ["k"], "n").collect()
    assert len(got) == 3000 and sorted(tuple(r) for r in got if r.k is not None) == wanted
    assert ranges.join_by_count(rows, keyed.where("k = 7 or k is null"), ["k"], "n", "left_semi").count() == 2000


def brute_codes(rows, entries, rounds):
    kept = sorted(((r.vec_id is None, r.vec_id or 0, list(r.embedding)), r) for r in rows
                  if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding))
    if not kept or len(kept[0][1].embedding) % 4:
        return []
    width = len(kept[0][1].embedding)
    kept = [r for _, r in kept if len(r.embedding) == width]
    whole = [[int(np.floor(1024 * float(x))) for x in r.embedding] for r in kept]
    q = width // 4
    parts = [[w[k * q:(k + 1) * q] for w in whole] for k in range(4)]
    books = [p[:entries] for p in parts]

    def near(k, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[k]))
    for _ in range(rounds):
        moved = []
        for k in range(4):
            given = {}
            for v in parts[k]:
                given.setdefault(near(k, v)[1], []).append(v)
            moved.append([[sum(c) // len(given[i]) for c in zip(*given[i])] if i in given else e for i, e in enumerate(books[k])])
        books = moved
    found = [[near(k, parts[k][i]) for k in range(4)] for i in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r.label] = labels.get(r.label, 0) + e
    mark = sha(",".join(str(c) for b in books for e in b for c in e))
    return sorted(((r.vec_id, "".join(f"{i:02x}" for _, i in f), e, labels[r.label], mark) for r, f, e in zip(kept, found, errors)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, error long, codes string, n long"


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist(), int(i % 3) or None, 1, "x", 2) for i in range(120)]     # coarse: many ties
    rows += [(200 + i, [0.5] * 8, 1, 1, "x", 2) for i in range(60)]                                           # a third are equal
    odd = [(None, [0.25] * 8, 1), (3, [1.0] * 8, 5), (3, [1.0] * 8, 5), (300, None, 1), (301, [], 1), (302, [1.0] * 4, 1), (303, [None] + [1.0] * 7, 1),
           (304, [float("nan")] * 8, 1), (305, [float("inf")] + [0.0] * 7, 1), (306, [-0.0001] * 8, None)]
    rows += [(*r, 1, "x", 2) for r in odd]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
    for entries in (256, 20):
        got = sorted((tuple(r) for r in vector_codes.compress(vectors, entries=entries).collect()), key=str)
        assert got == brute_codes(vectors.collect(), entries, 4)
    assert vector_codes.compress(vectors.limit(0)).collect() == []
    uneven = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, 1, "x", 2)], VECTORS)
    assert vector_codes.compress(uneven).collect() == []
    with pytest.raises(Exception, match="in magnitude"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1, 1, "x", 2)], VECTORS)).collect()


@pytest.mark.parametrize("scale", [3, 1000, 8_000_000])
def test_gnat_equals_all_comparisons(scale):
    rng = np.random.default_rng(scale)
    centres = rng.integers(-scale, scale + 1, (12, 6))
    points = (centres[rng.integers(0, 12, 700)] + rng.integers(-2, 3, (700, 6))).clip(-(2 ** 23), 2 ** 23)
    entries, queries = points[:256], points[100:]
    tree = vector_codes.Gnat(entries)
    d2, index = tree.nearest(queries)
    every = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
    assert (d2 == every.min(1)).all() and (index == every.argmin(1)).all()
    assert scale < 1000 or tree.compared < 0.7 * every.size   # whole subtrees are dropped where points cluster
    same = vector_codes.Gnat(np.zeros((50, 3), np.int64)).nearest(np.ones((4, 3), np.int64))
    assert (same[0] == 3).all() and (same[1] == 0).all()

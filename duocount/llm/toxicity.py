"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences (cut at ``.``, ``!``, ``?`` and line ends). A sentence's probability is
a sigmoid of a constant and the weights of its distinct words; the document's is their noisy-or,
``1 - prod(1 - p)``. Weights are learnt from document labels alone, by full-batch Adam on the bag
likelihood, and the same sentence probabilities then locate the offending sentences.

The training sample is bounded by ``sample_rows`` rows of either label, chosen by a hash of their id;
words seen in fewer than ``MIN_DOCS`` sampled documents have no weight. Every document is scored whole.

Defined results: null text counts as empty; a text without words scores as one sentence without words
(the constant alone); ties and repeated rows are scored row by row; a null id is scored but never
sampled; clashing columns of the documents are not read; without ``MIN_ROWS`` rows of both labels every
score is the share of label 1 (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.llm.batches import small_batches, tidy
from duocount.llm.words import _hash_spans, buffers, mix, shingles, slices, spans

MIN_ROWS, MIN_DOCS, MIN_Z = 20, 4, 4.5
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_EDGE = np.zeros(256, dtype=bool)  # ASCII punctuation around a word is not part of it
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


class Bags(NamedTuple):
    """Sentences of some rows: word hashes, first word of each sentence, first sentence of each row
    (a row has at least one), and the byte range of each sentence in its row."""

    words: np.ndarray
    first_word: np.ndarray
    first_sentence: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    low, starts, ends, row = spans(data, offsets)
    n_rows = len(offsets) - 1
    # punctuation is taken off both ends, a character at a time while any is left
    a, b = starts.copy(), ends.copy()
    live = np.arange(len(a))
    while len(live):
        live = live[(a[live] < b[live]) & _EDGE[low[np.minimum(a[live], len(low) - 1)]]]
        a[live] += 1
    live = np.arange(len(a))
    while len(live):
        live = live[(a[live] < b[live]) & _EDGE[low[b[live] - 1]]]
        b[live] -= 1
    owner = np.repeat(np.arange(n_rows), np.diff(row))
    stops = np.concatenate([[0], np.cumsum(_STOP[low])])
    # a sentence changes where a stop lies between the end of a word's letters and the next word
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (stops[a[1:]] > stops[np.minimum(b[:-1], a[1:])]) | (owner[1:] != owner[:-1])
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    keep = b > a
    words, sentence_of = _hash_spans(low, a[keep], b[keep]), sentence[keep]
    s_owner = owner[heads]
    bare = np.setdiff1d(np.arange(n_rows), s_owner)  # rows without words: one empty sentence each
    all_owner = np.concatenate([s_owner, bare])
    order = np.argsort(all_owner, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word_at = rank[sentence_of]
    tails = np.append(heads[1:], len(starts)) - 1 if len(heads) else heads
    begin = np.concatenate([starts[heads], offsets[bare]])[order]
    end = np.concatenate([ends[tails], offsets[bare]])[order]
    own = all_owner[order]
    return Bags(words, np.searchsorted(word_at, np.arange(len(order) + 1)),
                np.searchsorted(own, np.arange(n_rows + 1)), begin - offsets[own], end - offsets[own])


class Model(NamedTuple):
    """Sorted word hashes, their weights, the constant; ``share`` is the score without a model."""

    words: np.ndarray
    weights: np.ndarray
    constant: float
    share: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's words once."""
    sentence = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((word, sentence))
    w, s = word[order], sentence[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
    return w[new], np.searchsorted(s[new], np.arange(len(first)))


def sentence_scores(bag: Bags, model: Model) -> np.ndarray:
    if not len(model.words):
        return np.full(len(bag.begin), model.share)
    at = np.minimum(np.searchsorted(model.words, bag.words), len(model.words) - 1)
    known = model.words[at] == bag.words
    sentence = np.repeat(np.arange(len(bag.begin)), np.diff(bag.first_word))[known]
    word, first = _distinct(at[known], np.searchsorted(sentence, np.arange(len(bag.begin) + 1)))
    return _sigmoid(_segment_sum(model.weights[word], first) + model.constant)


def noisy_or(p: np.ndarray, first_sentence: np.ndarray) -> np.ndarray:
    return -np.expm1(_segment_sum(np.log1p(-np.minimum(p, 1 - 1e-12)), first_sentence))


def fit(bag: Bags, label: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Weights from bags and their labels; without a word that tells them apart, the share of label 1."""
    share = float(label.mean()) if len(label) else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, share)
    if min(int(label.sum()), int((1 - label).sum())) < MIN_ROWS:
        return none
    n_sentences = len(bag.begin)
    doc_of = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(bag.first_sentence))
    ones, zeros = int(label.sum()), int((1 - label).sum())
    by_label = []  # words and their documents, for either label
    for y in (0, 1):
        each = [np.unique(bag.words[bag.first_word[bag.first_sentence[r]]:bag.first_word[bag.first_sentence[r + 1]]])
                for r in np.flatnonzero(label == y)]
        by_label.append(np.unique(np.concatenate(each), return_counts=True))
    seen = np.union1d(by_label[0][0], by_label[1][0])
    in_zero, in_one = np.zeros(len(seen)), np.zeros(len(seen))
    for counts, (words, n) in zip((in_zero, in_one), by_label):
        counts[np.searchsorted(seen, words)] = n
    in_any = in_zero + in_one
    rate_any = in_any / len(label)
    error = np.sqrt(np.maximum(rate_any * (1 - rate_any), 1e-12) * (1 / ones + 1 / zeros))
    kept = seen[(in_any >= MIN_DOCS) & (np.abs(in_one / ones - in_zero / zeros) / error >= MIN_Z)]
    if not len(kept):
        return none
    place = np.minimum(np.searchsorted(kept, bag.words), len(kept) - 1).astype(np.int32)
    use = kept[place] == bag.words
    sentence = np.repeat(np.arange(n_sentences, dtype=np.int32), np.diff(bag.first_word))[use]
    word, first = _distinct(place[use], np.searchsorted(sentence, np.arange(n_sentences + 1)))
    where = np.repeat(np.arange(n_sentences), np.diff(first))
    w, c = np.zeros(len(kept)), -4.0
    m, s = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    for t in range(1, steps + 1):
        p = np.minimum(_sigmoid(_segment_sum(w[word], first) + c), 1 - 1e-9)
        none_of = np.exp(np.clip(_segment_sum(np.log1p(-p), bag.first_sentence), -50, -1e-9))
        # d(-log likelihood)/dz = p for label 0, -p * prod(1 - p) / (1 - prod(1 - p)) for label 1
        factor = weight * np.where(label == 1, -none_of / (1 - none_of), 1.0)
        g = p * factor[doc_of]
        grad = np.append(np.bincount(word, weights=g[where], minlength=len(kept)) + ridge * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-9)
        w, c = w - step[:-1], c - step[-1]
    return Model(kept, w, float(c), share)


def _without_copies(rows: list) -> list:
    """The rows that are the first with either of their two MinHashes."""
    seen: tuple[set, set] = (set(), set())
    kept = []
    for r in rows:
        words = np.frombuffer(bytes(r["words"]), np.uint64)
        sets, _ = shingles(words, np.array([0, len(words)]), 5)
        marks = [int(x.min()) if len(x) else -1 for x in (sets, mix(sets ^ np.uint64(1)))]
        if all(m not in s for m, s in zip(marks, seen)):
            kept.append(r)
        for m, s in zip(marks, seen):
            s.add(m)
    return kept


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model:
    """Fit on at most ``sample_rows`` rows of either label; ``labels`` has ``doc_id`` and ``label``
    (0 or 1, others left out). Only hashes of the sampled rows' words come to the driver."""
    lab = (labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
           .where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")))
    chosen = None
    for y in (0, 1):
        some = lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    source = small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sample = source.join(F.broadcast(chosen), "id").select("id", "y", "text")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                bag = bags(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                words, size = [], []
                for r in range(b - a):
                    s, e = bag.first_sentence[r], bag.first_sentence[r + 1]
                    words.append(bag.words[bag.first_word[s]:bag.first_word[e]].tobytes())
                    size.append(np.diff(bag.first_word[s:e + 1]).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], batch.column("y")[a:b],
                                                  pa.array(words, pa.binary()), pa.array(size, pa.binary())],
                                                 names=["id", "y", "words", "sizes"])

    rows = sorted(sample.mapInArrow(tidy(shrink), "id long, y int, words binary, sizes binary").collect(),
                  key=lambda r: (r["id"], r["words"]))  # at most 2 * sample_rows rows and their repeats
    rows = _without_copies(rows)
    words = np.frombuffer(b"".join(bytes(r["words"]) for r in rows), np.uint64)
    sizes = [np.frombuffer(bytes(r["sizes"]), "<i4") for r in rows]
    first_word = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64) if sizes else np.zeros(1, np.int64)
    first_sentence = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(np.int64)
    label = np.array([r["y"] for r in rows], dtype=np.int64)
    del rows, sizes
    blank = np.zeros(first_sentence[-1], np.int64)
    return fit(Bags(words, first_word, first_sentence, blank, blank), label)


def score(docs: DataFrame, model: Model, mark: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``score`` and ``sentences``: (start, length, score) in UTF-8 bytes of each sentence of
    ``mark`` or more, in text order."""
    source = small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                bag = bags(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                p = sentence_scores(bag, model)
                # without a model the share is the document's score
                total = noisy_or(p, bag.first_sentence) if len(model.words) else np.full(b - a, model.share)
                hit = np.flatnonzero(p >= mark)
                spot = pa.StructArray.from_arrays([pa.array(bag.begin[hit]), pa.array((bag.end - bag.begin)[hit]), pa.array(p[hit])],
                                                  fields=list(span))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, bag.first_sentence).astype(np.int32)), spot)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(total), lists],
                                                 names=["doc_id", "score", "sentences"])

    return source.mapInArrow(tidy(run), "doc_id long, score double, sentences array<struct<start:long,length:long,score:double>>")

"""Operator 9: quality by positive-unlabelled learning.

Trusted positives and unlabelled web text train a scorer by the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

(logistic loss; when the second term falls below zero the step goes against it), with the class prior
``pi`` estimated from the two samples: for every set A, share_u(A) >= pi * share_p(A), so the least
ratio over upper score ranges estimates it; its lower confidence limit is used. Label 0 is never read.

A text becomes ``FEATURES`` shares and counts made in numpy from its bytes and words; each is cut at
quantiles of the training sample into one-hot bins, and the scorer is linear in the bins. Nothing but
the text enters a score.

The training sample is bounded by ``sample_rows`` positives and twice as many unlabelled rows, chosen
by a hash of their id; every document is scored. Features are made in one scan and written once as a
narrow table, which sampling and scoring read.

Defined results: null text counts as empty; empty texts are scored like any other; repeated rows give
repeated rows; a null id is scored but never sampled; clashing columns of the documents are not read;
without a usable sample (fewer than ``MIN_ROWS`` positives or unlabelled rows) every score is 0.5; an
empty table gives an empty result.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.llm.batches import small_batches, tidy
from duocount.llm.words import _hash_spans, buffers, mix, shingles, slices, spans
from duocount.session import cut_lineage

FEATURES = ("log_words", "word_bytes", "upper", "symbols", "bangs", "digits", "stops", "wide", "lines", "distinct",
            "top_word", "repeated_3", "repeated_lines", "short_words", "long_words", "stop_ends", "odd_ends", "same_next")
MIN_ROWS = 20
BINS = 16

_KIND = np.zeros((7, 256), dtype=bool)  # byte classes
_KIND[0, ord("A"):ord("Z") + 1] = True
_KIND[1, [ord(c) for c in "#*$%&|<>"]] = True
_KIND[2, ord("!")] = True
_KIND[3, ord("0"):ord("9") + 1] = True
_KIND[4, [ord(c) for c in ".,;:?"]] = True
_KIND[5, 128:] = True
_KIND[6, ord("\n")] = True


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: distinct values, the most frequent value's count, values that occur more than once."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(v)))
    owner = r[at]
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, owner, size)
    return (np.bincount(owner, minlength=len(n)), top,
            np.bincount(owner, weights=np.where(size > 1, size, 0), minlength=len(n)))


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, float32 matrix rows x FEATURES) for each slice of a column."""
    data, offsets = buffers(col)
    for a, b in slices(offsets):
        raw, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        kind = [_per_row(k[raw], off) for k in _KIND]
        n_bytes = np.maximum(np.diff(off), 1)
        low, starts, ends, row = spans(raw, off)
        words = _hash_spans(low, starts, ends)
        n = np.diff(row)
        per = np.maximum(n, 1)
        size = ends - starts
        distinct, top, _ = _repeats(words, row)
        three, first3 = shingles(words, row, 3)
        repeated = _repeats(three, first3)[2]
        last = low[ends - 1] if len(ends) else low[:0]
        same = np.zeros(len(words), dtype=bool)
        same[1:] = words[1:] == words[:-1]
        same[row[:-1][n > 0]] = False
        # lines: sum of word hashes by line, blank lines left out
        breaks = np.concatenate([[0], np.cumsum(raw == ord("\n"))])
        line = breaks[starts] + np.repeat(np.arange(len(n)), n)  # a row boundary also ends a line
        begin = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
        place = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words))))
        lines = np.add.reduceat(mix(words + place.astype(np.uint64)), begin) if len(begin) else words[:0]
        first_line = np.searchsorted(begin, row)
        n_lines = np.maximum(np.diff(first_line), 1)
        repeated_lines = np.diff(first_line) - _repeats(lines, first_line)[0]
        yield a, b, np.column_stack([
            np.log1p(n), _per_row(size, row) / per, kind[0] / n_bytes, kind[1] / n_bytes, kind[2] / n_bytes,
            kind[3] / n_bytes, kind[4] / n_bytes, kind[5] / n_bytes, kind[6] / n_bytes, distinct / per, top / per,
            repeated / per, repeated_lines / n_lines, _per_row(size <= 2, row) / per, _per_row(size >= 13, row) / per,
            _per_row(_KIND[4][last], row) / per, _per_row(_KIND[1][last] | _KIND[2][last], row) / per,
            _per_row(same, row) / per]).astype(np.float32)


class Scorer(NamedTuple):
    """Bin edges by feature (rows x BINS - 1) and one weight a bin, the last one the constant."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") + j * (len(e) + 1)
                                for j, e in enumerate(self.edges)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1) + self.weights[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows from their scores: the least share_u / share_p over
    upper score ranges, less the sampling error of both. The low side is the safe one: with too high a
    prior the corrected risk rewards ever larger scores of the positives."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 37))
    p = 1.0 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    u = 1.0 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(40.0) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    return float(np.clip(np.min(u / p) * (1 - slack) / (1 + slack), 0.01, 0.99))


def _descend(hot_p: np.ndarray, hot_u: np.ndarray, size: int, prior: float | None, steps: int, rate: float,
             ridge: float) -> np.ndarray:
    """Weights by Adam on the non-negative risk; without a prior, plain positive against unlabelled."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    pi = 0.5 if prior is None else prior

    def pull(hot: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(hot.ravel(), weights=np.repeat(g, hot.shape[1]), minlength=size + 1)
        out[-1] = g.sum()
        return out

    for t in range(1, steps + 1):
        zp, zu = w[hot_p].sum(axis=1) + w[-1], w[hot_u].sum(axis=1) + w[-1]
        toward = pull(hot_p, -_sigmoid(-zp)) / len(zp)
        if prior is None:
            grad = 0.5 * toward + 0.5 * pull(hot_u, _sigmoid(zu)) / len(zu)
        else:
            negative = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
            away = pull(hot_u, _sigmoid(zu)) / len(zu) - pi * pull(hot_p, _sigmoid(zp)) / len(zp)
            grad = pi * toward + away if negative >= 0 else -away
        grad = grad + ridge * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05,
        ridge: float = 3e-5) -> Scorer | None:
    """A scorer from two feature matrices; None if either is too small."""
    if min(len(positive), len(unlabelled)) < MIN_ROWS:
        return None
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    blank = Scorer(edges, np.zeros(BINS * len(FEATURES) + 1), 0.5)
    hot_p, hot_u = blank.bins(positive), blank.bins(unlabelled)
    size = BINS * len(FEATURES)
    ridge = max(ridge, 1.0 / len(both))
    half = []  # for the prior, either half is scored by what the other half teaches
    for one in (0, 1):
        rough = _descend(hot_p[1 - one::2], hot_u[1 - one::2], size, None, steps // 2, rate, ridge)
        half.append([rough[h[one::2]].sum(axis=1) for h in (hot_p, hot_u)])
    prior = float(np.mean([estimate_prior(*h) for h in half]))
    return Scorer(edges, _descend(hot_p, hot_u, size, prior, steps, rate, ridge), prior)


def _matrix(rows) -> np.ndarray:
    return np.array([r["x"] for r in rows], dtype=np.float32).reshape(-1, len(FEATURES))


def feature_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the feature vector ``x`` of every row, written once."""
    source = small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in features(batch.column(1)):
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], flat], names=["doc_id", "x"])

    return cut_lineage(source.mapInArrow(tidy(make), "doc_id long, x array<float>"), "quality-features")


def _chosen(ids: DataFrame, rows: int) -> DataFrame:
    return ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _collected(table: DataFrame, chosen: DataFrame) -> np.ndarray:
    found = table.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"))
    return _matrix(found.orderBy("doc_id").collect())  # at most the chosen rows, short vectors


def train(table: DataFrame, positives: DataFrame, unlabelled: DataFrame, sample_rows: int = 20_000) -> Scorer | None:
    """Fit on at most ``sample_rows`` positive and 2 * ``sample_rows`` unlabelled rows of a feature
    table. ``positives`` and ``unlabelled`` hold the doc_ids of either; the least hashes are taken."""
    return fit(_collected(table, _chosen(positives, sample_rows)), _collected(table, _chosen(unlabelled, 2 * sample_rows)))


def train_on_texts(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, sample_rows: int = 20_000,
                   doc_id: str = "doc_id", text: str = "text") -> Scorer | None:
    """The same fit, making features of the sampled documents only."""
    chosen = cut_lineage(_chosen(positives, sample_rows).withColumn("kind", F.lit(1)).union(
        _chosen(unlabelled, 2 * sample_rows).withColumn("kind", F.lit(0))), "quality-sample")
    some = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    table = feature_table(some)
    return fit(*[_collected(table, chosen.where(F.col("kind") == kind).select("doc_id")) for kind in (1, 0)])


def keep_good(docs: DataFrame, scorer: Scorer | None, threshold: float, text: str = "text") -> DataFrame:
    """The documents scoring ``threshold`` or more, with their columns; all without a scorer."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            if scorer is not None:
                for a, b, x in features(batch.column(at)):
                    good[a:b] = _sigmoid(scorer.logit(x)) >= threshold
            yield batch.filter(pa.array(good))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def score(table: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id and ``score`` of every row of a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = np.full(len(x), 0.5) if scorer is None else _sigmoid(scorer.logit(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return table.mapInArrow(tidy(run), "doc_id long, score double")

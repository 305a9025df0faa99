"""Operator 6: language-model scores by masked pseudo-likelihood.

A bidirectional window network predicts every token of a text from the ``WINDOW`` tokens on either
side of it, and a document's score is the sum of these conditional log-probabilities:

    hidden = relu(sum over places of embedding[place][token] + bias)
    P(token) = softmax(hidden . class weights) * softmax(hidden . member weights of the class)

Tokens are the most frequent words of the whole corpus, other words sharing hash buckets; the
vocabulary has CLASSES * MEMBERS entries. It is counted over all documents. Training covers every
document and every position: each of the ``ROUNDS`` rounds visits every ``STRIDE``-th position of every
text, counted from the text's start (with STRIDE = 1, all of them), each task trains from the round's weights on its own
positions, and the tasks' weights are averaged by token count in two grouped steps, so the work and what
is gathered grow with the corpus while the weights keep their size (about half a MB). Scoring predicts
every token of every text.

Defined results: null text counts as empty; a text without words has score 0, no tokens and a null
mean; ties and repeated rows are scored row by row; places before the start and after the end hold a
token of their own; clashing columns of the documents are not read; an empty table gives an empty
result. Long texts are scored whole, in blocks of positions.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.llm.batches import small_batches, tidy
from duocount.llm.words import buffers, slices, word_hashes
from duocount.session import cut_lineage

CLASSES, MEMBERS, HIDDEN, WINDOW = 32, 32, 24, 2
TOKENS = CLASSES * MEMBERS
FREQUENT = TOKENS - 64  # the rest are buckets of the other words
EDGE = TOKENS  # the token beyond either end of a text
STRIDE, ROUNDS, BATCH, BLOCK = 1, 2, 2048, 65536
PIECE = 8192  # positions scored at a time, small enough for the processor's caches
CHUNKS, FAN_IN = 16, 64
SHAPES = {"embedding": (2 * WINDOW, TOKENS + 1, HIDDEN), "bias": (HIDDEN,), "cls": (HIDDEN, CLASSES),
          "cls_bias": (CLASSES,), "member": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}
_HEAD = np.uint64(48)  # a hash without its first 16 bits
_PLACES = [p for p in range(-WINDOW, WINDOW + 1) if p]
_TABLES = (np.arange(2 * WINDOW) * (TOKENS + 1)).astype(np.int16)[:, None]  # first row of each place's embedding


class Network:
    """The weights as views of one flat float32 array."""

    def __init__(self, flat: np.ndarray | None = None):
        size = sum(int(np.prod(s)) for s in SHAPES.values())
        if flat is None:
            flat = np.random.default_rng(11).normal(0, 0.05, size).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n
        self.rows, self.rest = self.embedding.reshape(-1, HIDDEN), flat[self.embedding.size:]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.embedding[0].take(context[0], axis=0)
        total += self.bias
        for place in range(1, len(context)):
            total += self.embedding[place].take(context[place], axis=0)
        return np.maximum(total, 0, out=total)

    def log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        out = np.empty(len(token))
        for k in range(0, len(token), PIECE):
            out[k:k + PIECE] = self._log_probability(context[:, k:k + PIECE], token[k:k + PIECE])
        return out

    def _log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        h = self.hidden(context)
        cls, member, order, cut = _by_class(token)
        out = _picked(self.class_scores(h), cls).astype(np.float64)
        z, _ = self.member_scores(h.take(order, axis=0), cls.take(order), cut)
        out[order] += _picked(z, member.take(order))
        return out

    def class_scores(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.cls
        z += self.cls_bias
        return z

    def member_scores(self, h: np.ndarray, cls: np.ndarray, cut: list) -> tuple[np.ndarray, list]:
        """Scores of the members of each row's class, rows in order of their class; the classes that have rows."""
        z = np.empty((len(h), MEMBERS), np.float32)
        present = [(c, i, j) for c, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j]
        for c, i, j in present:
            np.matmul(h[i:j], self.member[c], out=z[i:j])
        z += self.member_bias.take(cls, axis=0)
        return z, present


class Trainer:
    """Adagrad steps on a network of its own, from ``flat``."""

    def __init__(self, flat: np.ndarray):
        self.net = Network(flat.copy())
        self.memory = Network(np.full_like(flat, 1e-8))   # squared gradients so far
        self.gradient = Network(np.zeros_like(flat))

    def learn(self, context: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One step on a batch."""
        n, net, gradient = len(token), self.net, self.gradient
        gradient.rest.fill(0)
        h = net.hidden(context)
        cls, member, order, cut = _by_class(token)
        p = _less_target(net.class_scores(h), cls)
        np.matmul(h.T, p, out=gradient.cls)
        np.add.reduce(p, axis=0, out=gradient.cls_bias)
        back = p @ net.cls.T
        sorted_h = h.take(order, axis=0)
        z, present = net.member_scores(sorted_h, cls.take(order), cut)
        q = _less_target(z, member.take(order))
        own = np.empty_like(sorted_h)
        for c, i, j in present:
            part = q[i:j]
            np.matmul(sorted_h[i:j].T, part, out=gradient.member[c])
            np.add.reduce(part, axis=0, out=gradient.member_bias[c])
            np.matmul(part, net.member[c].T, out=own[i:j])
        unsorted = np.empty_like(order)
        unsorted[order] = np.arange(n)
        back += own.take(unsorted, axis=0)
        back *= h > 0
        np.add.reduce(back, axis=0, out=gradient.bias)
        _adagrad(net.rest, self.memory.rest, gradient.rest, n, rate)
        # of the embeddings only the rows of words in the batch have a gradient
        words = (context + _TABLES).ravel()
        order = np.argsort(words, kind="stable")
        words = words.take(order)
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        g = np.add.reduceat(back.take(np.tile(np.arange(n), len(context)).take(order), axis=0), first)
        words = words.take(first)
        w, m = net.rows.take(words, axis=0), self.memory.rows.take(words, axis=0)
        _adagrad(w, m, g, n, rate)
        net.rows[words], self.memory.rows[words] = w, m


def _adagrad(weights: np.ndarray, memory: np.ndarray, g: np.ndarray, n: int, rate: float) -> None:
    """Move ``weights`` against the summed gradient ``g`` (overwritten) of ``n`` tokens."""
    g /= n
    s = g * g
    memory += s
    np.sqrt(memory, out=s)
    s += 1e-6
    g *= rate
    g /= s
    weights -= g


def _by_class(token: np.ndarray):
    """(class, member) of each token, the order by class and where each class begins in it."""
    cls, member = token // MEMBERS, token % MEMBERS
    order = np.argsort(cls.astype(np.int16), kind="stable")
    return cls, member, order, np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))]).tolist()


def _less_largest(z: np.ndarray) -> None:
    """Subtract from each row of ``z`` its largest value."""
    top = z
    while top.shape[1] % 16 == 0:   # halves against each other, then columns: much faster than max() over short rows
        half = top.shape[1] // 2
        top = np.maximum(top[:, :half], top[:, half:])
    z -= np.ascontiguousarray(top.T).max(axis=0)[:, None]


def _picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row of ``z`` (overwritten) at its column ``at``."""
    _less_largest(z)
    here = z[np.arange(len(z)), at]
    return here - np.log(np.exp(z, out=z).sum(axis=1))


def _less_target(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The softmax of each row of ``z`` (overwritten), less one at its column ``at``."""
    _less_largest(z)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    np.exp(z, out=z)
    z[np.arange(len(z)), at] -= 1
    return z


class Vocabulary:
    """Frequent words' hashes in sorted order and their tokens (by falling frequency)."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.token = hashes[order], order.astype(np.int32)
        # by the first bits of a hash: where its hashes begin, and the most that share them
        heads = (self.hashes >> _HEAD).astype(np.int64)
        self.begin = np.searchsorted(heads, np.arange(1 << (64 - int(_HEAD)))).astype(np.int32)
        self.most = int(np.bincount(heads).max()) if len(heads) else 0

    def tokens(self, words: np.ndarray) -> np.ndarray:
        found = (FREQUENT + (words % np.uint64(TOKENS - FREQUENT)).astype(np.int64)).astype(np.int32)
        if not len(self.hashes):
            return found
        begin = self.begin.take((words >> _HEAD).astype(np.int64))
        for step in range(self.most):
            at = np.minimum(begin + step, len(self.hashes) - 1)
            met = np.flatnonzero(self.hashes.take(at) == words)
            found[met] = self.token.take(at.take(met))
        return found


class Windows:
    """The window tokens and the token itself of every position of a slice, one row a position: its texts laid out with
    WINDOW places of EDGE around each."""

    def __init__(self, tokens: np.ndarray, row: np.ndarray):
        size = np.diff(row)
        place = np.arange(len(tokens)) + np.repeat(WINDOW * np.arange(1, len(size) + 1), size)
        laid = np.full(len(tokens) + WINDOW * (len(size) + 1), EDGE, np.int16)
        laid[place] = tokens
        self.table = np.empty((len(tokens), len(_PLACES) + 1), np.int16)
        for k, p in enumerate([*_PLACES, 0]):
            self.table[:, k] = laid.take(place + p)

    def __call__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The window tokens (places x positions) and the tokens of positions ``at``."""
        columns = np.ascontiguousarray(self.table.take(at, axis=0).T)
        return columns[:-1], columns[-1]


def contexts(tokens: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The window tokens of positions ``at`` (places x positions); EDGE outside the text."""
    return Windows(tokens, row)(at)[0]


def targets(row: np.ndarray, turn: int, stride: int = STRIDE) -> np.ndarray:
    """The positions that round ``turn`` predicts: every ``stride``-th of each text, from another start each round."""
    place = np.arange(row[-1]) - np.repeat(row[:-1], np.diff(row))
    return np.flatnonzero(place % stride == (turn * 7) % stride)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _slices(batch: pa.RecordBatch):
    data, offsets = buffers(batch.column(1))
    for a, b in slices(offsets):
        yield a, b, *word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Vocabulary:
    """The FREQUENT most frequent words of all documents (ties by hash)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, _ in _slices(batch):
                seen, n = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    top = (_texts(docs, doc_id, text).mapInArrow(tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(FREQUENT).collect())
    return Vocabulary(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64))


def _mean_weights(parts: DataFrame) -> np.ndarray | None:
    """The average by token count of (part, chunk, weights, n) rows, first over FAN_IN tasks, then
    over those sums."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w.as_py(), np.float64) for w in table.column("weights"))
        return pa.table({"part": table.column("part")[:1], "chunk": table.column("chunk")[:1],
                         "weights": pa.array([total.tobytes()], pa.binary()),
                         "n": pa.array([pc.sum(table.column("n")).as_py()], pa.int64())})

    schema = "part int, chunk int, weights binary, n long"
    once = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("part", "chunk").applyInArrow(add, schema)
    rows = once.groupBy("chunk").applyInArrow(add, schema).orderBy("chunk").collect()  # one network
    if not rows or not rows[0]["n"]:
        return None
    return np.concatenate([np.frombuffer(bytes(r["weights"])) / r["n"] for r in rows]).astype(np.float32)


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, stride: int = STRIDE, rate: float = 0.1,
          doc_id: str = "doc_id", text: str = "text") -> Network:
    net = Network()
    for turn in range(rounds):
        start = net.flat

        def fit(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            own, n = Trainer(start), 0
            for batch in batches:
                for _, _, words, row in _slices(batch):
                    tokens = vocab.tokens(words)
                    at = targets(row, turn, stride)
                    at = at[np.random.default_rng(len(tokens)).permutation(len(at))]
                    around = Windows(tokens, row)
                    for k in range(0, len(at), BATCH):
                        own.learn(*around(at[k:k + BATCH]), rate)
                    n += len(at)
            part = TaskContext.get().partitionId()
            chunks = np.array_split(own.net.flat.astype(np.float64) * n, CHUNKS)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()),
                     pa.array([c.tobytes() for c in chunks], pa.binary()), pa.array([n] * CHUNKS, pa.int64())],
                    names=["part", "chunk", "weights", "n"])

        made = _texts(docs, doc_id, text).mapInArrow(tidy(fit), "part int, chunk int, weights binary, n long")
        flat = _mean_weights(cut_lineage(made, "lm-weights"))
        if flat is None:
            return net
        net = Network(flat)
    return net


def score(docs: DataFrame, vocab: Vocabulary, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``n_tokens``, ``log_probability`` (summed over all tokens) and its mean."""
    flat = net.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(flat)
        for batch in batches:
            for a, b, words, row in _slices(batch):
                tokens = vocab.tokens(words)
                each, around = np.empty(len(tokens)), Windows(tokens, row)
                for k in range(0, len(tokens), BLOCK):
                    at = np.arange(k, min(k + BLOCK, len(tokens)))
                    each[k:k + BLOCK] = own.log_probability(*around(at))
                total = np.concatenate([[0.0], np.cumsum(each)])
                total, n = total[row[1:]] - total[row[:-1]], np.diff(row)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n.astype(np.int64)), pa.array(total), mean],
                                                 names=["doc_id", "n_tokens", "log_probability", "mean_log_probability"])

    return _texts(docs, doc_id, text).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, log_probability double, mean_log_probability double")

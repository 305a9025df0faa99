"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

The count of a text is its number of initial symbols minus the number of merges; no identifiers are
made. Symbols are characters; a heap holds the adjacent pairs that form a vocabulary piece, keyed by
(rank, position); the lowest is popped, its two symbols become one in a doubly linked list, and the two
new neighbouring pairs are pushed. Stale heap entries are known by their symbol lengths. A character
that is no piece counts as its UTF-8 bytes (byte fallback) or as one unknown symbol.

Merges cannot cross a character that occurs in no longer piece, nor the start of a run of word marks
when no piece has a mark after another character; the text is cut there and the counts of the parts
are kept in a bounded per-worker cache, which changes speed only.

Defined results: null text counts as empty; an empty text has 0 tokens; rows are never merged, so ties
and repeated rows give repeated rows; other columns are kept, and ones named like an output column are
replaced by it; an empty table gives an empty table. Text length is unlimited: memory is proportional
to the longest part between cuts.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.llm.batches import cached_for_tasks, small_batches, tidy

MARK = "▁"
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64


class PieceVocabulary:
    """Ranks and normalisation of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.byte_fallback = any(sp.is_byte(i) for i in ids)
        usable = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        level = {score: r for r, score in enumerate(sorted({-sp.get_score(i) for i in usable}))}
        self.rank = {sp.id_to_piece(i): level[-sp.get_score(i)] for i in usable}  # equal scores share a rank
        longer = [p for p in self.rank if len(p) > 1]
        self.joining = set("".join(longer))
        self.marks_lead = not any(re.search(f"[^{MARK}]{MARK}", p) for p in longer)

    def normalise(self, text: str) -> str:
        return self.library.normalize(text)

    def base_cost(self, char: str) -> int:
        """Tokens of a character that stays alone."""
        if char in self.rank or not self.byte_fallback:
            return 1
        return len(char.encode("utf-8", "surrogatepass"))

    def count(self, part: str) -> int:
        """Initial symbols (unknown ones as their bytes) minus merges, of one part."""
        rank, n = self.rank, len(part)
        symbols = sum(map(self.base_cost, part))
        if n < 2:
            return symbols
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(part[i:i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != both:
                continue  # one of the two has changed since
            size[i], size[j] = both, 0
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(part[i:k + size[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, both + size[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(part[h:i + both])
                if r is not None:
                    heapq.heappush(heap, (r, h, size[h] + both))
        return symbols - merges


class _Counts(dict):
    """part -> tokens, filled on demand; emptied when full."""

    def __init__(self, vocabulary: PieceVocabulary, lead: str):
        super().__init__()
        self.vocabulary, self.lead = vocabulary, lead

    def __missing__(self, part: str) -> int:
        count = self.vocabulary.count(self.lead + part)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[part] = count
        return count


class PieceCounter:
    def __init__(self, path: str):
        self.vocabulary = v = PieceVocabulary(path)
        self.marked, self.plain = _Counts(v, MARK), _Counts(v, "")
        self.splits_lines = "\n" not in v.joining
        self.line_cost = v.base_cost("\n")
        self.runs = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _line(self, line: str) -> int:
        if not line:
            return 0
        if not self.vocabulary.marks_lead:
            return self.plain[line]
        first, *rest = line.split(MARK)
        if "" in rest:  # a run of marks stays with the word after it
            return sum(map(self.plain.__getitem__, self.runs.findall(line)))
        return (self.plain[first] if first else 0) + sum(map(self.marked.__getitem__, rest))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        text = self.vocabulary.normalise(text)
        if not self.splits_lines:
            return self._line(text)
        lines = text.split("\n")
        return sum(map(self._line, lines)) + (len(lines) - 1) * self.line_cost


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


cached_for_tasks(_counter.cache_clear)


def token_counts(docs: DataFrame, vocabulary: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (n_tokens > limit). ``vocabulary`` is the path of a sentencepiece BPE model, the same on every
    executor. One scan, no shuffle; nulls, empties and clashing names as the module says."""
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c != text and c not in made]
    source = small_batches(docs).select(*[F.col(f"`{c}`") for c in keep],
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("n_tokens"))
    schema = source.drop("n_tokens").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = np.fromiter((counter(t.as_py()) for t in texts), dtype=np.int64, count=len(texts))
            size = pc.binary_length(texts).cast(pa.int64())
            rest = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*rest, size, pa.array(n), pa.array(n > limit)],
                                             names=[*batch.schema.names[:-1], *made])

    return source.mapInArrow(tidy(count, caches=True), schema)

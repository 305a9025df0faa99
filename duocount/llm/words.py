"""Vectorised word and shingle hashing over Arrow string columns (used inside Arrow batches).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. Multi-byte
UTF-8 characters never contain those bytes, so working on bytes is working on code points.
Memory is bounded by slicing a batch into runs of about ``SLICE_BYTES`` of text (one text is never
split, so a longer text is a slice of its own).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LONG_WORD = 256
HASH_SPANS = 1 << 14  # hashed at a time, few enough for the processor's caches

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


def _odd_constants(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _GOLD) | _U(1)


_WORD = bytes(b not in (0x20, *range(0x09, 0x0E)) for b in range(256))   # 1 for the bytes of words
_LOWER = bytes(range(256)).lower()
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2 ** 64 - 1], dtype=_U)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Runs of rows of about ``limit`` bytes each: (first row, row after the last)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step; spans over LONG_WORD bytes by blake2b."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=pad.data, strides=(1,))
    length = (ends - starts).astype(np.int64)
    h = length.astype(_U) * _GOLD
    for k in range(0, len(starts), HASH_SPANS):
        live, first, left = None, starts[k:k + HASH_SPANS], length[k:k + HASH_SPANS]
        own = h[k:k + HASH_SPANS]
        for at in range(0, LONG_WORD, 8):
            part = eight[first]
            part &= _TAIL.take(np.minimum(left, 8))
            part *= _M1
            part += _GOLD
            part ^= own if live is None else own.take(live)
            part = mix(part)
            if live is None:
                own[:] = part
            else:
                own[live] = part
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            live = more if live is None else live.take(more)
            first, left = first.take(more) + 8, left.take(more) - 8
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        h[i] = _U(int.from_bytes(digest, "little"))
    return h


def spans(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(bytes, word starts, word ends, first word of each row) of one slice."""
    raw = data.tobytes()
    if lower:
        raw = raw.translate(_LOWER)
        data = np.frombuffer(raw, np.uint8)
    word = np.frombuffer(raw.translate(_WORD), bool)
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a row boundary also separates words
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(hash of every word, first word of each row) of one slice."""
    data, starts, ends, row = spans(data, offsets, lower)
    return _hash_spans(data, starts, ends), row


def shingles(words: np.ndarray, row: np.ndarray, k: int):
    """All k-word shingle hashes in text order, and the first shingle of each row. A row with fewer
    than k words has its whole sequence as one shingle; a row without words has none."""
    n = np.diff(row)
    const = _odd_constants(k + 1)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1], dtype=_U)
    if not len(words):
        return out, first
    padded = np.concatenate([words, np.zeros(k, _U)])
    acc = np.zeros(len(words), _U)
    for j in range(k):
        acc += padded[j:j + len(words)] * const[j]
    full = np.arange(len(words)) + k <= np.repeat(row[1:], n)
    short = (n > 0) & (n < k)
    place = np.ones(len(out), dtype=bool)
    place[first[:-1][short]] = False
    out[place] = acc[full]
    for r in np.flatnonzero(short):
        w = words[row[r]:row[r + 1]]
        tagged = np.concatenate([w * const[:len(w)], const[k:] * np.full(1, len(w), _U)])
        out[first[r]] = tagged.sum(dtype=_U)
    return mix(out), first


def distinct_sorted(values: np.ndarray, first: np.ndarray):
    """Each row's values made distinct and sorted: (values, first value of each row)."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(size)])


def shingle_sets(col: pa.Array, k: int = 5, limit: int = SLICE_BYTES):
    """For each slice of the column: (first row, row after the last, distinct sorted shingle hashes,
    first hash of each row)."""
    data, offsets = buffers(col)
    for a, b in slices(offsets, limit):
        part, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        words, row = word_hashes(part, off)
        yield (a, b, *distinct_sorted(*shingles(words, row, k)))

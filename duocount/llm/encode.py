"""Token ids of whole texts by the ``tokenizers`` library, for Arrow batches.

The word vocabulary drops white space and lower-cases, so a text can be cut at ASCII white space, its
parts lower-cased and encoded apart; punctuation after ASCII letters is a part of its own. Parts are told by a
64-bit hash of their bytes, encoded once and kept in a bounded per-worker table (speed only). A tokenizer whose pre-tokenizer keeps white space encodes whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from duocount.llm.batches import cached_for_tasks
from duocount.llm.words import _hash_spans, buffers, spans

CACHE_ENTRIES = 600_000
CACHE_BYTES = 64
LINE_WORDS = 128   # new words encoded as one text


_PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'  # ASCII but the apostrophe, which starts patterns


class IdEncoder:
    """text -> its ids as little-endian unsigned 32-bit integers (bytes)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_part = _drops_white_space(spec)
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.last = self._last_ids(spec)
        self.cache: dict[bytes, bytes] = {}   # parts of texts with the string of a special token
        self._forget()

    def _forget(self) -> None:
        """Empty the table of parts: ascending hashes, where the ids of each begin in ``flat`` and how many they are."""
        self.known, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def _last_ids(self, spec: dict) -> np.ndarray | None:
        """Which ids end a unit of letters, where the model marks ends and has every byte with that mark."""
        from tokenizers.pre_tokenizers import ByteLevel

        mark, ids = spec["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab(with_added_tokens=False)
        if not mark or not all(c + mark in ids for c in ByteLevel.alphabet()):
            return None
        last = np.zeros(max(ids.values()) + 1, bool)
        last[[i for token, i in ids.items() if token.endswith(mark)]] = True
        return last

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Words of letters alone, encoded as lines of many; one by one if any is more than one unit of the
        pre-tokenizer (a letter whose lower case is a letter and a mark). Each unit ends in its only id of ``last``."""
        if self.last is not None:
            lines = [b" ".join(words[at:at + LINE_WORDS]).decode("utf-8") for at in range(0, len(words), LINE_WORDS)]
            found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
            cut = ((np.flatnonzero(self.last.take(ids)) + 1) * 4).tolist()
            if len(cut) == len(words):
                raw = ids.tobytes()
                return [raw[a:b] for a, b in zip([0, *cut], cut)]
        return self._encode([w.decode("utf-8") for w in words])

    def _parts(self, text: pa.Scalar) -> list[bytes]:
        raw = text.as_buffer().to_pybytes()
        if not any(s in raw for s in self.specials):
            low = raw.lower()  # ASCII only; a special token's string must keep its case to stay text
            if not any(s in low for s in self.specials):
                raw = low
        return raw.split()

    def _learn(self, missing: list[bytes], into: dict[bytes, bytes]) -> None:
        new = dict.fromkeys(p for p in missing if p.isalpha())   # ASCII letters alone: most of them
        tailed, rest = [], []
        for part in missing:
            if part not in new:
                core = part.rstrip(_PUNCTUATION)
                plain = core.isalpha() or core.decode("utf-8").lower().isalpha()
                (tailed if plain else rest).append((part, core))
        new.update((core, None) for _, core in tailed if core not in into)
        cores = list(new)
        for at in range(0, len(cores), 2048):
            some = cores[at:at + 2048]
            into.update(zip(some, self._encode_words(some)))
        tails = {part[len(core):] for part, core in tailed} - {b""}
        rest = list(tails.union(part for part, _ in rest).difference(into))
        for at in range(0, len(rest), 2048):
            some = rest[at:at + 2048]
            into.update(zip(some, self._encode([p.decode("utf-8") for p in some])))
        for part, core in tailed:
            if len(part) > len(core):  # a letter and then punctuation: always two units
                into[part] = into[core] + into[part[len(core):]]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """One bytes object a text; null counts as empty."""
        if not self.by_part:
            return self._encode([t.as_py() or "" for t in texts])
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        if len(self.known) > CACHE_ENTRIES:
            self._forget()
        data, offsets = buffers(texts)
        low, starts, ends, first = spans(data, offsets)
        raw = low.tobytes()
        odd = self._with_specials(raw, offsets)
        starts, ends, first = _tails_apart(low, starts, ends, first)
        # every distinct part of the slice is looked up once, by a 64-bit hash of its bytes
        hashes, where, which = np.unique(_hash_spans(low, starts, ends), return_index=True, return_inverse=True)
        begin, count = self._find(hashes, raw, starts[where], ends[where])
        n = count.take(which)
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat.take(np.repeat(begin.take(which) - total[:-1], n) + np.arange(total[-1])).tobytes()
        cut = (total[first] * 4).tolist()
        found = [out[i:j] for i, j in zip(cut[:-1], cut[1:])]
        for i in odd:   # a special token's string keeps its case
            found[i] = b"".join(self._look_up(self._parts(texts[i])))
        return found

    def _find(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each part (by ascending hash) begin in ``flat`` and how many they are; until the next call."""
        at = np.searchsorted(self.known, hashes)
        met = np.zeros(len(hashes), bool)
        if len(self.known):
            met = self.known.take(at, mode="clip") == hashes
        begin, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begin[met], count[met] = self.begin.take(at[met]), self.count.take(at[met])
        new = np.flatnonzero(~met)
        if len(new):
            long = ends[new] - starts[new] > CACHE_BYTES
            new = np.concatenate([new[~long], new[long]])   # long parts last: not kept
            short = len(new) - int(long.sum())
            parts = [raw[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist())]
            into: dict[bytes, bytes] = {}
            self._learn(parts, into)
            ids = [into[part] for part in parts]
            size = np.array([len(x) for x in ids], dtype=np.int64) // 4
            flat = np.frombuffer(b"".join(ids), "<u4")
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[:self.used], np.zeros(self.used + 2 * len(flat), "<u4")])
            self.flat[self.used:self.used + len(flat)] = flat
            begin[new], count[new] = self.used + np.cumsum(size) - size, size
            self.used += int(size[:short].sum())
            keep = new[:short]
            self.known = np.insert(self.known, at[keep], hashes[keep])
            self.begin, self.count = np.insert(self.begin, at[keep], begin[keep]), np.insert(self.count, at[keep], count[keep])
        return begin, count

    def _with_specials(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Rows with the string of a special token in any case."""
        some = [s.lower() for s in self.specials if s.lower() in raw]
        if not some:
            return []
        edges = offsets.tolist()
        return [i for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if any(raw.find(s, a, b) >= 0 for s in some)]

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, learnt where the cache has none."""
        cache = self.cache
        found = [cache.get(part) for part in parts]
        holes = [i for i, ids in enumerate(found) if ids is None]
        if holes:
            missing = list(dict.fromkeys(parts[i] for i in holes))
            self._learn(missing, cache)
            for i in holes:
                found[i] = cache[parts[i]]
            for part in missing:
                if len(part) > CACHE_BYTES:
                    cache.pop(part, None)
        return found


_LETTER = bytes(chr(b).isalpha() and b < 128 for b in range(256))
_TAIL = bytes(b in _PUNCTUATION for b in range(256))


def _tails_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """Words cut in two where ASCII letters are followed by punctuation alone, which are always two units of the
    pre-tokenizer: (starts, ends, first part of each row)."""
    if not len(starts):
        return starts, ends, first
    raw = data.tobytes()
    stop = np.frombuffer(raw.translate(_LETTER), np.uint8) == 0
    seen = np.cumsum(stop, dtype=np.int32)
    # the first byte from a word's start that is no letter; a word that runs to the end of the data has none
    places = np.append(np.flatnonzero(stop), len(data))
    edge = np.minimum(places.take(seen.take(starts) - stop.take(starts)), ends)
    other = np.concatenate([[0], np.cumsum(np.frombuffer(raw.translate(_TAIL), np.uint8) == 0, dtype=np.int32)])
    two = (edge > starts) & (edge < ends) & (other.take(ends) == other.take(edge))
    parts = np.concatenate([[0], np.cumsum(1 + two)])
    begin, end = np.repeat(starts, 1 + two), np.repeat(ends, 1 + two)
    at = parts[:-1][two]
    end[at], begin[at + 1] = edge[two], edge[two]
    return begin, end, parts[first]


def _drops_white_space(spec: dict) -> bool:
    """True for a tokenizer that turns every run of white space into one space, lower-cases and then keeps only
    matches of a pattern without white space, as the word vocabulary does."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    squeezed = any(s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kept = cuts[0].get("type") == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    lower = any(s["type"] == "Lowercase" for s in steps)
    return bool(lower and squeezed and kept and " " not in json.dumps(cuts[0]["pattern"].get("Regex", " ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


cached_for_tasks(encoder.cache_clear)

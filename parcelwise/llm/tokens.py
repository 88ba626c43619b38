"""Exact token ids of whole texts by a ``tokenizers`` file, each distinct word once.

The pre-tokenizer of the word BPE file never joins pieces across white space, lower-cases,
and cuts runs of letters from runs of punctuation. So the ids of a text are those of its
white-space chunks in order, and those of a chunk that ends in ASCII punctuation after a
letter are those of the rest plus the punctuation's. Chunks are cut there, found and hashed with NumPy (64-bit,
A-Z lower-cased), distinct ones are looked up in a sorted table that lasts over batches.
Unknown words of ASCII and Latin-1 letters are merged together, one merge of each word at a
time, by the file's ranked merges (a hundred thousand short calls to the library would take
most of the run); all others go to the library. Texts that hold a special token's string are
encoded whole by the library, as are all texts of a tokenizer that these rules do not fit.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from parcelwise.llm import wordhash as wh

#: Distinct words a worker keeps; beyond it the table starts anew (results do not change).
KNOWN_WORDS = 400_000
SLICE_BYTES = 1_000_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_CUT = np.zeros(256, dtype=bool)
_CUT[[9, 10, 13, 32]] = True


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + count], one behind the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - count), count) + np.arange(total)]


class Merges:
    """Ranked merges of a word BPE over bytes, applied to many words at once."""

    NONE = np.int32(2**31 - 1)
    LONGEST = 32

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]  # written as code points from 256 on
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([vocabulary[letter[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([vocabulary[letter[b] + suffix] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], self.NONE)

    def apply(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, all ids) of the words raw[start:stop] (lower case, not empty)."""
        n, size = len(start), stop - start
        out = np.full((n, self.LONGEST), -1, dtype=np.int32)
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 18), (18, self.LONGEST)):
            rows = np.flatnonzero((size > low) & (size <= high))
            column = np.arange(high)
            filled = column < size[rows][:, None]
            ids = np.full((len(rows), high + 1), -1, dtype=np.int32)
            ids[:, :-1][filled] = self.inner[raw[(start[rows][:, None] + column)[filled]]]
            ids[np.arange(len(rows)), size[rows] - 1] = self.final[raw[stop[rows] - 1]]
            rank = np.full((len(rows), high + 1), self.NONE, dtype=np.int32)
            rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                j = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), j]
                more = best != self.NONE
                out[rows[~more], :high] = ids[~more, :high]
                rows, ids, rank, j, best = rows[more], ids[more], rank[more], j[more], best[more]
                if not len(rows):
                    break
                each = np.arange(len(rows))
                ids[each, j] = self.result[best]
                at = np.arange(high + 1)
                ids = np.take_along_axis(ids, np.minimum(at + (at > j[:, None]), high), axis=1)
                rank = np.take_along_axis(rank, np.minimum(at + (at > j[:, None]), high), axis=1)
                rank[each, j] = self.ranks(ids[each, j], ids[each, j + 1])
                before = np.maximum(j - 1, 0)
                rank[each, before] = self.ranks(ids[each, before], ids[each, before + 1])
        used = out >= 0
        return used.sum(axis=1), out[used].astype(np.uint32)


class WordTable:
    """Known word hashes with the ids of each word."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return at, (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        start = len(self.flat) + np.cumsum(count) - count
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.start = np.insert(self.start, at, start[order])
        self.count = np.insert(self.count, at, count[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        parts = json.loads(self.tokenizer.to_str())
        self.special = [t["content"].lower() for t in parts["added_tokens"]]
        self.table, self.merges = WordTable(), None
        self.by_word = self._fits(parts["model"].get("end_of_word_suffix"))
        if self.by_word:
            self.merges = Merges(parts["model"]["vocab"], parts["model"]["merges"],
                                 parts["model"]["end_of_word_suffix"])

    def _whole(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=np.uint32)

    def _fits(self, suffix: str | None) -> bool:
        """Whether this file follows the rules in the module's text."""
        probe = "Ab, cd. ÉTÉ. x\ty\n"
        return bool(suffix) and np.array_equal(
            self._whole(probe), np.concatenate([self._whole(x) for x in ("ab", ",", "CD", ".", "été", ".", "x", "y")]))

    def _learn(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, all ids) of the words raw[start:stop]."""
        raw = _gather(raw, start, stop - start)
        stop = np.cumsum(stop - start)
        start = np.concatenate([[0], stop[:-1]])
        lead = np.concatenate([[0], raw[:-1]]) == 0xC3
        latin = lead & (raw >= 0x80) & (raw != 0x97) & (raw != 0xB7)
        low = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90) | latin & (raw <= 0x9E)).astype(np.uint8)
        other = np.concatenate([[0], np.cumsum(~(_LETTER[raw] | latin | (raw == 0xC3)))])
        plain = (other[stop] == other[start]) & (stop - start <= Merges.LONGEST)
        plain &= self.merges is not None
        counts, flat = np.zeros(len(start), np.int64), np.zeros(0, np.uint32)
        if plain.any():
            counts[plain], flat = self.merges.apply(low, start[plain], stop[plain])
        places = np.zeros(len(start), np.int64)
        places[plain] = np.cumsum(counts[plain]) - counts[plain]
        others, data = np.flatnonzero(~plain), raw.tobytes()
        words = [data[a:b].decode("utf-8") for a, b in zip(start[others].tolist(), stop[others].tolist(), strict=True)]
        runs = [np.array(e.ids, dtype=np.uint32)
                for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts[others] = [len(r) for r in runs]
        places[others] = len(flat) + np.cumsum(counts[others]) - counts[others]
        return counts, _gather(np.concatenate([flat, *runs]), places, counts)

    def _slice(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts, each followed by ``end_id``."""
        docs = len(offsets) - 1
        inside = ~_CUT[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        stop = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        solid = np.maximum.accumulate(np.where(_MARK[raw], -1, np.arange(len(raw)))) if len(raw) else raw
        cut = solid[stop - 1] + 1  # where the punctuation at the end of a chunk begins
        before, second = raw[np.maximum(cut - 1, 0)], raw[np.maximum(cut - 2, 0)]
        latin = (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (cut - start > 1)
        marked = (cut > start) & (cut < stop) & (_LETTER[before] | latin)
        start = np.sort(np.concatenate([start, cut[marked]]))
        stop = np.sort(np.concatenate([stop, cut[marked]]))
        keys = wh.word_hashes(raw, start, stop, lower=True)
        first = np.searchsorted(start, offsets)
        place = np.arange(len(start)) + np.repeat(np.arange(docs), np.diff(first))
        ends = first[1:] + np.arange(docs)
        distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        known = self.table
        at, hit = known.find(distinct)
        if not hit.all():
            if len(known.keys) + len(hit) - hit.sum() > KNOWN_WORDS:
                known = self.table = WordTable()
                hit[:] = False
            new = sample[~hit]
            known.add(distinct[~hit], *self._learn(raw, start[new], stop[new]))
            at, _ = known.find(distinct)
        start_at, count = np.zeros(len(start) + docs, np.int64), np.zeros(len(start) + docs, np.int64)
        start_at[place], count[place] = known.start[at][which], known.count[at][which]
        start_at[ends], count[ends] = len(known.flat), 1
        bounds = np.concatenate([[0], np.cumsum(count)[ends]])
        return _gather(np.append(known.flat, np.uint32(end_id)), start_at, count), bounds

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(a, b, ids, bounds): the ids of texts a to b, each followed by ``end_id``;
        ``bounds`` has b - a + 1 places. A null text is empty."""
        raw, offsets = wh.text_buffers(texts)
        for a, b in wh.slices(offsets, SLICE_BYTES):
            off = offsets[a:b + 1]
            part, rel = raw[off[0]:off[-1]], off - off[0]
            lowered = part.tobytes().lower()
            odd = not self.by_word or any(s.encode() in lowered for s in self.special)
            if not odd:
                yield a, b, *self._slice(part, rel, end_id)
                continue
            for i in range(b - a):
                data = part[rel[i]:rel[i + 1]]
                low = data.tobytes().lower()
                if self.by_word and not any(s.encode() in low for s in self.special):
                    ids, bounds = self._slice(data, np.array([0, len(data)]), end_id)
                else:
                    ids = np.append(self._whole(data.tobytes().decode("utf-8")), np.uint32(end_id))
                    bounds = np.array([0, len(ids)])
                yield a + i, a + i + 1, ids, bounds


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One per worker process, so that its table lasts over tasks."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_as_text)
    return _ENCODERS[key]


def forget() -> None:
    """Let go of all encoders: the word table of a large slice of texts is as large as the slice,
    and the worker process goes on to other stages."""
    _ENCODERS.clear()

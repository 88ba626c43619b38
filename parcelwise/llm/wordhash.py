"""Vectorised word scanning of whole texts: word bounds and 64-bit word hashes from UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. The separators are ASCII, so a byte-wise scan of UTF-8
is exact. Hashes are polynomials over random 64-bit byte codes, finished by a mixer; equal
words have equal hashes in every task and run (fixed seed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[65:91] = _CODE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 5
_STEP = 1 << 20
_POW: list[np.ndarray] = []
#: Texts are scanned together up to this many bytes; a longer text is scanned alone.
SLICE_BYTES = 2_000_000


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        inverse = pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            steps = np.full(_STEP, base, dtype=np.uint64)
            steps[0] = 1
            _POW.append(np.cumprod(steps, dtype=np.uint64))
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix); bijective, so it adds no collisions."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text counts as empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type):
        wide = pa.types.is_large_string(texts.type)
    else:
        texts, wide = texts.cast(pa.string()), False
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes together."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(start + 1, stop))
        yield start, stop
        start = stop


def pieces(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP,
           limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` that cut no word: they end at a text's end or a separator."""
    start, n = 0, len(raw)
    while start < n:
        stop = min(n, start + limit)
        after = int(offsets[np.searchsorted(offsets, stop)]) if stop < n else n
        at = stop
        while at < after:
            found = np.flatnonzero(separators[raw[at:min(after, at + 4096)]])
            if len(found):
                at += int(found[0])
                break
            at = min(after, at + 4096)
        start, last = at, start
        yield last, at


def word_bounds(raw: np.ndarray, offsets: np.ndarray,
                separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte bounds of all words, and the first word of each text.
    ``separators`` says for each byte whether it stands outside words."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    closes[ends_at] = inside[ends_at]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash per word. Words longer than a block are hashed block by block."""
    out = np.zeros(len(start), dtype=np.uint64)
    if not len(start):
        return out
    up, down = _powers()
    code = _CODE_LOWER if lower else _CODE
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(end, base + _STEP, side="right"))
        if j <= i:  # one word over the block size
            h = np.uint64(end[i] - start[i])
            for at in range(int(start[i]), int(end[i]), _STEP):
                part = code[raw[at:min(at + _STEP, int(end[i]))]]
                h = mix(np.array([h + (part * up[:len(part)]).sum(dtype=np.uint64)]))[0]
            out[i] = h
            i += 1
            continue
        last = end[j - 1]
        sums = np.zeros(last - base + 1, dtype=np.uint64)
        np.cumsum(code[raw[base:last]] * up[:last - base], dtype=np.uint64, out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (len(words) - width + 1 of them)."""
    m = len(words) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0xD1342543DE82EF95) + words[k:k + m]
    return mix(acc + np.uint64(width))

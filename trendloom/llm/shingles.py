"""Word shingles of whole texts as sorted 64-bit hashes, computed over Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  A word's hash is a
polynomial over its bytes, taken from running sums, so that a batch of texts
costs a few array operations and no Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18  # bytes handled at once: a worker keeps tables and sums of 64-bit numbers for each
_U = np.uint64
BASE = 0x9E3779B97F4A7C15
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Hasher:
    """Tables of byte values and powers; they grow to the longest stretch without white space."""

    def __init__(self):
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * _U(BASE))
        self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._grow(SEGMENT)

    def _grow(self, n: int) -> None:
        for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of texts that lie side by side, and where each text's words begin (one more entry at the end)."""
        if len(raw) > len(self.power):
            self._grow(2 * len(raw))
        filled = ~self.space[raw]
        first, last = filled.copy(), filled.copy()
        first[1:] &= ~filled[:-1]
        last[:-1] &= ~filled[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(raw))]
        first[cuts] = filled[cuts]
        last[cuts - 1] = filled[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[:len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts]), np.searchsorted(starts, offsets)

    def long_text(self, raw: np.ndarray) -> np.ndarray:
        """Word hashes of one long text, by stretches that end at white space."""
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + SEGMENT)
            while end < len(raw):
                gaps = np.flatnonzero(self.space[raw[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
                end = min(len(raw), end + SEGMENT)
            parts.append(self.words(raw[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    x = np.full(max(0, n), 17, np.uint64)
    for j in range(width):
        x = (x + words[j:j + len(x)]) * MULTIPLIERS[j % 5]
    return mix(x).view(np.int64)


def _short(words: np.ndarray) -> np.ndarray:
    """Fewer words than the width: the whole sequence is one shingle."""
    x = np.array([len(words)], np.uint64)
    for w in words:
        x = mix((x + w) * MULTIPLIERS[0])
    return x.view(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def sets(texts: pa.Array, width: int, hasher: Hasher) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a null text or one without words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        if offsets[i + 1] - offsets[i] > SEGMENT:
            w = hasher.long_text(raw[offsets[i]:offsets[i + 1]])
            yield _distinct(shingle_hashes(w, width)) if len(w) >= width else _short(w) if len(w) else np.empty(0, np.int64)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        own = offsets[i:j + 1] - offsets[i]
        words, at = hasher.words(raw[offsets[i]:offsets[j]], own)
        x = shingle_hashes(words, width)
        for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
            yield _distinct(x[a:z - width + 1]) if z - a >= width else _short(words[a:z]) if z > a else np.empty(0, np.int64)
        i = j

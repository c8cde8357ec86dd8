"""Words of many texts at once, straight from Arrow's buffers.

Words are runs of anything but ASCII white space; A-Z count as a-z. Each word gets a 64-bit hash: its length and its
bytes, eight at a time, go through a bijective mixer one after the other, so words of up to eight bytes and equal
length never share one, and no family of longer words does by its form. Words over LONG bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are scanned at a time; a longer text is scanned by itself.
CHUNK = 1 << 20

#: Bytes of the longest word that is hashed by blocks.
LONG = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Leading bytes of a block that belong to a word of so many bytes.
_LEADING = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def blocks(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer as a little-endian number; the buffer ends with eight bytes of padding."""
    return np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))


def leading(ahead: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of words (place, size) as a number, those beyond a word's end as zeros."""
    return ahead[at] & _LEADING[np.minimum(size, 8)]


def hash_words(folded: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at start..stop of a buffer that ends with eight bytes of padding."""
    ahead, size = blocks(folded), stop - start
    h = mix(leading(ahead, start, size) + mix(size.astype(np.uint64) * _GOLDEN))
    for k in range(8, LONG, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        h[more] = mix((h[more] ^ leading(ahead, start[more] + k, size[more] - k)) + _GOLDEN)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(folded[start[i] : stop[i]], digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """Words of texts lo..hi-1 of an array: places in `raw`, hashes, and the first word of each text (one more at the end)."""

    lo: int
    hi: int
    raw: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow array of strings or binaries; a null has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at, np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """lo, hi, bytes and offsets of texts lo..hi-1, `size` bytes or one text at a time."""
    at, data = buffers(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + size, "right")) - 1
        hi = max(lo + 1, min(hi, n))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def scan(texts: pa.Array) -> Iterator[Words]:
    for chunk in chunks(texts):
        yield _scan(*chunk)


def runs(solid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of solid bytes begin and end; a text (from one of `at` to the next) ends a run, as it begins one."""
    n = len(solid)
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    begins, ends = at[:-1][at[:-1] < n], at[1:][at[1:] > 0] - 1
    opens[begins] = solid[begins]
    closes[ends] = solid[ends]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _scan(lo: int, hi: int, raw: np.ndarray, at: np.ndarray) -> Words:
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(lo, hi, raw, none, none, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64))
    start, stop = runs(SOLID[raw], at)
    folded = np.zeros(n + 8, np.uint8)
    folded[:n] = FOLD[raw]
    return Words(lo, hi, raw, start, stop, hash_words(folded, start, stop), np.searchsorted(start, at))


class HashIndex:
    """Places of 64-bit hashes in a sorted array, looked up by their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.ascontiguousarray(hashes, np.uint64)
        bits = max(4, int(len(hashes) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((self.sorted >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        self.deepest = int(np.diff(self.first).max()) if len(hashes) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it isn't."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.sorted) or not len(h):
            return out
        lead = (h >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        for _ in range(self.deepest):
            open_ = np.flatnonzero((at < end) & (out < 0)) if _ else np.flatnonzero(at < end)
            if not len(open_):
                break
            here = at[open_]
            hit = self.sorted[here] == h[open_]
            out[open_[hit]] = here[hit]
            at[open_] += 1
        return out

"""Words of whole texts and their 64-bit hashes, from Arrow's UTF-8 bytes with numpy.

Both word definitions used here split on ASCII characters only, so bytes can be classified one by one:
a byte from 0x80 up always belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of one step of the numpy work; small enough for the processor's caches.
STEP = 1 << 20

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_SPACED = np.ones(256, bool)
_SPACED[0x20] = False
_SPACED[0x09:0x0E] = False
#: Is a byte part of a word: letters and digits (``alnum``), or whatever stands between white space (``spaced``).
KINDS = {"alnum": _ALNUM, "spaced": _SPACED}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 bounds of its values; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def steps(bounds: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


#: What is left of eight bytes, read as one little-endian number, for a block of 0 to 8 bytes.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_STEP, _SIZE, _ODD = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03), U64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """64-bit hashes of byte spans. A span is cut into blocks of eight bytes; every block is mixed together with its
    place in the span, and the sum is mixed with the span's length. Spans of up to eight bytes of one length never
    collide; longer ones as often as random numbers do (sums of words or of powers would let texts be made that do)."""

    def __init__(self, fold: bool = True):
        self.fold = np.arange(256, dtype=np.uint8)
        if fold:
            self.fold[0x41:0x5B] += 32

    def blocks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of all spans as numbers, the last one of a span filled up with zeros, and the bounds of each span's."""
        size = ends - starts
        count = np.maximum(1, (size + 7) >> 3)
        bounds = np.concatenate([[0], np.cumsum(count)])
        padded = np.zeros(len(data) + 8, np.uint8)
        np.take(self.fold, data, out=padded[: len(data)])
        eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
        if bounds[-1] == len(starts):
            return eight[starts].view("<u8").reshape(-1) & _LOW[size], bounds
        place = 8 * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], count))
        first = np.repeat(starts, count) + place
        return eight[first].view("<u8").reshape(-1) & _LOW[np.minimum(8, np.repeat(size, count) - place)], bounds

    @staticmethod
    def of_blocks(blocks: np.ndarray, bounds: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(size):
            return np.zeros(0, U64)
        if len(blocks) == len(size):
            total = mix(blocks * _ODD + _STEP)
        else:
            place = (np.arange(len(blocks)) - np.repeat(bounds[:-1], np.diff(bounds)) + 1).astype(U64)
            total = np.add.reduceat(mix(blocks * _ODD + place * _STEP), bounds[:-1])
        return mix(total + size.astype(U64) * _SIZE)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ascending spans that don't overlap. Only about STEP bytes, or one span, are worked on at a time."""
        if len(data) <= 2 * STEP:
            return self._spans(data, starts, ends)
        out, i = np.empty(len(starts), U64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            out[i:j] = self._spans(data[a:b], starts[i:j] - a, ends[i:j] - a)
            i = j
        return out

    def _spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of_blocks(*self.blocks(data, starts, ends), ends - starts)

    def words(self, texts: list[str]) -> np.ndarray:
        """The hash of each string as one span."""
        raw = [t.encode() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
        return self.spans(np.frombuffer(b"".join(raw), np.uint8), bounds[:-1], bounds[1:])


#: Word hashes with A-Z folded.
WORD_HASH = Hasher()


def word_spans(data: np.ndarray, bounds: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the bounds of each text's words among them. No word crosses two texts."""
    inside = KINDS[kind][data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        b = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[b] = inside[b]
        e = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        last[e] = inside[e]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def hashed_words(column: pa.Array, kind: str = "alnum", size: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges i..j of the texts: i, j, all word hashes, and the bounds of each text's words among them."""
    data, bounds = text_bytes(column)
    for i, j in steps(bounds, size):
        part = data[bounds[i] : bounds[j]]
        starts, ends, at = word_spans(part, bounds[i : j + 1] - bounds[i], kind)
        yield i, j, WORD_HASH.spans(part, starts, ends), at

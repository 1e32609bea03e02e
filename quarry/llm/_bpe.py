"""Byte-level BPE ids of whole texts by the ``tokenizers`` library, with each distinct piece encoded once a worker.

The library cuts a text into pieces by a fixed pattern and encodes every piece on its own. So a piece's ids may be
remembered. Pieces are cut here with numpy where a text holds only ASCII and Latin letters; other texts, and those that
hold the string of a special token, go to the library whole. Pieces not met before are encoded by the library, many in
one call. A remembered piece is found by a hash and used only if all its bytes are the same.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._io import keep_for
from ._words import Hasher, steps, text_bytes

# Byte classes: letter, digit, other, white space.
_L, _N, _O, _W = 1, 2, 3, 4
_CLASS = np.full(256, _O, np.uint8)
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _L
_CLASS[0x80:] = _L
_CLASS[0x30:0x3A] = _N
_CLASS[[9, 10, 11, 12, 13, 32]] = _W
#: Bytes that only a text for the library itself has: control characters that definitions of white space differ on,
#: and lead bytes of characters other than Latin letters (U+00C0 to U+024F).
_HARD = np.zeros(256, bool)
_HARD[0x1C:0x20] = True
_HARD[0xC2] = True
_HARD[0xCA:] = True


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in texts of ASCII and Latin letters, as the byte-level pattern cuts them."""
    kind = _CLASS[data]
    head = np.empty(len(data), bool)
    head[0] = True
    np.not_equal(kind[1:], kind[:-1], out=head[1:])
    begin = bounds[:-1][bounds[:-1] < bounds[1:]]
    head[begin] = True
    white = kind == _W
    # The last character of white space before something else is a piece of its own, or the space that leads a piece.
    last = np.zeros(len(data), bool)
    last[:-1] = white[:-1] & ~white[1:]
    last[bounds[1:][bounds[1:] > 0] - 1] = False
    head |= last
    spaced = np.flatnonzero(last & (data == 0x20)) + 1
    head[spaced] = False
    # 's 't 're 've 'm 'll 'd where an apostrophe starts a piece alone and letters follow.
    ticks = np.flatnonzero(data[:-1] == 0x27) if len(data) > 1 else np.zeros(0, np.int64)
    if len(ticks):
        ends = np.zeros(len(data) + 3, bool)
        ends[bounds] = True
        a = np.concatenate([data, np.zeros(3, np.uint8)])
        ticks = ticks[head[ticks] & (kind[ticks + 1] == _L) & ~ends[ticks + 1]]
        one, two = a[ticks + 1], a[ticks + 2]
        long = ~ends[ticks + 2] & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(long, 2, 0))
        ticks, size = ticks[size > 0], size[size > 0]
        head[ticks + 1] = False
        after = ticks + 1 + size
        head[after[after < len(data)]] = True
    return np.flatnonzero(head)


class Encoder:
    """``encode(column)`` gives the ids of a string column and the bounds of each text's ids.

    special_as_text: strings of special tokens within a text are ordinary text; the library's own way is to take them
    as those tokens. slots: size of the table of remembered pieces; what doesn't fit is encoded anew.
    """

    def __init__(self, path: str, special_as_text: bool = False, slots: int = 1 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.specials = [] if special_as_text else [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # one character stands for one byte
        self.hash = Hasher(fold=False)
        self.slots = slots
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros((2, self.slots), np.uint64)
        self.entry = np.zeros((2, self.slots), np.int32)
        self.turn = 0
        # Of each entry: where its ids and its blocks of bytes begin, and how many ids and bytes it has.
        self.at, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.block_at, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.count = 0
        self.ids, self.used = np.zeros(1 << 18, np.uint16 if len(self.lengths) <= 1 << 16 else np.int32), 0
        self.blocks, self.blocks_used = np.zeros(1 << 17, np.uint64), 0

    @staticmethod
    def _same(size: np.ndarray, other: np.ndarray, blocks: np.ndarray, first: np.ndarray, others: np.ndarray, other_first: np.ndarray) -> np.ndarray:
        """Pairs of pieces with the same bytes: sizes, and blocks from ``first`` on, of either side."""
        ok = (size == other) & (blocks[first] == others[other_first])
        long = np.flatnonzero(ok & (size > 8))
        if len(long):
            m = (size[long].astype(np.int64) + 7) >> 3
            edge = np.cumsum(m) - m
            step = np.arange(int(m.sum())) - np.repeat(edge, m)
            equal = blocks[np.repeat(first[long], m) + step] == others[np.repeat(other_first[long], m) + step]
            ok[long] = np.logical_and.reduceat(equal, edge)
        return ok

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Entries of new pieces, those of ``which``."""
        first, m = bounds[which], bounds[which + 1] - bounds[which]
        starts, ends = starts[which], ends[which]
        raw = data.tobytes()
        pieces = [raw[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = ends - starts
        # A joined text falls into the same pieces if each starts with a space and a letter or digit.
        second = data[np.minimum(starts + 1, len(data) - 1)]
        joins = (data[starts] == 0x20) & (sizes > 1) & np.isin(_CLASS[second], (_L, _N))
        found = np.zeros(len(pieces), np.int64)
        ids, many = [], np.flatnonzero(joins)
        for k in range(0, len(many), 512):
            part = many[k : k + 512]
            got = np.array(self.library.encode("".join([pieces[i] for i in part]), add_special_tokens=False).ids, np.int64)
            cut = np.searchsorted(np.cumsum(self.lengths[got]), np.cumsum(sizes[part])) + 1
            found[part] = np.diff(cut, prepend=0)
            ids.append(got)
        single = np.flatnonzero(~joins)
        for i, e in zip(single, self.library.encode_batch([pieces[i] for i in single], add_special_tokens=False) if len(single) else [], strict=True):
            found[i] = len(e.ids)
            ids.append(np.array(e.ids, np.int64))
        order = np.concatenate([many, single])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        need = self.count + len(pieces)
        if need > len(self.at):
            self.at, self.n, self.block_at, self.size = (np.resize(x, 2 * need) for x in (self.at, self.n, self.block_at, self.size))
        if self.blocks_used + int(m.sum()) > len(self.blocks):
            self.blocks = np.resize(self.blocks, 2 * (self.blocks_used + int(m.sum())))
        put = np.cumsum(m) - m
        self.blocks[self.blocks_used : self.blocks_used + int(m.sum())] = blocks[np.repeat(first - put, m) + np.arange(int(m.sum()))]
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
        self.ids[self.used : self.used + len(flat)] = flat
        entries = np.empty(len(pieces), np.int64)
        entries[order] = np.arange(self.count, need)
        self.n[self.count : need] = found[order]
        self.at[self.count : need] = self.used + np.cumsum(found[order]) - found[order]
        self.block_at[entries], self.size[entries] = self.blocks_used + put, sizes
        self.count, self.used, self.blocks_used = need, self.used + len(flat), self.blocks_used + int(m.sum())
        return entries

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.count > 2 * self.slots:
            self._forget()
        starts = piece_starts(data, bounds)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        blocks, block = self.hash.blocks(data, starts, ends)
        h = self.hash.of_blocks(blocks, block, size) | np.uint64(1)
        slots = [(h >> np.uint64(s)).astype(np.int64) & (self.slots - 1) for s in (40, 18)]
        entry = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for k in (0, 1):
            hit = left[self.keys[k][slots[k][left]] == h[left]]
            known = self.entry[k][slots[k][hit]]
            same = self._same(size[hit], self.size[known], blocks, block[hit], self.blocks, self.block_at[known].astype(np.int64))
            entry[hit[same]] = known[same]
            left = left[entry[left] < 0]
        if len(left):
            fresh, first, back = np.unique(h[left], return_index=True, return_inverse=True)
            at = left[first]
            like = at[back]
            same = self._same(size[left], size[like], blocks, block[left], blocks, block[like])
            made = self._learn(data, starts, ends, blocks, block, at)
            entry[left[same]] = made[back[same]]
            if not same.all():  # other bytes with the same hash: not remembered
                entry[left[~same]] = self._learn(data, starts, ends, blocks, block, left[~same])
            k, self.turn = self.turn, 1 - self.turn  # new pieces go to each of the two tables in turn
            self.keys[k][slots[k][at]] = fresh
            # Where two pieces share a slot, only the one whose key stands there may be found.
            held = self.keys[k][slots[k][at]] == fresh
            self.entry[k][slots[k][at[held]]] = made[held]
        n = self.n[entry].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[np.repeat(self.at[entry] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, bounds)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (unsigned 32-bit) and n + 1 bounds; a null text has no ids."""
        data, bounds = text_bytes(column)
        n = len(bounds) - 1
        parts, counts = [], np.zeros(n, np.int64)
        for i, j in steps(bounds):
            part, b = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            if not len(part):
                continue
            hard = _HARD[part]
            hard[:-1] |= (part[:-1] == 0xC3) & ((part[1:] == 0x97) | (part[1:] == 0xB7))
            own = np.zeros(j - i, bool)
            own[np.searchsorted(b, np.flatnonzero(hard), "right") - 1] = True
            raw = part.tobytes()
            for s in self.specials:
                at = raw.find(s)
                while at >= 0:
                    own[np.searchsorted(b, at, "right") - 1] = True
                    at = raw.find(s, at + 1)
            k = 0
            while k < j - i:  # runs of texts of one kind
                m = k + 1
                while m < j - i and own[m] == own[k]:
                    m += 1
                if own[k]:
                    for x in range(k, m):
                        ids = self.library.encode(raw[b[x] : b[x + 1]].decode("utf-8"), add_special_tokens=False).ids
                        counts[i + x] = len(ids)
                        parts.append(np.array(ids, np.uint32))
                elif b[m] > b[k]:
                    ids, at = self._cut(part[b[k] : b[m]], b[k : m + 1] - b[k])
                    counts[i + k : i + m] = np.diff(at)
                    parts.append(ids.astype(np.uint32, copy=False))
                k = m
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids.astype(np.uint32, copy=False), np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path, special_as_text)


keep_for("tokens", encoder.cache_clear)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

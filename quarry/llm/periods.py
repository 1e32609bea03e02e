"""Periodic runs in the words of texts: stretches that repeat themselves, and the text with the repeats taken out.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``TIMES`` periods long, that no
neighbouring word extends with that period. Runs are found by Lyndon words: a stack, filled from right to left, holds the
longest Lyndon word that begins at each place, once in the order of the words' numbers and once in its reverse. Every run
has a period that is such a word in one of the two orders, so each word on the stacks is a candidate: it is extended to
both sides as far as the words one period apart agree. Suffixes are compared, and candidates extended, by their longest
common extension: after a direct look at the first few words by binary search over rolling hashes, whose answer is then
verified word by word (should a hash have lied, the words decide).

Stacks are only built where a run can be. Within a run, each group of three words but those of the last period stands
again one period later; so, for each power of two, stretches of places whose group soon stands again are looked for with
numpy in many texts at once, and what overlaps is one part. Every run of the text lies within one part, so the runs of the
parts are those of the text. Groups whose hashes are equal by chance can only make a part longer.

Texts are judged whole; null and empty ones have no words and no runs. A null id is tampered with like no other: not at
all. Repeated rows are judged each on its own. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import lean

#: Of a run: words, and periods, at least.
LEAST, TIMES = 6, 4
#: Words of texts that are looked through together; words of a group.
TOGETHER, GROUP = 1 << 19, 3
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_M = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E6F1 % _M


class Words:
    """The words of a part of a text as numbers, with the means to extend equal stretches."""

    #: Words that are compared one by one before hashes are asked.
    NEAR = 8

    def __init__(self, ids: list[int]):
        self.ids, self.size, self.array = ids, len(ids), np.array(ids, np.int64)
        self.hashes, self.powers, x, p = [0], [1], 0, 1
        self.seen: dict[int, tuple[int, int]] = {}  # of a distance the stretch found last: its words agree with those so far on
        for w in ids:
            x = (x * _BASE + w + 1) % _M
            p = p * _BASE % _M
            self.hashes.append(x)
            self.powers.append(p)

    def _same(self, i: int, j: int, n: int) -> bool:
        """By hash: do n words from i and from j agree?"""
        h = self.hashes
        return (h[i + n] - h[j + n] + (h[j] - h[i]) * self.powers[n]) % _M == 0

    def _longest(self, most: int, same) -> int:
        """The largest n up to ``most`` with same(n); NEAR words agree."""
        good, bad = self.NEAR, 2 * self.NEAR
        while bad <= most and same(bad):
            good, bad = bad, 2 * bad
        bad = min(bad, most + 1)
        while bad - good > 1:
            mid = (good + bad) // 2
            if same(mid):
                good = mid
            else:
                bad = mid
        return good

    def ahead(self, i: int, j: int) -> int:
        """How many words from i and from j on agree, i < j. Words that are known to agree at this distance are not read again."""
        ids, most = self.ids, self.size - j
        start, stop = self.seen.get(j - i, (self.size, 0))
        if start <= i < stop:
            return stop - i
        joins = i < start < stop
        cap = start - i if joins else most
        n = min(cap, self.NEAR)
        for k in range(n):
            if ids[i + k] != ids[j + k]:
                return k
        if cap > n:
            n = self._longest(cap, lambda m: self._same(i, j, m))
            differ = self.array[i : i + n] != self.array[j : j + n]
            if differ.any():
                return int(differ.argmax())
            while n < cap and ids[i + n] == ids[j + n]:
                n += 1
        if joins and n == cap:
            n = stop - i
        if n >= self.NEAR:
            self.seen[j - i] = i, i + n
        return n

    def back(self, i: int, j: int) -> int:
        """How many words before i and before j agree, i < j."""
        ids, most = self.ids, i
        for k in range(1, min(most, self.NEAR) + 1):
            if ids[i - k] != ids[j - k]:
                return k - 1
        if most <= self.NEAR:
            return most
        n = self._longest(most, lambda m: self._same(i - m, j - m, m))
        differ = (self.array[i - n : i] != self.array[j - n : j])[::-1]
        if differ.any():
            return int(differ.argmax())
        while n < most and ids[i - n - 1] == ids[j - n - 1]:
            n += 1
        return n


def lyndon(w: Words, reverse: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest Lyndon word from each place on, right to left. The end is smaller than any word in
    both orders."""
    ids, size = w.ids, w.size
    ends: list[int] = []  # of the words on the stack; the last is that of the word right of i
    for i in range(size - 1, -1, -1):
        j = i + 1
        while j < size:
            if (a := ids[i]) != (b := ids[j]):
                if (a > b) != reverse:
                    break
            else:
                n = w.ahead(i, j)
                if j + n == size or (ids[i + n] > ids[j + n]) != reverse:
                    break
            j = ends.pop()  # the suffix from i comes before the one from j: the two words are one
        ends.append(j)
        yield i, j


def runs_in(w: Words) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs among these words."""
    found: set[tuple[int, int, int]] = set()
    for reverse in (False, True):
        last: dict[int, tuple[int, int]] = {}  # of each period the stretch found last: a word within it is no news
        for i, j in lyndon(w, reverse):
            q = j - i
            if TIMES * q > w.size or (known := last.get(q)) and known[0] <= i and j <= known[1]:
                continue
            left, right = i - w.back(i, j), j + w.ahead(i, j)
            last[q] = left, right
            if right - left >= max(LEAST, TIMES * q):
                found.add((left, right - left, q))
    return found


def parts(group: np.ndarray, texts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches, in order and apart from each other, that hold every run of texts whose groups of words hash to ``group``.

    group[i] stands for the words from i on; texts: the text that each place belongs to. The last GROUP - 1 places of a
    text have groups of their own."""
    n = len(group)
    order = np.argsort(group, kind="stable")
    again = np.full(n, n + 1, np.int64)  # places until the same group stands again
    same = group[order[1:]] == group[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    inside = np.zeros(n + 1, np.int32)
    scale = 1
    while scale <= n:
        least = scale // 2 + 1  # the periods of this scale: least to scale
        need = max(1, max(LEAST, TIMES * least) - least - GROUP + 1)
        near = np.flatnonzero(np.diff(np.concatenate([[False], again <= scale, [False]]).astype(np.int8)))
        starts, ends = near[::2], near[1::2]
        wide = ends - starts >= need
        if wide.any():
            np.add.at(inside, starts[wide], 1)
            np.add.at(inside, np.minimum(ends[wide] + scale + GROUP - 1, n), -1)
        scale *= 2
    on = np.cumsum(inside[:n]) > 0
    edges = np.diff(np.concatenate([[-1], texts, [-1]])) != 0  # a stretch ends with its text
    first = on & (np.concatenate([[False], on[:-1]]) < on) | on & edges[:n]
    last = on & (np.concatenate([on[1:], [False]]) < on) | on & edges[1:]
    yield from zip(np.flatnonzero(first).tolist(), (np.flatnonzero(last) + 1).tolist(), strict=True)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a tenth of the documents with a repeat in them, by the checksum of the id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _judged(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """What RESULT says of a text, after doc_id. found: its runs."""
    every = sorted(found, key=lambda r: (r[0], r[2]))
    listed = sha256("".join(f"{s},{n},{q}\n" for s, n, q in every).encode()).hexdigest()
    if not every:
        return 0, None, None, None, None, listed, sha256(b" ".join(words)).hexdigest()
    kept = np.ones(len(words), bool)
    for s, n, q in every:
        kept[s + q : s + n] = False
    best = min(every, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    left = b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])
    return len(every), *best, 1000 * best[1] // best[2], listed, sha256(left).hexdigest()


def numbered(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, looked through together."""
    ids = [numbered(t) for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list] = [[] for _ in texts]
    n = int(bounds[-1])
    if n < LEAST:
        return out
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint64, n)
    whose = np.repeat(np.arange(len(texts)), sizes)
    shape = flat + np.uint64(1) + whose.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    group = np.zeros(n, np.uint64)
    for k in range(GROUP):
        group[: n - k] = group[: n - k] * np.uint64(0xD1B54A32D192ED03) + (shape[k:] ^ (shape[k:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(1, GROUP):  # no group crosses two texts
        alone = bounds[1:][sizes >= k] - k
        group[alone] = alone.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
    for a, z in parts(group, whose):
        t = int(whose[a])
        at = int(bounds[t])
        if z - a >= LEAST:
            out[t] += [(s + a - at, n, q) for s, n, q in runs_in(Words(ids[t][a - at : z - at]))]
    return out


def judge(docs: DataFrame, plant: bool = True) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text): its runs, the one of the greatest exponent, the text without repeats.

    plant: a tenth of the texts get a repeat first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for i in range(b.num_rows):
                own, text = b.column(0)[i].as_py(), b.column(1)[i]
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                ids.append(own)
                texts.append(planted(words, own) if plant else words)
                size += len(words)
                if size >= TOGETHER:
                    yield told(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield told(ids, texts)

    def told(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = [_judged(t, r) for t, r in zip(texts, runs(texts), strict=True)]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(run), RESULT)

"""Packing: whole documents into windows of a fixed number of tokens, planned by non-negative least squares.

A document of n tokens fills n // window windows by itself. What remains of each document is placed as a whole
where possible:

1. the histogram of the remainders' lengths is counted over all documents (at most window - 1 numbers);
2. combinations of one to three lengths that fill a window exactly are enumerated, and their repeat counts are solved
   against the histogram by non-negative least squares, then rounded down to what the histogram holds;
3. residual lengths are packed greedily into exact fills of up to ``DEPTH`` lengths;
4. what is still left is cut into pieces whose lengths are powers of two. Laid out from the longest to the shortest,
   these never cross a window's end. The one window that they can't fill is divided into sequences of powers of two.

So no token of padding is needed. The plan is made of counts only; documents find their places by their rank among
documents of the same remainder, which is a running count over tasks.

Nulls, empty texts: no tokens but the end token. An empty table gives an empty result. Repeated rows and repeated ids
are packed row by row. Columns of the input other than the two that are named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe import default_path, encoder
from ._io import lean, save, slices
from ._words import text_bytes

WINDOW = 1024
DEPTH = 8


# --- the plan: counts only -----------------------------------------------------------------------------------------


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """All sets of up to three of these lengths that fill the window; zeros stand for no length. Bounded by window² / 12."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a = np.flatnonzero(have[:window])
    pairs = a[have[window - a] & (a >= window - a)]
    found = [np.stack([pairs, window - pairs, 0 * pairs], 1)]
    for x in a[a * 3 >= window]:
        y = a[(a <= x) & (x + a < window)]
        z = window - x - y
        ok = (z <= y) & (z > 0)
        ok[ok] &= have[z[ok]]
        found.append(np.stack([np.full(ok.sum(), x), y[ok], z[ok]], 1))
    return np.concatenate(found).astype(np.int64)


def nonnegative_least_squares(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes the lengths used by x repeats of the combinations close to the histogram (accelerated projected gradient)."""
    used = combos > 0
    size = len(hist)
    hits = np.bincount(combos[used], minlength=size)
    step = 1.0 / (3.0 * max(1, hits.max()))  # bounds the largest eigenvalue: three lengths each, hits combinations a length
    scale = np.where(hist > 0, 1.0 / np.sqrt(np.maximum(hist, 1)), 0.0)  # relative errors count
    weight = scale / max(scale.max(), 1e-12)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        total = np.zeros(size)
        for k in range(3):
            total += np.bincount(combos[:, k], y, size)
        total[0] = 0
        miss = (total - hist) * weight**2
        miss[0] = 0
        grad = miss[combos].sum(1)
        new = np.maximum(0, y - step * grad)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def round_down(combos: np.ndarray, x: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats, most used first, never more than the histogram still holds; and what is left of it."""
    left = hist.copy()
    repeats = np.zeros(len(combos), np.int64)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
        n = min(int(round(x[i])), int((left[lengths] // times).min()))
        if n > 0:
            repeats[i] = n
            left[lengths] -= n * times
    return repeats, left


def greedy_fill(left: np.ndarray, window: int, depth: int = DEPTH) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """Exact fills from the longest residual down, each as often as it goes; and the residual that none takes."""
    left = left.copy()
    fills = []
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            taken, room, spent = [longest], window - longest, {longest: 1}
            while room and len(taken) < depth:
                fits = np.flatnonzero(left[: room + 1] - np.bincount(list(spent), list(spent.values()), window + 1)[: room + 1] > 0)
                fits = fits[fits > 0]
                if not len(fits):
                    break
                # A length whose complement is there too ends the fill at once.
                n = next((int(f) for f in fits[::-1] if f == room or (room - f) in fits and (f != room - f or left[f] - spent.get(int(f), 0) > 1)), int(fits[-1]))
                taken.append(n)
                spent[n] = spent.get(n, 0) + 1
                room -= n
            if room:
                break
            times = min(int(left[k]) // v for k, v in spent.items())
            fills.append((taken, times))
            for k, v in spent.items():
                left[k] -= times * v
    return fills, left


@dataclass
class Plan:
    """Places of remainders: rows (length, first rank, repeats, first sequence, offset); from a rank on they are cut.

    cut_from: by length, the first rank that is cut. base: by exponent, where cut pieces of 2**k begin in their row.
    """

    window: int
    slots: np.ndarray
    cut_from: np.ndarray
    bit_rank: np.ndarray  # by length, cut pieces of each exponent in shorter lengths
    base: np.ndarray
    first_cut: int  # the sequence where the cut pieces begin
    total_cut: int
    sequences: int


def make_plan(hist: np.ndarray, window: int) -> Plan:
    """hist[n]: documents with a remainder of n tokens, 0 < n < window."""
    hist = hist.astype(np.int64)
    lengths = np.flatnonzero(hist)
    combos = combinations(window, lengths)
    x = nonnegative_least_squares(combos, hist.astype(float)) if len(combos) else np.zeros(0)
    repeats, left = round_down(combos, x, hist)
    sets = [([int(v) for v in combos[i] if v], int(repeats[i])) for i in np.flatnonzero(repeats)]
    fills, left = greedy_fill(left, window)
    taken = np.zeros(window + 1, np.int64)
    rows, sequence = [], 0
    for members, times in sets + fills:
        offset = 0
        for n in members:
            rows.append((n, taken[n], times, sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    bits = (window - 1).bit_length()
    has = (np.arange(window + 1)[:, None] >> np.arange(bits)) & 1
    of = left[:, None] * has[: len(left)]
    rank = np.cumsum(of, 0) - of
    size = of.sum(0) << np.arange(bits)
    base = np.cumsum(size[::-1])[::-1] - size
    slots = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(window, slots, taken, rank, base, sequence, int(size.sum()), sequence + int(-(-size.sum() // window)))


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of remainders: index of the remainder, start within it, length, sequence, offset."""
    whole = rank < plan.cut_from[length]
    w = np.flatnonzero(whole)
    key = plan.slots[:, 0] << 44 | plan.slots[:, 1]
    s = plan.slots[np.searchsorted(key, length[w] << 44 | rank[w], "right") - 1] if len(w) else np.zeros((0, 5), np.int64)
    parts = [(w, 0 * w, length[w], s[:, 3] + rank[w] - s[:, 1], s[:, 4])]
    c = np.flatnonzero(~whole)
    n, r = length[c], rank[c] - plan.cut_from[length[c]]
    tail = plan.total_cut - plan.total_cut % plan.window
    for k in range(plan.bit_rank.shape[1] - 1, -1, -1):  # the longest piece comes first in a document
        own = (n >> k & 1) == 1
        m = n[own]
        at = plan.base[k] + ((plan.bit_rank[m, k] + r[own]) << k)
        sequence, offset = plan.first_cut + at // plan.window, at % plan.window
        # The last window, if not full, is a row of sequences whose lengths are powers of two.
        end = plan.total_cut - tail
        late = at >= tail
        left, rest = 0, end
        for e in range(plan.bit_rank.shape[1] - 1, -1, -1):
            if rest >> e & 1:
                inside = late & (at - tail >= left) & (at - tail < left + (1 << e))
                sequence = np.where(inside, plan.first_cut + tail // plan.window + bin(end >> (e + 1)).count("1"), sequence)
                offset = np.where(inside, at - tail - left, offset)
                left += 1 << e
        parts.append((c[own], m >> (k + 1) << (k + 1), np.full(len(m), 1 << k), sequence, offset))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- the jobs ------------------------------------------------------------------------------------------------------


def text_ids(path: str, end_id: int):
    """For ``pack``: a batch of (id, text) to the ids of each text, the end id after them."""

    def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, at = encoder(path).encode(batch.column(1))
        return np.insert(ids, at[1:], end_id).astype("<u4", copy=False), at + np.arange(len(at))

    return ids_of


def stored_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For ``pack``: a batch of (id, ids as binary of little-endian unsigned 32-bit numbers); a null has none."""
    data, bounds = text_bytes(batch.column(1))
    return data[: bounds[-1]].copy().view("<u4"), bounds // 4


def ranked(rows: DataFrame, ids_of, window: int) -> DataFrame:
    """Of each document: its tokens n; its rank among the task's documents with the same remainder; the full windows of
    the task's documents before it; and the checksums of all pieces that it may be cut into: full windows, the
    remainder, and the remainder's parts by powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, fulls = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for b in slices(batches):
            ids, at = ids_of(b)
            data, at = memoryview(np.ascontiguousarray(ids)).cast("B"), at.tolist()
            ranks, full, sums = [], [], []
            for start, end in zip(at[:-1], at[1:], strict=True):
                k, rest = divmod(end - start, window)
                ranks.append(int(seen[rest]))
                full.append(fulls)
                seen[rest] += 1
                fulls += k
                cuts = [(start + i * window, start + (i + 1) * window) for i in range(k)]
                if rest:
                    i = end - rest
                    cuts.append((i, end))
                    for e in range(window.bit_length() - 2, -1, -1):
                        if rest >> e & 1:
                            cuts.append((i, i + (1 << e)))
                            i += 1 << e
                sums.append(np.array([crc32(data[4 * x : 4 * y]) for x, y in cuts], "<u4").tobytes())
            n = np.diff(np.array(at, np.int64))
            columns = [b.column(0), pa.array(n), pa.array(np.full(len(n), task, np.int64)), pa.array(ranks, pa.int64()), pa.array(full, pa.int64()), pa.array(sums, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "task", "rank", "fulls", "sums"])

    return rows.mapInArrow(lean(run, "tokens"), T.StructType([rows.schema[0], *(T.StructField(c, T.LongType()) for c in ("n", "task", "rank", "fulls")), T.StructField("sums", T.BinaryType())]))


def pack(rows: DataFrame, ids_of=stored_ids, window: int = WINDOW) -> DataFrame:
    """Pieces of token sequences: (id, start, length, total, sequence_id, offset, crc32 of the piece's ids).

    rows: (id, ids or text), which ``ids_of`` turns into ids. window: a power of two. ``fill`` makes the sequences.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window: a power of two")
    docs = save(ranked(rows.toDF("id", "value"), ids_of, window), "ranked").withColumn("rest", F.col("n") % window)  # ranks stay from here on
    counts = docs.groupBy("task", "rest").agg(F.count("*").alias("c"), F.sum(F.expr(f"n div {window}")).alias("full"))
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # a row for each length below the window
        hist[r["rest"]] = r["c"]
    hist[0] = 0
    plan = make_plan(hist, window)
    first_full = plan.sequences + window.bit_length()
    # Running counts over tasks, a row a task or a row a task and length: documents of a remainder, full windows.
    fulls = counts.groupBy("task").agg(F.sum("full").alias("full"))
    fulls = fulls.select("task", (F.sum("full").over(Window.orderBy("task")) - F.col("full") + first_full).alias("first"))
    before = counts.select("task", "rest", (F.sum("c").over(Window.partitionBy("rest").orderBy("task")) - F.col("c")).alias("before"))
    placed = docs.join(before.join(fulls, "task"), ["task", "rest"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, rest = f["n"].to_numpy(), f["rest"].to_numpy()
            k = n // window
            doc = np.repeat(np.arange(len(f)), k)
            i = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            some = np.flatnonzero(rest)
            which, start, length, sequence, offset = place(plan, rest[some], f["rank"].to_numpy()[some])
            which = some[which]
            whole = length == rest[which]
            longer = np.array([bin(int(r) >> int(x).bit_length()).count("1") for r, x in zip(rest[which], length, strict=True)], np.int64)
            d = np.concatenate([doc, which])
            at = np.concatenate([i, k[which] + np.where(whole, 0, 1 + longer)])
            sums = f["sums"].tolist()
            yield pd.DataFrame({
                "id": f["id"].array[d],
                "start": np.concatenate([i * window, k[which] * window + start]),
                "length": np.concatenate([np.full(len(doc), window), length]),
                "total": n[d],
                "sequence_id": np.concatenate([f["first"].to_numpy()[doc] + i, sequence]),
                "offset": np.concatenate([0 * i, offset]),
                "crc32": [int.from_bytes(sums[x][4 * y : 4 * y + 4], "little") for x, y in zip(d.tolist(), at.tolist(), strict=True)],
            })

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "total", "sequence_id", "offset", "crc32"))])
    return placed.select("id", "n", "rest", (F.col("rank") + F.col("before")).alias("rank"), (F.col("first") + F.col("fulls")).alias("first"), "sums").mapInPandas(lean(run), schema)


def fill(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sequence_id, ids array): the sequences themselves. tokens: (id, ids array<int>), one row an id.

    Needs unique ids, as pieces refer to documents by id. A sequence holds at most a window of tokens.
    """
    cut = pieces.join(tokens, pieces["id"].eqNullSafe(tokens["id"])).select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))


def pack_texts(docs: DataFrame, path: str | None = None, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), encoded with the vocabulary file at ``path``: the digest of each piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). A null text is empty.
    """
    out = pack(docs.select("doc_id", "text"), text_ids(path or default_path(), end_id), window)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc32").alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", "offset")

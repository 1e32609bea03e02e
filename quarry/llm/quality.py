"""Quality by gated attention over passages: a text is a bag of passages, only whole texts have labels.

Every passage of ``PASSAGE`` words is encoded: the shares of byte values, of classes of neighbouring bytes, and
measures of repetition and word shape; then a learned layer. Gated attention (tanh branch times sigmoid branch, softmax
over the text's passages) weighs the passages; the weighted sum goes to a logistic score. All parameters are learned
together in numpy on the driver, by labels of whole texts only.

The model is fitted on at most ``TRAIN_DOCS`` labelled texts of at most ``TRAIN_PASSAGES`` passages together, taken in
the order of a hash of their ids. Scoring runs over all passages of every text.

Null and empty texts are one passage without words. A label row whose id or label is null is not used; of several
labels of an id the largest counts. Repeated documents are scored row by row; other columns are not read, and no id,
language, source or label enters a score. With no labels, or labels of one kind, the score is the constant 0.5 or that
kind's share. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import lean
from ._words import WORD_HASH, steps, text_bytes, word_spans

PASSAGE = 64
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 60_000
HIDDEN, ATTENTION = 24, 16

# Classes of bytes: lower, upper, digit, space, new line, sentence marks, other ASCII, lead and following non-ASCII.
_KIND = np.full(256, 6, np.int64)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x20], _KIND[0x0A] = 0, 1, 2, 3, 4
_KIND[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 5
_KIND[0xC0:], _KIND[0x80:0xC0] = 7, 8
#: ASCII bytes one by one, letters folded; all others share one.
_BYTE = np.full(256, 95, np.int64)
_BYTE[0x20:0x7F] = np.arange(95)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
WIDTH = 96 + 81 + 10


def passages(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges i..j of texts: i, j, the encoded passages, and the bounds of each text's passages (at least one)."""
    data, bounds = text_bytes(column)
    for i, j in steps(bounds):
        part, b = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        starts, ends, at = word_spans(part, b, "spaced")
        n = np.diff(at)
        count = np.maximum(1, -(-n // PASSAGE))
        edge = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(j - i), count)
        k = np.arange(edge[-1]) - edge[:-1][doc]
        # A passage begins at its first word; the first one at the text's beginning.
        first = np.minimum(at[:-1][doc] + k * PASSAGE, len(starts))
        begin = np.where(k == 0, b[:-1][doc], np.append(starts, len(part))[first])
        m = int(edge[-1])
        x = np.zeros((m, WIDTH), np.float32)
        size = np.diff(np.append(begin, len(part)))
        owner = np.repeat(np.arange(m), size)
        x[:, :96] = np.bincount(owner * 96 + _BYTE[part], minlength=m * 96).reshape(m, 96)
        if len(part) > 1:
            kind = _KIND[part]
            x[:, 96:177] = np.bincount(owner[1:] * 81 + kind[:-1] * 9 + kind[1:], minlength=m * 81).reshape(m, 81)
        x[:, :177] /= np.maximum(size, 1)[:, None]
        words = WORD_HASH.spans(part, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        nw = np.diff(np.append(first, len(words)))
        w = np.maximum(nw, 1)
        own = np.repeat(np.arange(m), nw)
        length = (ends - starts).astype(np.float64)
        order = np.lexsort((words, own))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (own[order][1:] != own[order][:-1])
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
        x[:, 177] = np.bincount(own[order][fresh], minlength=m) / w
        x[:, 178] = np.bincount(own[again], minlength=m) / w
        x[:, 179] = np.bincount(own, length, m) / w / 10
        x[:, 180] = np.sqrt(np.maximum(0, np.bincount(own, length**2, m) / w - (10 * x[:, 179]) ** 2)) / 10
        last = _KIND[part[ends - 1]] if len(words) else np.zeros(0, np.int64)
        for c, v in enumerate((5, 6, 1, 2)):
            x[:, 181 + c] = np.bincount(own[last == v], minlength=m) / w
        x[:, 185] = np.bincount(own[length == 1], minlength=m) / w
        x[:, 186] = np.minimum(nw, PASSAGE) / PASSAGE
        yield i, j, x, edge


class Model:
    """score(passages, bounds): 0 to 1 for each text. ``p`` holds the parameters, ``mean`` and ``scale`` the encoding's."""

    def __init__(self, width: int = WIDTH, seed: int = 9):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"e": draw(width, HIDDEN), "eb": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, ATTENTION), "u": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION, 1), "o": draw(HIDDEN, 1), "ob": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, edge: np.ndarray) -> tuple:
        p, n = self.p, np.diff(edge)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["e"] + p["eb"])
        v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = ((v * u) @ p["a"])[:, 0]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, edge[:-1]), n))
        w = e / np.repeat(np.add.reduceat(e, edge[:-1]), n)
        bag = np.add.reduceat(h * w[:, None], edge[:-1])
        logit = (bag @ p["o"])[:, 0] + p["ob"][0]
        return z, h, v, u, w, bag, logit

    def score(self, x: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(x, edge)[-1].astype(np.float64)))

    def fit(self, x: np.ndarray, edge: np.ndarray, y: np.ndarray, rounds: int = 30, batch: int = 64, rate: float = 4e-3) -> "Model":
        if not len(y) or y.min() == y.max():
            self.p["o"][:] = 0
            share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
            self.p["ob"][:] = np.log(share / (1 - share))
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        # Both kinds weigh the same.
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        rng, p, turn = np.random.default_rng(2), self.p, 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        planned = rounds * -(-len(y) // batch)
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                own = order[k : k + batch]
                n = np.diff(edge)[own]
                at = np.concatenate([[0], np.cumsum(n)])
                rows = np.repeat(edge[:-1][own] - at[:-1], n) + np.arange(at[-1])
                z, h, v, u, w, bag, logit = self.forward(x[rows], at)
                d = ((1 / (1 + np.exp(-logit)) - y[own]) * weight[own] / len(own)).astype(np.float32)
                dbag = d[:, None] * p["o"][:, 0]
                spread = np.repeat(dbag, n, 0)
                dw = (spread * h).sum(1)
                ds = w * (dw - np.repeat(np.add.reduceat(w * dw, at[:-1]), n))
                dvu = ds[:, None] * p["a"][:, 0]
                dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
                dh = (spread * w[:, None] + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
                grads = {"e": z.T @ dh, "eb": dh.sum(0), "v": h.T @ dv, "u": h.T @ du, "a": ((v * u) * ds[:, None]).sum(0)[:, None], "o": bag.T @ d[:, None], "ob": d.sum(keepdims=True)}
                turn += 1
                now = rate * max(0.05, 1 - turn / planned)
                for name, g in grads.items():
                    g = g + 1e-4 * p[name]
                    m, s = moments[name]
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p[name] -= (now * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
        return self


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, passages, data): the encoded passages of ``docs`` (doc_id, text) as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x, edge in passages(b.column(1)):
                raw = memoryview(x.astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(edge)), pa.array([raw[4 * WIDTH * s : 4 * WIDTH * e].tobytes() for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "passages", "data"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), T.StructType([docs.schema["doc_id"], T.StructField("passages", T.LongType()), T.StructField("data", T.BinaryType())]))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_passages: int = TRAIN_PASSAGES) -> Model:
    """A model fitted on ``labels`` (doc_id, label 0 or 1) of ``docs`` (doc_id, text); both limits bound the driver's memory."""
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    known = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    picked, total = {}, 0
    for r in known.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect():
        most = r["n"] // (2 * PASSAGE) + 1  # a word and its space take two bytes at least
        if total + most <= 4 * max_passages:
            picked[r["doc_id"]] = r["label"]
            total += most
    model = Model()
    if not picked:
        return model.fit(np.zeros((0, WIDTH), np.float32), np.zeros(1, np.int64), np.zeros(0))
    chosen = docs.filter(F.col("doc_id").isin(list(picked))).groupBy("doc_id").agg(F.min("text").alias("text"))
    x, y, n, left = [], [], [], max_passages
    for r in encoded(chosen).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if r["passages"] <= left:
            left -= r["passages"]
            x.append(np.frombuffer(r["data"], "<f4").reshape(-1, WIDTH))
            n.append(r["passages"])
            y.append(picked[r["doc_id"]])
    return model.fit(np.concatenate(x), np.concatenate([[0], np.cumsum(n)]), np.array(y, np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x, edge in passages(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(model.score(x, edge))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"


def classify(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from ``labels`` (doc_id, quality) that are not held out."""
    model = train(docs, labels.filter(f"not {held_out}").select("doc_id", F.col("quality").alias("label")))
    return score(docs, model).select("doc_id", F.expr(held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``least``."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x, edge in passages(b.column(place)):
                yield b.slice(i, j - i).filter(pa.array(model.score(x, edge) >= least))

    return docs.mapInArrow(lean(run), docs.schema)

"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document's shingles are its runs of five words (a shorter document is one shingle). A shingle weighs its count in the
document times the mean inverse document frequency of its words, ``1 + ln((1 + N) / (1 + df)) / ln(1 + N)``, with df
over all documents, kept to an eighth of an octave. Each of 48 samples of a document picks one (shingle, quantised
weight) by the improved scheme (0 bits of the weight's fraction are needed: equal picks have probability equal to the
weighted Jaccard similarity). Four samples make a band; documents that share a band's bucket are candidates.

Candidates are verified by exact weighted Jaccard similarity of at least 0.8:

1. documents of the same row of words are one *text* from the start;
2. in each bucket, every text is compared with the bucket's leader, the text that shares most buckets with others;
3. after the linked texts are joined into classes, texts of a bucket that are not of its largest class meet all its
   texts of other classes, unless a bound rules the pair out: two texts share at most the weight that is not their own,
   that is, of shingles that no other text left at this stage has. So within a bucket no link between classes is lost,
   while a large group of near copies costs a comparison a member instead of one a pair.

Before texts are fetched, a pair must agree in a sketch of three bits of each sample: at most ``SKETCH_MISSES`` of the 48
may differ (with a similarity of 0.8 about 8 differ; more than 21 do once in a million pairs). The condition is part of
the joins, so that texts that only share a passage are not paired.

Results: ``near_duplicates`` gives a class id for every row, the smallest doc_id of its class; ``first_of_each`` the first
row of each class. Classes are made of rows and their texts, so an id that several rows share, or a null, joins nothing.
Texts without words (null, empty) are classes of their own. Repeated rows are copies. A null doc_id is kept; it is a
class's id only if all its ids are null. ``near_duplicates`` does not read other columns. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _totals
from ._io import discard, lean, save, stable, tidy
from ._words import hashed_words, mix

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
SKETCH_MISSES = 21
#: Texts of a bucket that meet others in one task.
BLOCK_TEXTS = 256
#: UTF-8 bytes of a chunk of documents, apart from what its last document has beyond; of chunks that meet in a task.
CHUNK_BYTES, TASK_BYTES = 4 << 20, 32 << 20
#: Slots of the filter that keeps candidates' texts; a fixed size, and a wrong "yes" does no harm.
FILTER_BITS = 1 << 24

_ODD = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution: r, 1 / r, ln c."""
    x = np.concatenate([np.linspace(0, 20, 400_001), np.linspace(20, 60, 10_001)[1:]])
    q = np.interp((np.arange(4096) + 0.5) / 4096, 1 - (1 + x) * np.exp(-x), x)
    return q.astype(np.float32), (1 / q).astype(np.float32), np.log(q).astype(np.float32)


def weighted(words: np.ndarray, at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, their weights, and the bounds of each text's."""
    n = np.diff(at)
    count = np.maximum(n - WORDS + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    known = np.concatenate([[0.0], np.cumsum(idf, dtype=np.float64)])
    size = np.minimum(n, WORDS)[doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(WORDS):
        h += np.where(k < size, padded[first + k] * _ODD[k], np.uint64(0))
    h = mix(h)
    weight = (known[first + size] - known[first]) / size
    order = np.lexsort((h, doc))
    h, doc, weight = h[order], doc[order], weight[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(h)))
    return h[start], weight[start] * times, np.searchsorted(doc[start], np.arange(len(n) + 1))


def samples(h: np.ndarray, weight: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """(texts, k) unsigned 32-bit names of picks; every text needs a shingle."""
    r, back, ln_c = _tables()
    ln_w = np.log(weight).astype(np.float32)
    out = np.empty((len(at) - 1, k), np.uint32)
    low = h & np.uint64(0xFFFFFFFF)
    for i in range(k):
        u = h * _ODD[8 + i]
        u ^= u >> np.uint64(29)
        u *= _ODD[7]
        u ^= u >> np.uint64(32)
        a = (u & np.uint64(4095)).astype(np.int32)
        c = ((u >> np.uint64(12)) & np.uint64(4095)).astype(np.int32)
        beta = (u >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(ln_w * back[a] + beta)
        ln_a = ln_c[c] - r[a] * (t - beta + np.float32(1))
        bits = ln_a.view(np.uint32)
        bits = bits ^ np.where(bits >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))  # in the order of the numbers
        name = (low + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        best = np.minimum.reduceat(bits.astype(np.uint64) << np.uint64(32) | name, at[:-1])
        out[:, i] = best & np.uint64(0xFFFFFFFF)
    return out


def text_keys(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, 2) unsigned 64-bit: a 128-bit name for each text's row of words."""
    place = (np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
    out = np.empty((len(at) - 1, 2), np.uint64)
    for k in range(2):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words * _ODD[60 + k] + place * _ODD[62 + k]), dtype=np.uint64)])
        out[:, k] = mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64))
    return out


class _Chunk:
    """Some whole documents: names, texts, words; its number tells its place and contents."""

    def __init__(self, task: int, k: int, names: list[pa.Array], texts: list[pa.Array]):
        self.names, self.texts = pa.concat_arrays(names), pa.concat_arrays(texts)
        words, sizes = [], []
        for _, _, w, at in hashed_words(self.texts):
            words.append(w)
            sizes.append(np.diff(at))
        self.words = np.concatenate(words)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.vocab, self.index = np.unique(self.words, return_inverse=True)
        keys = text_keys(self.words, self.at)
        self.keys = keys
        seen = mix(keys[:, 0] + np.arange(len(keys), dtype=np.uint64)).sum(dtype=np.uint64)
        self.number = int(mix(np.array([seen + np.uint64((task << 20) + k)], np.uint64)).astype(np.int64)[0])


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Chunk]:
    from pyspark import TaskContext

    task, k, held = TaskContext.get().partitionId(), 0, 0
    names, texts = [], []
    for b in batches:
        i = 0
        while i < b.num_rows:
            j, n = i, 0
            data = b.column(1)
            sizes = np.diff(np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)) if len(data) else np.zeros(0)
            n = np.cumsum(sizes[i:])
            j = min(b.num_rows, i + 1 + int(np.searchsorted(n, size - held)))
            names.append(b.column(0).slice(i, j - i))
            texts.append(data.slice(i, j - i))
            held += int(n[j - i - 1])
            i = j
            if held >= size:
                yield _Chunk(task, k, names, texts)
                names, texts, held, k = [], [], 0, k + 1
    if names:
        yield _Chunk(task, k, names, texts)


def _idf(classes: np.ndarray, documents: int) -> np.ndarray:
    df = np.exp2(np.arange(256) / 8)
    return (1 + np.log((1 + documents) / (1 + np.minimum(df, documents))) / np.log(2 + documents))[classes]


def signed(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(row, doc_id, key, weight, bands, sketch, classes, text) as a written table, and the number of documents.

    row: a number of its own for every row. classes: a byte for each word, its document frequency as the rounded eighth
    of an octave. doc_id may be of any type.
    """
    docs = stable(docs.select("doc_id", "text"))
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = _totals.buckets_for((size or 0) // 8)
    parts = max(1, -(-(size or 0) // TASK_BYTES))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, chunk_bytes):
            m = len(c.names)
            pair = np.unique(c.index.astype(np.int64) * m + np.repeat(np.arange(m), np.diff(c.at)))
            counts = np.bincount(pair // m, minlength=len(c.vocab)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([c.number]), pa.array([c.vocab.astype("<u8").tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], ["chunk", "keys", "counts", "more"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([c.number]), pa.ListArray.from_arrays(pa.array([0, len(c.names)], pa.int32()), c.names), pa.ListArray.from_arrays(pa.array([0, len(c.texts)], pa.int32()), c.texts)], ["chunk", "ids", "texts"])

    kind = docs.schema["doc_id"].dataType
    found = _totals.by_chunk(_totals.totals(docs.mapInArrow(lean(vocabulary), "chunk long, keys binary, counts binary, more binary"), buckets, lambda t: np.minimum(255, np.rint(8 * np.log2(t))).astype(np.uint8)))
    text = docs.mapInArrow(lean(whole), T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("texts", T.ArrayType(T.StringType()))]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("key", T.BinaryType()), T.StructField("weight", T.DoubleType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("classes", T.BinaryType()), T.StructField("text", T.StringType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for r in range(b.num_rows):
                c = _Chunk(0, 0, [b.column(0).slice(r, 1).flatten()], [b.column(1).slice(r, 1).flatten()])
                values = np.frombuffer(b"".join(b.column(2)[r].as_py() or []), np.uint8)
                if len(values) != len(c.vocab):
                    raise RuntimeError("the input gave other rows when read again; write it to a table first")
                of = values[c.index]
                for i in range(0, len(c.names), 256):
                    j = min(len(c.names), i + 256)
                    at = c.at[i : j + 1] - c.at[i]
                    own = slice(c.at[i], c.at[j])
                    h, w, bounds = weighted(c.words[own], at, _idf(of[own], n))
                    some = np.flatnonzero(np.diff(bounds))
                    bands, sketch = np.zeros((j - i, 0), np.uint64), np.zeros((j - i, 3), np.uint64)
                    if len(some):
                        s = samples(h, w, np.append(bounds[some], len(h)), BANDS * ROWS).astype(np.uint64).reshape(len(some), BANDS, ROWS)
                        bands = np.zeros((j - i, BANDS), np.uint64)
                        bands[some] = mix((s * _ODD[:ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[5])
                        place = np.arange(BANDS * ROWS, dtype=np.uint64)
                        for bit in range(3):
                            sketch[some, bit] = ((s.reshape(len(some), -1) >> np.uint64(bit) & np.uint64(1)) << place).sum(1, dtype=np.uint64)
                    total = np.add.reduceat(np.append(w, 0), bounds[:-1]) * (np.diff(bounds) > 0)
                    raw, has = c.keys[i:j].astype("<u8").tobytes(), np.diff(bounds) > 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(row, row + j - i)),
                            c.names.slice(i, j - i),
                            pa.array([raw[16 * x : 16 * x + 16] if y else None for x, y in enumerate(has)], pa.binary()),
                            pa.array(total),
                            pa.array([row.tolist() if y else [] for row, y in zip(bands.astype(np.int64), has, strict=True)] if len(some) else [[]] * (j - i), pa.list_(pa.int64())),
                            pa.array(sketch.astype(np.int64).tolist(), pa.list_(pa.int64())),
                            pa.array([of[c.at[x] : c.at[x + 1]].tobytes() for x in range(i, j)], pa.binary()),
                            c.texts.slice(i, j - i),
                        ],
                        schema.names,
                    )
                    row += j - i

    both = text.repartition(parts, "chunk").join(found.repartition(parts, "chunk"), "chunk", "left")
    return save(both.select("ids", "texts", "values").mapInArrow(lean(sign), schema), "signed"), n


def _texts_of(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """(key, classes, text) of the texts with a wanted ``key`` (and a few more), one row a text."""
    # A fixed number of slots tells which texts may be wanted; at most FILTER_BITS / 64 rows come back.
    marks = wanted.select(F.expr(f"cast(pmod(xxhash64(key), {FILTER_BITS}) as long)").alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("m")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[marks["w"].to_numpy(np.int64)] = marks["m"].to_numpy(np.int64)
    sent = table.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(0).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((sent.value[s // 64] >> (s % 64)) & 1 == 1))

    rows = table.filter("key is not null").select(F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("slot"), "key", "classes", "text")
    return rows.mapInArrow(lean(keep), rows.schema).groupBy("key").agg(F.first("classes").alias("classes"), F.first("text").alias("text"))


def _vectors(texts: pa.Array, classes: pa.Array, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, sizes = [], []
    for _, _, w, at in hashed_words(texts):
        words.append(w)
        sizes.append(np.diff(at))
    raw = np.frombuffer(b"".join(classes.to_pylist()), np.uint8)
    return weighted(np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), _idf(raw, documents))


def _own_weights(keys: DataFrame, table: DataFrame, documents: int) -> DataFrame:
    """(h, own): of each text of ``keys``, by the hash of its key, the weight of shingles that no other of them has."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                h, w, at = _vectors(part.column(2), part.column(1), documents)
                name = np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(name), pa.array(w)], ["shingle", "h", "w"])

    texts = _texts_of(keys, table).join(keys, "key", "left_semi").select(F.xxhash64("key").alias("h"), "classes", "text")
    rows = texts.mapInArrow(lean(shingles), "shingle long, h long, w double")
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("h").alias("h"), F.min("w").alias("w")).filter("n = 1")
    return once.groupBy("h").agg(F.sum("w").alias("own"))


def _between(mixed: DataFrame, texts: DataFrame, table: DataFrame, documents: int, similarity: float) -> DataFrame:
    """Links (a, b, similarity) between a bucket's strays, the texts not of its main class, and its texts of other classes.

    Texts of a bucket meet in blocks of bounded size, so only links leave a task; a pair is looked at in the first of the
    buckets that it shares, and not where other links of the block join its classes anyway.
    """
    own = save(_own_weights(mixed.select("key").distinct(), table, documents), "own")
    keys = mixed.select("key").distinct()
    whole = _texts_of(keys, table).join(texts.select("key", "weight", "bands", "sketch"), "key").withColumn("h", F.xxhash64("key")).join(own, "h", "left").select("key", "weight", "bands", "sketch", F.coalesce("own", F.lit(0.0)).alias("own"), "classes", "text")
    rows = mixed.select("bucket", "key", "label", (~F.col("label").eqNullSafe(F.col("main"))).alias("stray"), F.ceil(F.col("strays") / BLOCK_TEXTS).alias("si"), F.ceil(F.col("n") / BLOCK_TEXTS).alias("sj"))
    place = lambda size: F.pmod(F.xxhash64("key", "bucket"), F.col(size))
    left = rows.filter("stray").select("bucket", "key", "label", "stray", F.lit(True).alias("left"), place("si").alias("i"), F.explode(F.sequence(F.lit(0), F.col("sj") - 1)).alias("j"))
    right = rows.select("bucket", "key", "label", "stray", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("si") - 1)).alias("i"), place("sj").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        get = lambda c: t[c].combine_chunks()
        side = get("left").to_numpy(zero_copy_only=False)
        s, m = np.flatnonzero(side), np.flatnonzero(~side)
        bucket, keys, labels = t["bucket"][0].as_py(), t["key"].to_pylist(), t["label"].to_pylist()
        numbers = {x: n for n, x in enumerate(dict.fromkeys(labels))}
        label = np.array([numbers[x] for x in labels])
        weight, private, stray = (get(c).to_numpy(zero_copy_only=False) for c in ("weight", "own", "stray"))
        bands, sketch = (np.array(t[c].to_pylist(), np.int64) for c in ("bands", "sketch"))
        order = np.argsort(np.argsort(np.array(keys, dtype=object)))
        ok = np.zeros((len(s), len(m)), bool)
        if len(s) and len(m):
            least, most = np.minimum.outer(weight[s], weight[m]), np.maximum.outer(weight[s], weight[m])
            shared = np.minimum.outer((weight - private)[s], (weight - private)[m])
            misses = np.bitwise_count(np.bitwise_or.reduce(sketch[s][:, None, :] ^ sketch[m][None, :, :], axis=2))
            ok = (label[s][:, None] != label[m][None, :]) & (least >= similarity * most - 1e-9) & (shared * (1 + similarity) >= similarity * (least + most) - 1e-9) & (misses <= SKETCH_MISSES)
            ok &= ~stray[m][None, :] | (order[s][:, None] < order[m][None, :])  # two strays meet once
        x, y = np.nonzero(ok)
        x, y = s[x], m[y]
        first = bands[x, (bands[x] == bands[y]).argmax(1)] == bucket
        x, y = x[first], y[first]
        links: tuple[list, list, list] = ([], [], [])
        if len(x):
            need = np.unique(np.concatenate([x, y]))
            at = np.zeros(len(keys), np.int64)
            at[need] = np.arange(len(need))
            h, w, edge = _vectors(get("text").take(pa.array(need)), get("classes").take(pa.array(need)), documents)
            parent = list(range(len(numbers)))

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                c, d = root(label[p]), root(label[q])
                if c != d and (v := _jaccard(h, w, edge, at[p], at[q])) >= similarity - 1e-9:
                    parent[c] = d
                    for out, value in zip(links, (keys[p], keys[q], v), strict=True):
                        out.append(value)
        if t.nbytes > 1 << 20:
            tidy()
        return pa.table({"a": pa.array(links[0], pa.binary()), "b": pa.array(links[1], pa.binary()), "similarity": pa.array(links[2], pa.float64())})

    blocks = left.unionByName(right).join(whole, "key")
    return save(blocks.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary, similarity double"), "between")


def _jaccard(h: np.ndarray, w: np.ndarray, edge: np.ndarray, a: int, b: int) -> float:
    """Weighted Jaccard similarity of two of the texts whose distinct shingles stand in ``h``."""
    x, y, v, u = h[edge[a] : edge[a + 1]], h[edge[b] : edge[b + 1]], w[edge[a] : edge[a + 1]], w[edge[b] : edge[b + 1]]
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    least = np.minimum(v[same], u[at[same]]).sum()
    return float(least / (v.sum() + u.sum() - least))


def _verified(pairs: DataFrame, table: DataFrame, documents: int, similarity: float) -> DataFrame:
    """(a, b, similarity) of pairs of keys (a, b) whose texts reach the similarity; written."""
    # A written table on one side and plain rows on the other: Spark's skew join can divide the pairs of one leader.
    texts = save(_texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")), table), "candidates")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("classes").alias("ca"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("key").alias("b"), F.col("classes").alias("cb"), F.col("text").alias("tb")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                both_texts = pa.concat_arrays([part.column(2), part.column(4)])
                h, w, edge = _vectors(both_texts, pa.concat_arrays([part.column(3), part.column(5)]), documents)
                found = [_jaccard(h, w, edge, x, part.num_rows + x) for x in range(part.num_rows)]
                sim = np.array(found)
                yes = pa.array(sim >= similarity - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(yes), part.column(1).filter(yes), pa.array(sim).filter(yes)], ["a", "b", "similarity"])

    return save(both.select("a", "b", "ta", "ca", "tb", "cb").mapInArrow(lean(judge), "a binary, b binary, similarity double"), "links")


def _classes(texts: DataFrame, links: DataFrame) -> DataFrame:
    """(key, label) of the texts with links, written: the smallest row of its class, by passing labels along links and
    from label to label. Joins are between written tables, so that Spark can divide the links of one text."""
    both = save(links.select("a", "b").union(links.select("b", "a")).toDF("key", "other"), "both")
    labels = save(texts.select("key", "row").join(both.select("key"), "key", "left_semi").withColumn("label", F.col("row")), "labels")
    while True:
        near = both.join(labels.select("key", "label"), "key").groupBy(F.col("other").alias("key")).agg(F.min("label").alias("near"))
        new = save(labels.join(near, "key", "left").select("key", "row", F.least("label", "near").alias("label"), F.col("label").alias("old")), "near")
        # A label is itself the row of a text: take that text's label.
        step = new.filter("row > label").select("key", "label").join(new.select(F.col("row").alias("label"), F.col("label").alias("further")), "label").select("key", "further")
        last, labels = labels, save(new.join(step, "key", "left").select("key", "row", F.least("label", "further").alias("label"), "old"), "labels")
        discard(last, new)
        if not labels.filter("label != old").limit(1).count():
            discard(both)
            return labels.select("key", "label")


def _labels(table: DataFrame, documents: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(key, row, name) of every text, row and name: the smallest row and doc_id with it; (key, label) of those with
    links, label: the smallest row of the class. Both are written."""
    name = F.min("doc_id") if not isinstance(table.schema["doc_id"].dataType, T.StructType) else F.lit(None)
    texts = save(table.filter("key is not null").groupBy("key").agg(F.min("row").alias("row"), name.alias("name"), *(F.first(c).alias(c) for c in ("weight", "bands", "sketch"))), "texts")
    band = texts.select("key", F.explode("bands").alias("bucket"))
    full = save(band.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "full")
    shared = save(band.join(full, "bucket"), "shared")
    # The leader of a bucket is the text that shares most buckets with most others: the original among its copies.
    degree = save(shared.groupBy("key").agg(F.sum("n").alias("degree")), "degree")
    leaders = save(shared.join(degree, "key").groupBy("bucket").agg(F.max(F.struct("degree", F.xxhash64("key").alias("h"), "key"))["key"].alias("a")), "leaders")
    crowd = save(shared.select("bucket", "key").join(leaders, "bucket"), "buckets")
    discard(full, shared, degree, leaders)
    facts = lambda key, tag: texts.select(F.col("key").alias(key), F.col("weight").alias(f"w{tag}"), *(F.col("sketch")[i].alias(f"s{i}{tag}") for i in range(3)))
    # A similarity is at most the ratio of weights.
    close = f"least(wa, wb) >= {similarity} * greatest(wa, wb) - 1e-9 and bit_count((s0a ^ s0b) | (s1a ^ s1b) | (s2a ^ s2b)) <= {SKETCH_MISSES}"
    pairs = crowd.filter("key != a").select("a", F.col("key").alias("b")).distinct().join(facts("a", "a"), "a").join(facts("b", "b"), "b").filter(close).select("a", "b")
    links = _verified(pairs, table, documents, similarity)
    labels = _classes(texts, links)
    # Buckets with texts of several classes; in each, the class with most texts of the bucket. Leaders have met all.
    linked = texts.select("key", "row").join(labels, "key", "left").select("key", F.coalesce("label", "row").alias("label"))
    known = save(crowd.filter("key != a").select("bucket", "key").join(linked, "key"), "known")
    sizes = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("kinds")).filter("kinds > 1").select("bucket", F.col("m.label").alias("main"), "n", (F.col("n") - F.col("m.n")).alias("strays"))
    mixed = save(known.join(save(largest, "largest"), "bucket"), "mixed")
    if mixed.limit(1).count():
        more = _between(mixed, texts, table, documents, similarity)
        if more.limit(1).count():
            labels = _classes(texts, links.union(more.select("a", "b", "similarity")))
    discard(crowd, known)
    return texts, labels


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs`` (doc_id, text)."""
    table, documents = signed(docs, chunk_bytes)
    texts, labels = _labels(table, documents, similarity)
    # The smallest id of each class of several texts; all others have that of their own text.
    named = texts.select("key", "name").join(labels, "key")
    least = save(named.groupBy("label").agg(F.min("name").alias("class_id")), "least")
    ids = save(labels.join(least, "label").select("key", "class_id"), "ids")
    every = save(texts.select("key", "name").join(ids, "key", "left").select("key", F.when(F.col("class_id").isNull(), F.col("name")).otherwise(F.col("class_id")).alias("class_id")), "class_ids")
    found = table.select("doc_id", "key").join(every, "key", "left")
    return found.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def first_of_each(docs: DataFrame, similarity: float = SIMILARITY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their class; texts without words stay."""
    rest = [c for c in docs.columns if c != "text"]
    table, documents = signed(docs.select(F.struct(*(F.col(c) for c in rest), F.lit(0).alias("_")).alias("doc_id"), "text"), chunk_bytes)
    texts, labels = _labels(table, documents, similarity)
    # Rows that go: all but the first of each text, and the texts that are not the first of their class.
    later = labels.join(texts.select("key", F.col("row").alias("own")), "key").filter("own != label").select("key")
    first = save(texts.select("key", F.col("row").alias("first")).join(later, "key", "left_anti"), "firsts")
    gone = save(table.select("key", "row").filter("key is not null").join(first, "key", "left").filter("first is null or row != first").select("row"), "gone")
    return table.join(gone, "row", "left_anti").select(*(F.col("text") if c == "text" else F.col("doc_id").getField(c).alias(c) for c in docs.columns))

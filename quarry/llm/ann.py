"""Approximate nearest neighbours by inverted lists and adaptive dimension scans.

Vectors are extended by one component so that a larger inner product is a smaller distance, turned by a random
rotation, and assigned to the nearest of some centroids. A list is stored in blocks of bounded size, the rotated
components in column blocks of ``COLUMNS``.

A query probes the lists with the nearest centroids, in two rounds. The first lists, as many as hold enough rows, give
its limit: the distance of the k-th best of them. In the blocks of the other lists partial distances grow by a column
block at a time; a candidate is abandoned as soon as its partial distance, scaled to all components, exceeds the limit
by more than a hypothesis test at the present number of components allows. Survivors are scored exactly, in double
precision, on the original vectors. A query that has found fewer than k is taken to all lists.

Centroids are fitted, and the number of probed lists is chosen, on a sample: at most ``SAMPLE_ROWS`` rows and
``SAMPLE_NUMBERS`` numbers, and at most a tenth of the rows (but ``SAMPLE_LEAST``). Every row is indexed; no answer comes
from the sample. The number of lists is the square root of the number of rows, at most a sixteenth of the sample's rows.
The number of probed lists is the smallest that gives ``RECALL`` for the sample's rows among themselves, at the depth
that k in the whole table has in the sample.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of
different lengths have no inner product: each length is searched on its own, so a query meets candidates of its length.
Long vectors are turned in pieces of ``PIECE`` components, and blocks hold fewer of them. Repeated rows (id and vector)
count once as candidates; of several vectors of an id, the smallest is its query. Ties go to the smaller id. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import lean, save

COLUMNS = 16
SAMPLE_ROWS, SAMPLE_NUMBERS, SAMPLE_LEAST = 32768, 2 << 20, 256
RECALL = 0.98
#: Rows and numbers of a block of a list at most; queries that are routed together.
BLOCK_ROWS, BLOCK_NUMBERS, ROUTE = 2048, 1 << 20, 2048
#: Components that are turned together.
PIECE = 1024
#: Of the hypothesis test: how many standard deviations a scaled partial distance may be too large.
EPSILON = 2.1
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v is array<float> if ``embedding`` is, else array<double>."""
    kind = vectors.schema["embedding"].dataType
    to = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> cast(x as {to}))").alias("v")).filter("vec_id is not null and size(v) > 0")
    return rows.filter(f"forall(v, x -> x is not null and not isnan(x) and abs(x) < {to}('Infinity')) and exists(v, x -> x != 0)")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Index:
    """What all tasks know: rotation, centroids, the largest norm, sizes of lists, the number of probes."""

    def __init__(self, sample: np.ndarray, rows: int, largest: float, lists: int | None = None, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.dim, self.largest = sample.shape[1] + 1, largest
        turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0].astype(np.float32)
        whole, rest = divmod(self.dim, PIECE)
        self.turns = ([turn(PIECE)] if whole else []) + ([turn(rest)] if rest else [])
        self.order = rng.permutation(self.dim) if whole else None  # pieces take components from everywhere
        x = self.rotated(sample)
        n = lists or int(np.clip(np.sqrt(rows), 1, max(1, len(x) // 16)))
        self.centroids = x[rng.choice(len(x), min(n, len(x)), replace=False)]
        for _ in range(12):
            near = self._nearest(x)
            size = np.bincount(near, minlength=len(self.centroids))
            total = np.zeros_like(self.centroids)
            np.add.at(total, near, x)
            self.centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], self.centroids).astype(np.float32)
        self.sizes = np.zeros(len(self.centroids), np.int64)
        self.probes = len(self.centroids)

    def _distances(self, x: np.ndarray) -> np.ndarray:
        """Up to a constant of each row."""
        return (self.centroids * self.centroids).sum(1) - 2 * (x @ self.centroids.T)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64)] + [self._distances(x[i : i + 2048]).argmin(1) for i in range(0, len(x), 2048)])

    def rotated(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Extended and rotated; a query's extra component is 0."""
        wide = v.astype(np.float64)
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.largest**2 - (wide * wide).sum(1)))
        x = np.concatenate([wide, extra[:, None]], 1).astype(np.float32)
        if self.order is not None:
            x = x[:, self.order]
        return np.concatenate([x[:, a : a + PIECE] @ self.turns[0 if a + PIECE <= self.dim else -1] for a in range(0, self.dim, PIECE)], 1)

    def lists(self, v: np.ndarray) -> np.ndarray:
        return self._nearest(self.rotated(v))

    def probed(self, v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each query, nearest first, and how many of them hold ``least`` rows."""
        order = np.argsort(self._distances(self.rotated(v, True)), 1, kind="stable")
        enough = np.cumsum(self.sizes[order], 1) >= least
        return order, np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1])

    def calibrate(self, sample: np.ndarray, rows: int, k: int, queries: int = 2048) -> None:
        """Probes that find RECALL of the best of ``sample`` in it, of as many as there are of the whole table's k."""
        depth = int(np.clip(-(-k * len(sample) // max(1, rows)), 1, max(1, len(sample) - 1)))
        own, need = self.lists(sample), [np.zeros(0, np.int64)]
        step = max(1, len(sample) // queries)
        for a in range(0, len(sample), 256 * step):
            at = np.arange(a, min(len(sample), a + 256 * step), step)
            score = sample[at] @ sample.T
            score[np.arange(len(at)), at] = -np.inf
            best = np.argpartition(-score, min(depth, score.shape[1]) - 1, 1)[:, :depth]
            rank = np.argsort(np.argsort(self._distances(self.rotated(sample[at], True)), 1, kind="stable"), 1)
            need.append(np.take_along_axis(rank, own[best], 1).reshape(-1))
        need = np.sort(np.concatenate(need))
        self.probes = int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) + 1 if len(need) else len(self.centroids)


def scan(q: np.ndarray, limit: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, candidate) that no test abandons, and the number of components looked at.

    q: rotated queries; columns: column blocks of rotated candidates."""
    n, dim = columns[0].shape[0], sum(c.shape[1] for c in columns)
    qi, xi, part, seen, looked = None, None, np.zeros((len(q), n), np.float32), 0, 0
    for c in columns:
        p = q[:, seen : seen + c.shape[1]]
        seen += c.shape[1]
        looked += (part.size if qi is None else len(qi)) * c.shape[1]
        if qi is None:
            part += (p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (p @ c.T)
        else:
            part += ((p[qi] - c[xi]) ** 2).sum(1)
        far = limit * (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / dim if seen < dim else limit
        far = far * (1 + 1e-4) + 1e-6
        if qi is None:
            alive = part <= far[:, None]
            if seen == dim or alive.mean() < 0.1:
                qi, xi = np.nonzero(alive)
                part = part[qi, xi]
        else:
            alive = part <= far[qi]
            qi, xi, part = qi[alive], xi[alive], part[alive]
    return qi, xi, looked


def build(vectors: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame | None, Index | None]:
    """The written index of ``usable`` vectors of one length, a row a block (list, sub, ids, raw, columns), and what tasks know."""
    rows, largest = vectors.agg(F.count("*"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * x)"))).first()
    if not rows:
        return None, None
    kind = vectors.schema["v"].dataType
    number = np.float32 if isinstance(kind.elementType, T.FloatType) else np.float64
    dim = len(vectors.first()["v"])
    size = int(max(1, min(sample_rows, SAMPLE_NUMBERS // dim, max(SAMPLE_LEAST, rows // 10))))
    share = min(1.0, 1.2 * size / rows + 64 / rows)  # only about as many rows as are wanted are sorted
    some = vectors.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = _matrix(some.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(size).toArrow()["v"].combine_chunks())
    if not len(sample):
        sample = np.array([vectors.first()["v"]])
    sample = sample.astype(np.float64)
    index = Index(sample, rows, float(np.sqrt(largest)))
    index.calibrate(sample, rows, k)
    sent = vectors.sparkSession.sparkContext.broadcast(index)  # bounded by the sample's limits and PIECE

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.lists(_matrix(b.column(1))).astype(np.int64))], ["vec_id", "v", "list"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", kind), T.StructField("list", T.LongType())])
    assigned = save(vectors.mapInArrow(lean(assign), schema), "assigned")
    for r in assigned.groupBy("list").count().collect():  # a row a list
        index.sizes[r["list"]] = r["count"]
    index.per_block = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // dim))
    parts = F.create_map(*(F.lit(x) for i, n in enumerate(index.sizes.tolist()) for x in (i, -(-n // index.per_block))))
    # By place in the written table, so that repeated rows don't meet in one block.
    sub = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts[F.col("list").cast("int")])
    known = vectors.sparkSession.sparkContext.broadcast(index)

    def block(t: pa.Table) -> pa.Table:
        v = _matrix(t["v"].combine_chunks())
        x = known.value.rotated(v)
        cols = b"".join(np.ascontiguousarray(x[:, a : a + COLUMNS]).tobytes() for a in range(0, x.shape[1], COLUMNS))
        ids = t["vec_id"].combine_chunks()
        return pa.table({"list": t["list"][:1], "sub": t["sub"][:1], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "raw": pa.array([v.astype(number).tobytes()], pa.binary()), "columns": pa.array([cols], pa.binary())})

    blocks = assigned.withColumn("sub", sub).groupBy("list", "sub").applyInArrow(block, "list long, sub long, ids array<long>, raw binary, columns binary")
    return save(blocks, "blocks"), index


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, best) of (query_id, part, best): the k best, each pair of id and distance once."""
    ordered = F.array_sort(F.flatten(F.collect_list("best")))
    top = F.expr(f"slice(filter(every, (x, i) -> i = 0 or every[i - 1] != x), 1, {k})").alias("best")
    for by in (["query_id", "part"], ["query_id"]):  # a long list's blocks are reduced in parts first
        found = found.groupBy(*by).agg(ordered.alias("every")).select(*by, top)
    return found


def _probe(asked: DataFrame, blocks: DataFrame, index: Index, k: int, choose: Callable[[Index, np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(query_id, part, best) of queries ``asked`` (vec_id, v, kth: the score to beat or null) in the lists that ``choose`` names."""
    sent = asked.sparkSession.sparkContext.broadcast(index)
    number = np.float32 if isinstance(asked.schema["v"].dataType.elementType, T.FloatType) else np.float64

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        subs = -(-ix.sizes // ix.per_block)
        for b in batches:
            for i in range(0, b.num_rows, ROUTE):
                part = b.slice(i, ROUTE)
                ids, v, kth = part.column(0).to_numpy(), _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                wide = v.astype(np.float64)
                limit = np.where(np.isnan(kth), np.inf, (wide * wide).sum(1) + ix.largest**2 - 2 * kth)
                probes = choose(ix, v, kth)
                lists, whose = np.concatenate(probes), np.repeat(np.arange(len(v)), [len(p) for p in probes])
                order = np.argsort(lists, kind="stable")
                lists, whose = lists[order], whose[order]
                edge = np.searchsorted(lists, np.arange(len(ix.sizes) + 1))
                for one in np.unique(lists).tolist():
                    own = whose[edge[one] : edge[one + 1]]
                    row = [ids[own].tolist()], [v[own].astype(number).tobytes()], [limit[own].tobytes()]
                    n = int(subs[one])
                    yield pa.RecordBatch.from_arrays([pa.array([one] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(row[0] * n, pa.list_(pa.int64())), pa.array(row[1] * n, pa.binary()), pa.array(row[2] * n, pa.binary())], ["list", "sub", "asked", "q", "limit"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for b in batches:
            for r in range(b.num_rows):
                part = b.slice(r, 1)
                asked_ids, ids = part.column("asked").flatten().to_numpy(), part.column("ids").flatten().to_numpy()
                q, raw = (np.frombuffer(part.column(c)[0].as_buffer(), number) for c in ("q", "raw"))
                limit = np.frombuffer(part.column("limit")[0].as_buffer(), np.float64)
                q, raw = q.reshape(len(asked_ids), -1), raw.reshape(len(ids), -1)
                flat, columns, at = np.frombuffer(part.column("columns")[0].as_buffer(), np.float32), [], 0
                for a in range(0, ix.dim, COLUMNS):
                    w = min(COLUMNS, ix.dim - a)
                    columns.append(flat[at : at + w * len(ids)].reshape(len(ids), w))
                    at += w * len(ids)
                turned = ix.rotated(q, True)
                for s in range(0, len(q), 256):
                    qi, xi, _ = scan(turned[s : s + 256], limit[s : s + 256], columns)
                    qi = qi + s
                    keep = asked_ids[qi] != ids[xi]
                    qi, xi = qi[keep], xi[keep]
                    few = max(1, (1 << 19) // ix.dim)
                    score = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", q[qi[m : m + few]].astype(np.float64), raw[xi[m : m + few]].astype(np.float64)) for m in range(0, len(qi), few)])
                    order = np.lexsort((ids[xi], -score, qi))
                    qi, xi, score = qi[order], xi[order], score[order]
                    new = np.ones(len(qi), bool)
                    new[1:] = (qi[1:] != qi[:-1]) | (ids[xi[1:]] != ids[xi[:-1]]) | (score[1:] != score[:-1])
                    qi, xi, score = qi[new], xi[new], score[new]
                    some, first, n = np.unique(qi, return_index=True, return_counts=True)
                    n = np.minimum(n, k)
                    rows = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    best = pa.StructArray.from_arrays([pa.array(-score[rows]), pa.array(ids[xi[rows]])], ["far", "vec_id"])
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids[some]), pa.array(np.full(len(some), part.column("sub")[0].as_py() // 64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), best)], ["query_id", "part", "best"])

    parts = max(1, -(-asked.count() // ROUTE))
    routed = asked.repartition(parts).mapInArrow(lean(route), "list long, sub long, asked array<long>, q binary, limit binary")
    return routed.join(blocks, ["list", "sub"]).mapInArrow(lean(look), "query_id long, part long, best array<struct<far:double,vec_id:long>>")


def _search(vectors: DataFrame, queries: DataFrame, k: int, sample_rows: int) -> DataFrame | None:
    """(query_id, best) of vectors and queries of one length."""
    blocks, index = build(vectors, k, sample_rows)
    if blocks is None:
        return None
    least = 4 * (k + 1)
    asked = save(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    none = F.lit(None).cast("double")

    def first(ix: Index, v: np.ndarray, kth: np.ndarray) -> list[np.ndarray]:
        order, enough = ix.probed(v, least)
        return [o[:n] for o, n in zip(order, enough, strict=True)]

    def others(ix: Index, v: np.ndarray, kth: np.ndarray) -> list[np.ndarray]:
        order, enough = ix.probed(v, least)
        return [o[n : max(n, ix.probes)] for o, n in zip(order, enough, strict=True)]

    def rest(ix: Index, v: np.ndarray, kth: np.ndarray) -> list[np.ndarray]:
        return [np.arange(len(ix.sizes))] * len(v)

    near = save(_best(_probe(asked.withColumn("kth", none), blocks, index, k, first), k), "first")
    kth = near.select(F.col("query_id").alias("vec_id"), F.when(F.size("best") == k, -F.element_at("best", -1)["far"]).alias("kth"))
    more = _probe(asked.join(kth, "vec_id", "left"), blocks, index, k, others)
    found = save(_best(near.select("query_id", F.lit(-1).cast("long").alias("part"), "best").unionByName(more), k), "found")
    full = found.filter(F.size("best") == k)
    short = save(asked.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "short")
    if not short.limit(1).count():
        return full
    return full.unionByName(_best(_probe(short.withColumn("kth", none), blocks, index, k, rest), k))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest of ``vectors``, apart from its own id.

    Both: (vec_id, embedding), with components of one type. Nearness: largest inner product.
    """
    rows, asked = usable(vectors), usable(queries)
    found = None
    for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect():  # as a rule, one length
        one = _search(rows.filter(F.size("v") == r["n"]), asked.filter(F.size("v") == r["n"]), k, sample_rows)
        found = one if found is None or one is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return found.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))

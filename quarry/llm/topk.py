"""Exact top-k search by integer inner product, with ball trees.

Components become floor(256 * x). Vectors are dealt out evenly and cut into shards of bounded size, each a ball tree: a
node is a ball (centre, radius) around its vectors, halved along the line between two of them that are far apart, down to
leaves of ``LEAF`` vectors. No vector of a node has a larger inner product with a query than the query's with the centre
plus its length times the radius.

A shard is searched for a block of queries at once. Going down the tree, a node is left out for all queries whose present
k-th score is above its bound. Of the leaves that remain each query takes the one of the largest bound first, then the
next one, two, four and so on, and after each step its k-th score is better and rules out more. A tie is never ruled out.

Shards are put into groups. A block of queries meets one group first, then the groups up to the eighth, then those up to
the sixty-fourth and so on, each time with the k-th scores of all groups before; within a task it carries them from shard
to shard. Blocks of queries go to the groups; where there are fewer groups than tasks, a group goes to several tasks.

Scores are exact: products are summed in single or double precision only where the largest lengths show that all sums fit,
else in integers of 64 bits or of any size. A score is clipped to 64 bits (only components beyond 10**6 get near that).

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; zero vectors do, and
so do vectors without components. Vectors of different lengths have no inner product: each length is searched on its own.
Every row is a candidate, so a repeated row is found twice; rows of a query's own id are not. Of several vectors of a
query's id the smallest asks. Ties go to the smaller id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import lean, save

#: Vectors of a leaf; vectors and numbers of a shard at most; shards of a group; queries and numbers of a block at most.
LEAF, SHARD_ROWS, SHARD_NUMBERS, GROUP, QUERIES, QUERY_NUMBERS = 64, 4096, 1 << 18, 32, 256, 1 << 16
#: How many times as many groups as before a round looks at.
GROWTH = 8
RESULT = "query_id long, rank int, vec_id long, score long"
_BEST = "query_id long, best array<struct<far:long,vec_id:long>>"
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> cast(x as double))").alias("v")).filter("vec_id is not null and v is not null")
    return rows.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


def whole(v: np.ndarray) -> np.ndarray:
    """floor(256 * x), as doubles where they hold it exactly, else as Python's integers."""
    if not v.size or np.abs(v).max() < 1 << 44:
        return np.floor(v * 256)
    return np.array([[math.floor(x * 256) if abs(x) < 1 << 44 else int(x * 2**-44) * 2**52 if abs(x) > 1e300 else int(x * 256) for x in row] for row in v.tolist()], object)


def norm(v: np.ndarray) -> float:
    """The largest length of these vectors, or a little more."""
    return math.inf if v.dtype == object else float(np.sqrt((v.astype(np.float64) ** 2).sum(1)).max(initial=0)) * (1 + 1e-9)


def products(q: np.ndarray, v: np.ndarray, size: float) -> np.ndarray:
    """Exact inner products, clipped to 64 bits. size: no product of lengths is larger."""
    if size < 1 << 24:
        return (q.astype(np.float32, copy=False) @ v.astype(np.float32, copy=False).T).astype(np.int64)
    if size < 1 << 53:
        return (q.astype(np.float64, copy=False) @ v.astype(np.float64, copy=False).T).astype(np.int64)
    if size < 1 << 62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    rows = [[int(x) for x in row] for row in v.tolist()]
    exact = [[sum(x * int(y) for x, y in zip(row, own, strict=True)) for row in rows] for own in q.tolist()]
    return np.array([[max(-_LONG, min(_LONG, x)) for x in row] for row in exact], np.int64)


class Tree:
    """A ball tree over the vectors of a shard, which it puts in its own order. Level l has 2**l nodes; node i of it has
    the vectors from edges[l][i] to edges[l][i + 1]."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.size = norm(v)
        shape = v.astype(np.float64) if v.dtype != object else np.zeros(v.shape)
        order, self.edges, depth = np.arange(len(v)), [np.array([0, len(v)])], max(0, math.ceil(math.log2(len(v) / LEAF)))
        for _ in range(depth):
            edges = [0]
            for a, z in zip(self.edges[-1][:-1].tolist(), self.edges[-1][1:].tolist(), strict=True):
                own = shape[order[a:z]]
                far = own[((own - own[0]) ** 2).sum(1).argmax()]
                line = own[((own - far) ** 2).sum(1).argmax()] - far
                order[a:z] = order[a:z][np.argpartition(own @ line, (z - a) // 2)]
                edges += [(a + z) // 2, z]
            self.edges.append(np.array(edges))
        self.ids, self.v, shape = ids[order], v[order], shape[order]
        if self.size < 1 << 24:
            self.v = self.v.astype(np.float32)
        self.centres, self.radii = [], []
        for edges in self.edges:
            spans = [shape[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            self.centres.append(np.array([x.mean(0) for x in spans]))
            self.radii.append(np.array([np.sqrt(((x - x.mean(0)) ** 2).sum(1).max()) for x in spans]))

    def bounds(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Of each query and leaf the largest inner product that there can be; -inf below a node that the query leaves out."""
        if self.size == math.inf or q.dtype == object:
            return np.full((len(q), len(self.edges[-1]) - 1), np.inf)
        long = np.sqrt((q * q).sum(1))[:, None]
        above = np.full((len(q), 1), np.inf)
        for c, r in zip(self.centres, self.radii, strict=True):
            if len(c) > 1:
                above = np.repeat(above, 2, 1)
            some = np.flatnonzero((above > -np.inf).any(0))
            bound = q @ c[some].T + long * r[some]
            bound += 1e-9 * long * self.size + 1  # for what doubles round
            above[:, some] = np.minimum(above[:, some], bound)
            above[above < kth[:, None]] = -np.inf
        return above


class Best:
    """The k best of each query of a block so far, and the score that a candidate has to reach."""

    def __init__(self, asked: np.ndarray, k: int, kth: np.ndarray):
        self.asked, self.k, self.kth = asked, k, kth.copy()
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, q: list[np.ndarray], score: list[np.ndarray], ids: list[np.ndarray]) -> None:
        q, score, ids = (np.concatenate([old, *new]) for old, new in ((self.q, q), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, q))
        q = q[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k
        self.q, self.score, self.ids = q[keep], score[order][keep], ids[order][keep]
        n = np.bincount(self.q, minlength=len(self.asked))
        full = n == self.k
        worst = self.score[(np.cumsum(n) - 1)[full]]
        self.kth[full] = np.maximum(self.kth[full], least(worst))

    def rows(self) -> pa.RecordBatch:
        q, first = np.unique(self.q, return_index=True)
        best = pa.StructArray.from_arrays([pa.array(-self.score), pa.array(self.ids)], ["far", "vec_id"])
        return pa.RecordBatch.from_arrays([pa.array(self.asked[q]), pa.ListArray.from_arrays(pa.array(np.append(first, len(self.q)), pa.int32()), best)], ["query_id", "best"])


def least(score: np.ndarray) -> np.ndarray:
    """Doubles that are not above these scores."""
    x = score.astype(np.float64)
    return np.where(np.abs(x) < 1 << 53, x, x - np.abs(x) * 1e-15)


def look(tree: Tree, q: np.ndarray, best: Best) -> int:
    """Search one shard for a block of queries; the number of inner products that were made."""
    bound = tree.bounds(q, best.kth)
    order = np.argsort(-bound, 1, kind="stable")
    ranked = np.take_along_axis(bound, order, 1)
    size, edges, made, at = tree.size * max(1.0, norm(q)), tree.edges[-1].tolist(), 0, 0
    while at < order.shape[1]:
        part = slice(at, max(1, 2 * at))
        row, col = np.nonzero((ranked[:, part] >= best.kth[:, None]) & (ranked[:, part] > -np.inf))
        if not len(row):
            break
        leaf = order[:, part][row, col]
        by = np.argsort(leaf, kind="stable")
        row, leaf = row[by], leaf[by]
        starts = np.flatnonzero(np.diff(leaf, prepend=-1)).tolist()
        found: tuple[list, list, list] = [], [], []
        for a, z in zip(starts, [*starts[1:], len(leaf)], strict=True):
            own, s, e = row[a:z], edges[leaf[a]], edges[leaf[a] + 1]
            score = products(q[own], tree.v[s:e], size)
            made += score.size
            i, x = np.nonzero(score >= best.kth[own][:, None])
            new = best.asked[own[i]] != tree.ids[s + x]
            i, x = i[new], x[new]
            for into, what in zip(found, (own[i], score[i, x], tree.ids[s + x]), strict=True):
                into.append(what)
        best.add(*found)
        at = part.stop
    return made


def _dealt(n: int):
    """A number below n for each row, evenly, by place."""
    place = F.monotonically_increasing_id()
    return F.pmod(place + F.shiftright(place, 33), F.lit(n))


def build(vectors: DataFrame, rows: int, dim: int) -> tuple[DataFrame, int]:
    """(grp, tree) of the written shards of ``vectors`` (vec_id, v), all of one length, and the number of groups."""
    shards = -(-rows // max(1, min(SHARD_ROWS, SHARD_NUMBERS // max(1, dim))))

    def shard(t: pa.Table) -> pa.Table:
        v = whole(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim))
        return pa.table({"grp": pa.array([t["shard"][0].as_py() // GROUP]), "tree": pa.array([pickle.dumps(Tree(t["vec_id"].to_numpy(), v), 5)], pa.binary())})

    made = vectors.withColumn("shard", _dealt(shards)).groupBy("shard").applyInArrow(shard, "grp long, tree binary")
    return save(made, "shards"), -(-shards // GROUP)


def _round(asked: DataFrame, blocks: int, shards: DataFrame, groups: int, first: int, last: int, dim: int, k: int) -> DataFrame:
    """_BEST of the queries ``asked`` (vec_id, v, block, kth) in the groups first to last - 1 of each block's own order."""

    def pack(t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        kth = t["kth"].to_numpy().astype(np.float64)
        ids = t["vec_id"].to_numpy()
        return pa.table({"block": t["block"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "q": pa.array([v.tobytes()], pa.binary()), "kth": pa.array([kth.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, q, best = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                if b.column("block")[i].as_py() != block:
                    if best is not None and len(best.q):
                        yield best.rows()
                    block = b.column("block")[i].as_py()
                    ids, flat, kth = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in (("ids", np.int64), ("q", np.float64), ("kth", np.float64)))
                    q, best = whole(flat.reshape(len(ids), dim)), Best(ids, k, kth)
                look(pickle.loads(b.column("tree")[i].as_buffer()), q, best)
        if best is not None and len(best.q):
            yield best.rows()

    slices = max(1, min(-(-2 * asked.sparkSession.sparkContext.defaultParallelism // (last - first)), -(-blocks // groups)))
    packed = asked.groupBy("block").applyInArrow(pack, "block long, ids binary, q binary, kth binary")
    meets = packed.withColumns({"grp": F.explode(F.transform(F.sequence(F.lit(first), F.lit(last - 1)), lambda j: F.pmod(F.col("block") + j, F.lit(groups)))), "slice": F.pmod(F.expr(f"block div {groups}"), F.lit(slices))})
    copies = shards.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    # Merged, so that all shards of a block follow each other; a block that comes again is only searched anew.
    return meets.hint("merge").join(copies, ["grp", "slice"]).select("block", "ids", "q", "kth", "tree").mapInArrow(lean(run), _BEST)


def _top(found: DataFrame, k: int) -> DataFrame:
    every = F.array_sort(F.flatten(F.collect_list("best")))
    return found.groupBy("query_id").agg(F.slice(every, 1, k).alias("best"))


def _search(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    shards, groups = build(vectors, vectors.count(), dim)
    own = save(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    blocks = max(1, -(-own.count() // max(1, min(QUERIES, QUERY_NUMBERS // max(1, dim)))))
    asked = save(own.withColumn("block", _dealt(blocks)), "asked")
    best, first = None, 0
    while first < groups:
        last = min(groups, max(1, GROWTH * first))
        kth = F.lit(float("-inf"))
        rows = asked.withColumn("kth", kth)
        if best is not None:
            # Scores of 53 bits and more are lowered a little, as a double may be above them.
            worst = -F.element_at("best", -1)["far"].cast("double")
            known = best.filter(F.size("best") == k).select(F.col("query_id").alias("vec_id"), (worst - F.when(F.abs(worst) >= 2.0**53, F.abs(worst) * 1e-15).otherwise(0.0)).alias("known"))
            rows = asked.join(known, "vec_id", "left").select("vec_id", "v", "block", F.coalesce("known", kth).alias("kth"))
        found = _round(rows, blocks, shards, groups, first, last, dim, k)
        best, first = save(_top(found if best is None else best.unionByName(found), k), "best"), last
    return best


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of ``queries`` its k highest scores among ``vectors``, apart from its own
    id's rows. Both: (vec_id, embedding)."""
    rows, asked = save(usable(vectors), "vectors"), usable(queries)
    found = None
    for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect():  # as a rule, one length
        one = _search(rows.filter(F.size("v") == r["n"]), asked.filter(F.size("v") == r["n"]), r["n"], k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return found.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))

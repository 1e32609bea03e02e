"""A Merkle manifest of a dataset: one root that commits to every row, and for every row the proof that it belongs to it.

A row's leaf is the SHA-256 of its fields, each written as its byte count and value, or ``-`` for a null. The leaves of a
source, in order of their ids, form a tree: runs of ``FANOUT`` neighbours become their hash, level by level, until one
node is left, the subroot. Subroots in order of their sources form the upper tree, which ends in the root.

Leaves get their places by sorting into ranges. A tree's leaves are cut into aligned blocks of ``FANOUT ** DEPTH``, each
a row with its digests as one matrix of 64 hex bytes a digest, so no task holds more of a source than a block. A block's
matrix is reshaped by the fanout and its rows are hashed, level by level; the blocks' tops are the nodes of the next
round, in blocks again. On the way down each block gets what its top needs to reach the root; within a block the place of
every sibling at every level follows from the leaf's own by index arithmetic.

A null source is a tree of its own, before all others. Null ids come first; rows of one id are in the order of their
leaves, so rows that are equal in all fields are leaves of their own, next to each other. A null id has no checksum and is
never tampered with. An empty table has no root and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordering
from ._io import lean, save

#: Children of a node; levels of a block.
FANOUT, DEPTH = 3, 7
BLOCK = FANOUT**DEPTH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATH = "tree string, place long, subroot string, path array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, claimed): claimed is the leaf of a tampered row, which has lost the line ends of its text; else null."""
    shorn = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    fields = [F.col(c) for c in FIELDS]
    claimed = F.when(tampered, leaf([shorn if c == "text" else F.col(c) for c in FIELDS]))
    # Never null, and in the order of sources, nulls first.
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("leaf"), claimed.alias("claimed"))


def placed(nodes: DataFrame, order: list[Column | str]) -> DataFrame:
    """``nodes`` with place (from 0, in its tree) and count (of its tree). order: of the nodes within a tree."""
    table = ordering.ranges(nodes, ["tree", *order])
    runs = table.groupBy("part", "tree").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))  # a tree has one run a range
    tree = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("_n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "tree", (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("count"))
    return table.join(runs, ["part", "tree"]).withColumn("place", F.col("at") + F.col("_shift")).drop("part", "at", "_shift")


def _hex(found: list[str]) -> np.ndarray:
    return np.frombuffer("".join(found).encode(), np.uint8).reshape(-1, 64)


def _strings(column: pa.Array) -> np.ndarray:
    """Digests as a matrix of their hex bytes."""
    return _hex(column.to_pylist())


def levels(m: np.ndarray, depth: int | None, fanout: int = FANOUT) -> list[np.ndarray]:
    """A block's digest matrices: ``depth`` levels above the first, or all up to a single node."""
    out = [m]
    while len(out) <= depth if depth is not None else len(out[-1]) > 1:
        raw, width = out[-1].tobytes(), 64 * fanout  # a row of the reshaped matrix is a run; the last may be short
        out.append(_hex([sha256(raw[a : a + width]).hexdigest() for a in range(0, len(raw), width)]))
    return out


def _depth(count: int) -> int | None:
    return DEPTH if count > BLOCK else None


def _others(fanout: int) -> np.ndarray:
    return np.array([[x for x in range(fanout) if x != own] for own in range(fanout)])


def siblings(m: list[np.ndarray], fanout: int = FANOUT) -> tuple[np.ndarray, np.ndarray]:
    """Of each node of the lowest matrix the siblings at all levels, (n, levels, fanout - 1, 64), and which of them exist."""
    n, steps = len(m[0]), len(m) - 1
    found, there = np.zeros((n, steps, fanout - 1, 64), np.uint8), np.zeros((n, steps, fanout - 1), bool)
    for k in range(steps):
        at = np.arange(n) // fanout**k
        other = (at - at % fanout)[:, None] + _others(fanout)[at % fanout]
        there[:, k] = other < len(m[k])
        found[:, k] = m[k][np.minimum(other, len(m[k]) - 1)]
    return found, there


def fold(claimed: np.ndarray, found: np.ndarray, there: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """What the claimed digests of a block's leaves give, with these siblings, at the block's top."""
    n, steps = there.shape[:2]
    every, width = np.arange(n), 64 * fanout
    for k in range(steps):
        own = every // fanout**k % fanout
        runs = np.empty((n, fanout, 64), np.uint8)
        runs[every, own] = claimed
        runs[every[:, None], _others(fanout)[own]] = found[:, k]
        raw, size = runs.tobytes(), 64 * (1 + there[:, k].sum(1))
        claimed = _hex([sha256(raw[i * width : i * width + s]).hexdigest() for i, s in enumerate(size.tolist())])
    return claimed


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, block, count, digests, ...) of ``nodes`` (tree, place, count, digest, ...), a row a block; ``carried`` as arrays."""
    kinds = dict(nodes.dtypes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            starts = np.flatnonzero(t["place"].to_numpy() % BLOCK == 0).tolist()
            for a, z in zip(starts, starts[1:], strict=False):
                yield one(t.slice(a, z - a))
            held = t.slice(starts[-1])
        if held is not None:
            yield one(held)

    def one(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        as_list = lambda c: pa.array([t[c].to_pylist()], pa.list_(t.schema.field(c).type))
        fixed = [t["tree"][:1].combine_chunks(), pa.array([t["place"][0].as_py() // BLOCK]), t["count"][:1].combine_chunks(), pa.array([_strings(t["digest"]).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*fixed, *map(as_list, carried)], ["tree", "block", "count", "digests", *carried])

    rows = nodes.select("tree", "place", "count", "digest", *carried).withColumn("block", F.expr(f"place div {BLOCK}"))
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "place")
    more = "".join(f", {c} array<{kinds[c]}>" for c in carried)
    return save(rows.mapInArrow(lean(gather), f"tree string, block long, count long, digests binary{more}"), "blocks")


def _matrix(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, 64)


def tops(table: DataFrame) -> DataFrame:
    """(tree, place, count, digest): the top of each block, as a node of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = b.column("count").to_pylist()
            top = [levels(_matrix(d), _depth(n))[-1].tobytes().decode() for d, n in zip(b.column("digests"), count, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), pa.array([-(-n // BLOCK) for n in count], pa.int64()), pa.array(top)], ["tree", "place", "count", "digest"])

    return save(table.select("tree", "block", "count", "digests").mapInArrow(lean(run), "tree string, place long, count long, digest string"), "tops")


def climb(first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all rounds above ``first``, the lowest, with those; and (tree, digest), the tree's last node."""
    rounds, done = [first], None
    while True:
        nodes = tops(rounds[-1])
        ended = nodes.filter("count = 1").select("tree", "digest")
        done = ended if done is None else done.unionByName(ended)
        more = nodes.filter("count > 1")
        if more.isEmpty():
            return rounds, done
        rounds.append(blocks(more, []))


def descend(table: DataFrame, above: DataFrame) -> DataFrame:
    """The paths (PATH) of the nodes of one round's blocks; above: the paths of the blocks, by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = levels(np.frombuffer(r["digests"], np.uint8).reshape(-1, 64), _depth(r["count"]))
                text, paths = [x.tobytes().decode() for x in m], []
                for i in range(len(m[0])):
                    own = []
                    for k, t in enumerate(text[:-1]):
                        at = i // FANOUT**k
                        a = at - at % FANOUT
                        own.append({"left": t[64 * a : 64 * at], "right": t[64 * (at + 1) : 64 * (a + FANOUT)]})
                    paths.append(own + r["path"])
                n, first = len(m[0]), r["block"] * BLOCK
                kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n), pa.array(range(first, first + n), pa.int64()), pa.array([r["subroot"]] * n, pa.string()), pa.array(paths, kind)], ["tree", "place", "subroot", "path"])

    return save(_under(table, above).mapInArrow(lean(run), PATH), "paths")


def _under(table: DataFrame, above: DataFrame) -> DataFrame:
    return table.join(above.withColumnRenamed("place", "block"), ["tree", "block"])


def _down(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The paths of the blocks of the lowest round. ends: (tree, subroot, path), what is above each tree's last node."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        last = rounds[k].filter(f"count <= {BLOCK}").select("tree").join(ends, "tree").select("tree", F.lit(0).cast("long").alias("place"), "subroot", "path")
        above = last if above is None else last.unionByName(above)
        if k:
            above = descend(rounds[k], above)
    return above


def prove(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf of ``leaves``, as ``digests`` gives them."""
    nodes = placed(leaves, [F.asc_nulls_first("doc_id"), "leaf", "claimed"]).withColumnRenamed("leaf", "digest")
    rounds, subroots = climb(blocks(nodes, ["doc_id", "claimed"]))
    if subroots.isEmpty():
        return leaves.sparkSession.createDataFrame([], RESULT)
    upper = placed(subroots.withColumnRenamed("tree", "source").withColumn("tree", F.lit("")), ["source"])
    top_rounds, roots = climb(blocks(upper, ["source"]))
    root = roots.first()["digest"]  # one row
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = _down(top_rounds, roots.select("tree", F.lit("").alias("subroot"), none.alias("path")))
    # The upper tree's leaves are the sources: each block knows theirs.
    names = top_rounds[0].select("tree", "block", F.posexplode("source").alias("i", "source")).select("tree", (F.col("block") * BLOCK + F.col("i")).alias("place"), "source")
    reach = descend(top_rounds[0], over).join(names, ["tree", "place"]).select(F.col("source").alias("tree"), "path")
    ends = reach.join(subroots, "tree").select("tree", F.col("digest").alias("subroot"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in ("count", "digests", "doc_id", "claimed", "subroot", "path")}
                m = levels(_matrix(r["digests"]), _depth(r["count"].as_py()))
                found, there = siblings(m)
                own = m[0].tobytes().decode()
                own = [own[a : a + 64] for a in range(0, len(own), 64)]
                claimed = [c or d for c, d in zip(r["claimed"].as_py(), own, strict=True)]
                path = [(s["left"].encode(), s["right"].encode()) for s in r["path"].as_py()]
                flat, ends_at = found[there].tobytes(), np.cumsum(64 * there.sum((1, 2))).tolist()
                rest = b"".join(left + right for left, right in path)
                proofs = [sha256(flat[a:z] + rest).hexdigest() for a, z in zip([0, *ends_at], ends_at, strict=False)]
                known: dict[bytes, str] = {}
                folded = []
                for top in fold(_hex(claimed), found, there):
                    at = start = top.tobytes()
                    if start not in known:
                        for left, right in path:
                            at = sha256(left + at + right).hexdigest().encode()
                        known[start] = at.decode()
                    folded.append(known[start])
                n = len(own)
                columns = [r["doc_id"].values, pa.array(own), pa.array([r["subroot"].as_py()] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return _under(rounds[0], _down(rounds, ends)).mapInArrow(lean(run), RESULT)


def manifest(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (FIELDS) as a leaf, with its proof; tampered rows fail it."""
    return prove(digests(docs))

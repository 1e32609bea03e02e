"""Token ids as directly addressable codes: any token is read without decoding a block.

An id is split into chunks of eight bits, the lowest first. Level 0 holds the lowest chunk of every token, level k the
k-th chunk of the tokens that have one. A bitmap for each level tells which of its entries go on at the next level;
a rank directory holds the ones before every 512th bit. Token i's next chunk is at rank(i) on the level above, and so
on, so access costs one step a level.

A *shard* is one self-contained byte string of this form for a run of whole documents (layout: ``Shard``). The table
that ``write`` makes has a row a shard, in ascending id order, so it lies in any store that Spark can write.

Null and empty texts are documents of the end id alone. Repeated ids stay as rows of their own, in any order among
themselves. An empty table gives an empty store. A null id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe import default_path, encoder
from ._io import lean, save, slices

MAGIC = b"QDAC1\0\0\0"
BLOCK = 512
#: Tokens after which a shard ends with the document at hand.
SHARD_TOKENS = 1 << 20


def pack_shard(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """magic, documents, tokens, levels (unsigned 64-bit); bounds; for each level: its length, codes, bitmap, directory."""
    parts = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint64))]).astype("<u4")
        parts += [np.array([len(rest)], "<u8").tobytes(), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        if not more.any():
            break
        rest = rest[more] >> 8
    head = np.array([len(bounds) - 1, len(ids), len(parts) // 4], "<u8").tobytes()
    return b"".join([MAGIC, head, bounds.astype("<u8").tobytes(), *parts])


class Shard:
    """Read access to a shard's bytes, without copying them."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a shard")
        docs, self.tokens, levels = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
        self.bounds = np.frombuffer(raw, "<u8", docs + 1, 32).astype(np.int64)
        at = 32 + 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            blocks = -(-n // BLOCK)
            code = np.frombuffer(raw, np.uint8, n, at + 8)
            bits = np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at + 8 + n)
            ranks = np.frombuffer(raw, "<u4", blocks + 1, at + 8 + n + len(bits))
            self.levels.append((code, bits, ranks))
            at += 8 + n + len(bits) + 4 * (blocks + 1)

    def token(self, i: int) -> int:
        """The i-th id: one look at each level that it reaches."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for code, bits, ranks in self.levels:
            value |= int(code[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            inside = int.from_bytes(bits[block * BLOCK // 8 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK)) - 1)
            i = int(ranks[block]) + inside.bit_count()
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        """All ids in order."""
        out = np.zeros(self.tokens, np.uint32)
        where = None
        for k, (code, bits, _) in enumerate(self.levels):
            more = np.flatnonzero(np.unpackbits(bits, count=len(code), bitorder="little"))
            if where is None:
                out |= code
                where = more
            else:
                out[where] |= code.astype(np.uint32) << np.uint32(8 * k)
                where = where[more]
        return out


def write(docs: DataFrame, path: str | None = None, end_id: int = 2, partitions: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode (doc_id, text), add the end id to each document, and write shards in ascending doc_id order.

    Returns the written table as read back: (shard, n_docs, n_tokens, doc_ids, data); shards are numbered in doc_id order.
    """
    path, spark = path or default_path(), docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, k = encoder(path), TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal k
            n_tokens = np.concatenate(sizes)
            data = pack_shard(np.concatenate(held), np.concatenate([[0], np.cumsum(n_tokens)]))
            ids = pa.concat_arrays(names)
            row = [pa.array([(task << 32) + k]), pa.array([len(ids)]), pa.array([int(n_tokens.sum())]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary())]
            k += 1
            names.clear(), held.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "n_docs", "n_tokens", "doc_ids", "data"])

        for b in slices(batches):
            ids, at = enc.encode(b.column(1))
            ids, at = np.insert(ids, at[1:], end_id).astype(np.uint32, copy=False), at + np.arange(len(at))
            i = 0
            while i < len(at) - 1:
                room = shard_tokens - sum(len(x) for x in held)
                j = max(i + 1, int(np.searchsorted(at, at[i] + room)))
                j = min(j, len(at) - 1)
                names.append(b.column(0).slice(i, j - i))
                held.append(ids[at[i] : at[j]])
                sizes.append(np.diff(at[i : j + 1]))
                i = j
                if sum(len(x) for x in held) >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("shard", "n_docs", "n_tokens")] + [T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())])
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return save(ordered.mapInArrow(lean(run, "tokens"), schema), "shards")


def read(store: DataFrame, digest: bool = True) -> DataFrame:
    """Documents of a store: (doc_id, start, n_tokens, ids_crc32) or, without digest, (doc_id, start, ids)."""
    kind = store.schema["doc_ids"].dataType.elementType
    # A row a shard.
    before = store.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                names = b.column(0).slice(r, 1).flatten()
                shard, before = Shard(b.column(1)[r].as_py()), b.column(2)[r].as_py()
                at = shard.bounds
                ids = shard.ids().astype("<u4")
                if digest:
                    raw = memoryview(ids.tobytes())
                    sums = [crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([names, pa.array(at[:-1] + before), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.RecordBatch.from_arrays([names, pa.array(at[:-1] + before), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "start", "ids"])

    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), *more])
    return store.join(before, "shard").select("doc_ids", "data", "before").mapInArrow(lean(run), schema)


def tokens_at(store: DataFrame, places: DataFrame) -> DataFrame:
    """(position, token) for positions (column ``position``) in the store's whole run of tokens, by direct access."""
    span = store.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("first"), "n_tokens").filter("n_tokens > 0")
    # Shards and positions meet in cells of SHARD_TOKENS positions; a shard covers two or so.
    cells = span.withColumn("cell", F.explode(F.sequence(F.expr(f"first div {SHARD_TOKENS}"), F.expr(f"(first + n_tokens - 1) div {SHARD_TOKENS}"))))
    asked = places.select("position").distinct().withColumn("cell", F.expr(f"position div {SHARD_TOKENS}"))
    found = asked.join(cells, "cell").filter("position >= first and position < first + n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                shard, first, asked = Shard(b.column(0)[r].as_py()), b.column(1)[r].as_py(), b.column(2)[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([shard.token(p - first) for p in asked], pa.int64())], ["position", "token"])

    # At most SHARD_TOKENS positions and one document's fall in a shard.
    asked = found.groupBy("shard", "first").agg(F.collect_list("position").alias("asked"))
    return store.select("shard", "data").join(asked, "shard").select("data", "first", "asked").mapInArrow(lean(run), "position long, token long")

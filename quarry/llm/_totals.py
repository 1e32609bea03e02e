"""Corpus-wide totals of keys, looked up for every key of every chunk, without a row for each key.

Chunks of documents bring their distinct keys sorted, with counts. Keys are divided into buckets by their highest bits;
a bucket's keys of all chunks meet in one group of bounded size, are summed, and go back to their chunks as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import lean

#: Keys of all chunks that a bucket holds on average, at most.
BUCKET_KEYS = 1 << 20
LEAST_BUCKETS = 256


def buckets_for(keys: int) -> int:
    """A power of two, so that a bucket has at most about BUCKET_KEYS of so many keys."""
    return max(LEAST_BUCKETS, 1 << max(0, (int(keys) // BUCKET_KEYS).bit_length()))


def totals(chunks: DataFrame, buckets: int, finish: Callable[[np.ndarray], np.ndarray], stats: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes] | None = None) -> DataFrame:
    """(chunk, bucket, values, stats): for each chunk's keys in a bucket, in order, ``finish(totals)`` as bytes.

    chunks: (chunk long, keys binary of sorted unsigned 64-bit, counts binary of unsigned 32-bit, more binary or null:
    a byte for each key). stats: of a bucket's distinct keys, totals and bytes; it stands in one row of each bucket.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                chunk = b.column(0)[r].as_py()
                keys, counts = np.frombuffer(b.column(1)[r].as_buffer(), "<u8"), np.frombuffer(b.column(2)[r].as_buffer(), "<u4")
                more = b.column(3)[r].as_buffer() if b.column(3)[r].is_valid else None
                at = np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(at)).tolist()
                cut = [(int(at[k]), int(at[k + 1])) for k in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array([chunk] * len(some), pa.int64()),
                        pa.array([keys[x:y].tobytes() for x, y in cut], pa.binary()),
                        pa.array([counts[x:y].tobytes() for x, y in cut], pa.binary()),
                        pa.array([more[x : y].to_pybytes() if more else None for x, y in cut], pa.binary()),
                    ],
                    ["bucket", "chunk", "keys", "counts", "more"],
                )

    def add(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), "<u8") for x in t["keys"]]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in t["counts"]])
        sizes = np.cumsum([len(k) for k in keys])
        distinct, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(back, counts, len(distinct)).astype(np.int64)
        said: list[bytes | None] = [None] * len(keys)
        if stats:
            more = np.frombuffer(b"".join(x.as_py() for x in t["more"]), np.uint8)
            said[0] = stats(distinct, total, more[first])
        values = np.split(finish(total)[back], sizes[:-1])
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "values": pa.array([v.tobytes() for v in values], pa.binary()), "stats": pa.array(said, pa.binary())})

    rows = chunks.select("chunk", "keys", "counts", "more").mapInArrow(lean(split), "bucket int, chunk long, keys binary, counts binary, more binary")
    return rows.groupBy("bucket").applyInArrow(add, "chunk long, bucket int, values binary, stats binary")


def by_chunk(found: DataFrame) -> DataFrame:
    """(chunk, values array<binary>): a chunk's values by bucket, in the order of its keys. At most ``buckets`` rows a chunk."""
    return found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "values"))).alias("v")).select("chunk", F.col("v.values").alias("values"))

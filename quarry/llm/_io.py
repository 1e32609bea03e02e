"""Written tables in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or set as the context's checkpoint folder.

    Where neither is set, one of our own in local mode (tests); on a cluster that is an error, since a folder of the
    driver's machine is not its executors'.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir: no folder that the cluster shares is set")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back, which cuts its lineage.

    The files go with ``discard``, or when the session's file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    at, store = _store(spark, path)
    store.deleteOnExit(at.getParent())
    back = spark.read.schema(df.schema).parquet(path)
    back._quarry_path = path
    return back


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``save`` gave and that nothing reads any more."""
    for df in tables:
        at, store = _store(df.sparkSession, df._quarry_path)
        store.delete(at.getParent(), True)


def stable(df: DataFrame) -> DataFrame:
    """``df`` itself if it gives the same rows in the same partitions whenever it is read; a shuffle doesn't: then a written table."""
    return save(df, "input") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


#: Of each kind of task that leaves tables in its worker for the next of that kind: what drops them.
_KEPT: dict[str, Callable[[], None]] = {}


def keep_for(kind: str, forget: Callable[[], None]) -> None:
    """Tasks of this kind share tables in their worker; ``forget`` drops them."""
    _KEPT[kind] = forget


def let_go(kind: str | None) -> None:
    """Drop the tables that other kinds of tasks have left in this worker."""
    for other, forget in _KEPT.items():
        if other != kind:
            forget()


def tidy() -> None:
    """Give freed memory back to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # other C libraries have no such call


def lean(run: Callable[[Iterator], Iterator], kind: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run``, a function for mapInArrow or mapInPandas, that leaves little memory in its worker.

    Python workers stay for later tasks and stages: their allocators would keep what the largest task needed, and
    tables made for one operator would stay while others run. kind: the tables that this task shares with its like.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        let_go(kind)
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """Parts of record batches, so that what is made of one at a time stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)

"""Written tables in the folder that the whole cluster shares; they cut a plan's lineage and keep rows as they are."""

from __future__ import annotations

import re
import tempfile
import uuid

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


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back. The files go when the session's file system is closed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    at, store = _store(spark, path)
    store.deleteOnExit(at.getParent())
    return spark.read.schema(df.schema).parquet(path)

"""Session logs: JSON lines with fixed schemas, where a malformed line is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an activity log and of a findings log.
MAX_ACTIVITY, MAX_FINDINGS = 16 << 20, 32 << 20


def read_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_lines(rows: DataFrame, path: str, most_bytes: int = MAX_FINDINGS) -> None:
    """Append rows as JSON lines, unless they and what is there would exceed the ceiling."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1), F.lit(0))).first()[0]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = store.getContentSummary(at).getLength() if store.exists(at) else 0
    if size + there > most_bytes:
        raise ValueError(f"{size + there} bytes exceed {most_bytes}")
    rows.write.mode("append").json(path)

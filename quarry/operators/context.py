"""Compaction of long conversations under a context budget. messages: (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate

#: Messages at the end that stay; from how many on; bytes of a tool result, of a text, and of what stays of it.
LAST, LEAST, TOOL_BYTES, TEXT_BYTES, KEPT_BYTES = 4, 5, 500, 2000, 500
TOOL_NOTICE, TEXT_NOTICE = "[tool result removed]", " [text shortened]"


def compact(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the first and the last four messages stay; longer ones between them are shortened."""
    w = Window.partitionBy("conv_id")
    rows = messages.withColumn("place", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    safe = (F.col("n") <= LEAST) | (F.col("place") == 1) | (F.col("place") > F.col("n") - LAST)
    tool = (F.col("role") == "tool") & (F.octet_length("text") > TOOL_BYTES)
    text = F.when(safe, F.col("text")).when(tool, TOOL_NOTICE).when((F.col("role") != "tool") & (F.octet_length("text") > TEXT_BYTES), F.concat(truncate("text", KEPT_BYTES), F.lit(TEXT_NOTICE))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


def allocate(messages: DataFrame, budget: int) -> DataFrame:
    """(conv_id, turn, granted): bytes of each message, newest first; a quarter of the budget is held for the first one."""
    w = Window.partitionBy("conv_id")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    rows = messages.select("conv_id", "turn", size.cast("long").alias("size"), F.row_number().over(w.orderBy("turn")).alias("place"))
    held = budget // 4
    after = F.sum(F.when(F.col("place") > 1, F.col("size")).otherwise(0)).over(w.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("place") > 1, F.col("size")).otherwise(0)
    later = F.least("size", F.greatest(F.lit(0), budget - held - after))
    return rows.select("conv_id", "turn", F.when(F.col("place") == 1, F.least("size", F.greatest(F.lit(held), budget - after))).otherwise(later).cast("long").alias("granted"))

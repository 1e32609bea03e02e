"""Places and running values in a total order, without one task for all rows.

Rows are sorted into ranges, a range a partition, and written once with their range (``part``) and their place in it
(``at``). What goes on from range to range is a row a range: that is the only thing that meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import save

_BITS = 33  # of monotonically_increasing_id, for the place within a partition


def ranges(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with part and at (from 0), written."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return save(sorted_.withColumns({"part": F.shiftright(place, _BITS).cast("int"), "at": place.bitwiseAND((1 << _BITS) - 1)}), "ranges")


def within(table: DataFrame):
    """The window of a range, in order."""
    return Window.partitionBy("part").orderBy("at")


def before(table: DataFrame, value: Column, name: str) -> DataFrame:
    """(part, name): the sum of ``value``, an aggregate, over all ranges before this one; a row a range."""
    sums = table.groupBy("part").agg(value.alias("_v"))
    return sums.select("part", (F.sum("_v").over(Window.orderBy("part")) - F.col("_v")).alias(name))


def placed(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with their place in the order, from 1."""
    table = ranges(rows, order)
    first = F.broadcast(before(table, F.count("*"), "_before"))  # a row a range
    return table.join(first, "part").withColumn(name, F.col("_before") + F.col("at") + 1).drop("part", "at", "_before")


def running(rows: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row."""
    table = ranges(rows, order)
    first = F.broadcast(before(table, F.coalesce(F.sum(value), F.lit(0)), "_before"))
    own = F.sum(value).over(within(table).rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("_own", own).join(first, "part").withColumn(name, F.col("_before") + F.col("_own")).drop("part", "at", "_before", "_own")


def runs(rows: DataFrame, order: list[Column | str], key: str, name: str) -> DataFrame:
    """``rows`` with place (from 1) and the number of the run of equal ``key`` that each stands in, from 1."""
    table = ranges(rows, order)
    last = table.groupBy("part").agg(F.max_by(key, "at").alias("_last"))
    edge = last.select("part", F.lag("_last").over(Window.orderBy("part")).alias("_edge"))
    w = within(table)
    previous = F.when(F.col("at") == 0, F.col("_edge")).otherwise(F.lag(key).over(w))
    marked = table.join(F.broadcast(edge), "part").withColumn("_new", F.when(F.col(key) == previous, 0).otherwise(1))
    counted = save(marked.drop("_edge"), "runs")
    first = before(counted, F.sum("_new"), "_runs").join(before(counted, F.count("*"), "_rows"), "part")
    own = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = counted.withColumn("_own", own).join(F.broadcast(first), "part")
    return out.withColumns({name: F.col("_runs") + F.col("_own"), "place": F.col("_rows") + F.col("at") + 1}).drop("part", "at", "_new", "_own", "_runs", "_rows")

"""Joins between findings, files and changed lines; what was looked at and what was not; checks of evidence."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.tables import save


def overlapping(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings whose lines overlap a changed range of their file. hunks: (path, start, end).

    The path is an equality key, so this is a hash or sort-merge semi join with a range condition on top.
    """
    h = hunks.select(F.col("path").alias("h_path"), F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    return findings.join(h, (F.col("file") == F.col("h_path")) & (F.col("h_start") <= F.col("line_end")) & (F.col("line_start") <= F.col("h_end")), "left_semi")


def classify_changes(changed: DataFrame, files: DataFrame, skipped: DataFrame, excluded_reason: str = "absent") -> DataFrame:
    """(path, status, reason) of changed files, each once.

    changed: (path, start, end), both null for a file without changed lines. skipped: (relative_path, reason). In this
    order: no changed lines, an invalid range, absent from the inventory (with the reason reported, if any), presented.
    """
    per = changed.groupBy("path").agg(F.count("start").alias("n"), F.bool_or(F.coalesce((F.col("start") < 1) | (F.col("end") < F.col("start")), F.lit(False))).alias("bad"))
    known = files.select(F.col("relative_path").alias("path")).distinct().withColumn("there", F.lit(True))
    why = skipped.groupBy(F.col("relative_path").alias("path")).agg(F.min("reason").alias("why"))
    rows = per.join(known, "path", "left").join(why, "path", "left")
    reason = F.when(F.col("n") == 0, "no changed lines").when(F.col("bad"), "invalid range").when(F.col("there").isNull(), F.coalesce("why", F.lit(excluded_reason)))
    return rows.select("path", F.when(reason.isNull(), "presented").otherwise("skipped").alias("status"), reason.alias("reason"))


def changed_coverage(changed: DataFrame, files: DataFrame, admitted: DataFrame) -> DataFrame:
    """(path, status, reason): inspectable, or skipped with one of three reasons. files: all; admitted: those no rule leaves out."""
    _, error = paths.normalized(F.col("path"))
    rows = changed.select("path").distinct()
    rows = rows.join(files.select(F.col("relative_path").alias("path"), F.lit(True).alias("there")).distinct(), "path", "left")
    rows = rows.join(admitted.select(F.col("relative_path").alias("path"), F.lit(True).alias("ok")).distinct(), "path", "left")
    reason = F.when(error.isNotNull(), "unsafe path").when(F.col("there").isNull(), "absent").when(F.col("ok").isNull(), "excluded by filters")
    return rows.select("path", F.when(reason.isNull(), "inspectable").otherwise("skipped").alias("status"), reason.alias("reason"))


def uninspected(presented: DataFrame, read: DataFrame) -> DataFrame:
    """Presented paths that were never read, in order."""
    return presented.select("path").join(read.select("path"), "path", "left_anti").orderBy("path")


def reconciled(presented: DataFrame, skipped: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(presented, skipped) after files that were omitted but read anyway have moved."""
    moved = skipped.join(read.select("path").distinct(), "path", "left_semi")
    return presented.select("path").union(moved.select("path")).distinct(), skipped.join(moved.select("path"), "path", "left_anti")


def scan_status(files: DataFrame, skipped: DataFrame, omitted: int = 0, unreadable: DataFrame | None = None) -> DataFrame:
    """One row: presented, inspected, skipped, complete. skipped: (relative_path, reason) of files that were looked at and
    could not be inspected; unreadable: of entries that never were files of the scan. All are presented."""
    ones = lambda df, *k: df.select(*(F.lit(int(x)) for x in k))
    counts = ones(files, 1, 0, 0).toDF("f", "s", "u").union(ones(skipped, 0, 1, 0))
    if unreadable is not None:
        counts = counts.union(ones(unreadable, 0, 0, 1))
    counts = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "fsu"))
    left_out = F.col("s") + F.col("u")
    return counts.select((F.col("f") + F.col("u") + omitted).alias("presented"), (F.col("f") - F.col("s")).alias("inspected"), left_out.alias("skipped"), ((left_out == 0) & F.lit(omitted == 0)).alias("complete"))


def completeness(failed: DataFrame, skipped: DataFrame, uninspected_: DataFrame, omitted: int = 0) -> DataFrame:
    """One row: failed, skipped, uninspected, omitted, complete (if all are 0)."""
    parts = [df.agg(F.count("*").alias(n)) for df, n in ((failed, "failed"), (skipped, "skipped"), (uninspected_, "uninspected"))]
    rows = parts[0].select(F.col("failed"), F.lit(0).cast("long").alias("skipped"), F.lit(0).cast("long").alias("uninspected"))
    rows = rows.union(parts[1].select(F.lit(0).cast("long"), "skipped", F.lit(0).cast("long"))).union(parts[2].select(F.lit(0).cast("long"), F.lit(0).cast("long"), "uninspected"))
    sums = rows.agg(*(F.sum(c).alias(c) for c in ("failed", "skipped", "uninspected"))).withColumn("omitted", F.lit(omitted).cast("long"))
    return sums.withColumn("complete", F.col("failed") + F.col("skipped") + F.col("uninspected") + F.col("omitted") == 0)


def duplicate_scope(changed: DataFrame) -> DataFrame:
    """(path, n): paths that a review's scope lists more than once, which it rejects. changed: a row a path and range list."""
    normal, _ = paths.normalized(F.col("path"))
    return changed.select(normal.alias("path")).groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")


#: About so many characters of places are held before they are given out.
PLACES_SIZE = 1 << 20


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each file (file, text, snippets): its lines, and first and last line of each snippet that stands in it exactly once.

    A text is read once, by an automaton of all its snippets."""
    import ahocorasick

    place = pa.struct([("snippet", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(place))], ["file", "total", "places"])

    for b in batches:
        for row in zip(*(b.column(c) for c in ("file", "text", "snippets")), strict=True):
            file, text, snippets = (x.as_py() for x in row)  # one file at a time
            words = [s for s in snippets or [] if s]
            total = text.count("\n") + (not text.endswith("\n")) if text else 0
            found: dict[int, list[int]] = {}  # snippet: where it stands first, how often, from where on it can stand again
            if words and text:
                automaton = ahocorasick.Automaton()
                for k, w in enumerate(words):
                    automaton.add_word(w, k)
                automaton.make_automaton()
                for end, k in automaton.iter(text):
                    start = end + 1 - len(words[k])
                    own = found.setdefault(k, [start, 0, 0])
                    if start >= own[2]:
                        own[1:] = own[1] + 1, end + 1
            newlines = [m.start() for m in re.finditer("\n", text)] if found else []
            places = []
            for k, (start, n, _) in found.items():
                if n == 1:
                    first = bisect_left(newlines, start) + 1
                    places.append({"snippet": words[k], "first": first, "last": first + words[k].removesuffix("\n").count("\n")})
            out.append((file, total, places))
            size += sum(len(p["snippet"]) for p in places) + 100
            if size > PLACES_SIZE:
                yield batch()
                out, size = [], 0
    if out:
        yield batch()


def evidence(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with lines checked against their file, and ``problem``: why one is rejected, else null.

    A snippet has to occur exactly once and decides the lines; otherwise the stated range has to end within the file. A
    file's text is read once, whatever the number of its findings, and meets their snippets only.
    """
    asked = findings.filter("file is not null").groupBy("file").agg(F.collect_set("code_snippet").alias("snippets"))
    texts = files.select(F.col("relative_path").alias("file"), F.coalesce("content", F.lit("")).alias("text")).join(asked, "file")
    looked = save(texts.mapInArrow(_places, "file string, total long, places array<struct<snippet:string,first:long,last:long>>"), "places")
    known = looked.select(F.col("file").alias("e_path"), F.col("total").alias("e_total"))
    stands = looked.select(F.col("file").alias("e_file"), F.explode("places").alias("p")).select("e_file", F.col("p.snippet").alias("e_snippet"), F.col("p.first").alias("e_first"), F.col("p.last").alias("e_last"))
    rows = findings.join(known, F.col("file") == F.col("e_path"), "left").join(stands, (F.col("file") == F.col("e_file")) & (F.col("code_snippet") == F.col("e_snippet")), "left")
    has = F.col("code_snippet").isNotNull()
    problem = (
        F.when(F.col("e_path").isNull(), "no such file")
        .when(has & F.col("e_first").isNull(), "snippet does not occur exactly once")
        .when(~has & (F.col("line_start").isNull() | F.col("line_end").isNull()), "no lines")
        .when(~has & ((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")) | (F.col("line_end") > F.col("e_total"))), "lines outside the file")
    )
    kept = [c for c in findings.columns if c not in ("line_start", "line_end")]
    return rows.select(*kept, F.when(has, F.col("e_first")).otherwise(F.col("line_start")).alias("line_start"), F.when(has, F.col("e_last")).otherwise(F.col("line_end")).alias("line_end"), problem.alias("problem"))


def interval_union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): ranges of a key that touch or overlap become one. rows: (keys, start, end) of whole numbers.

    Equal ranges count once, so the order has no ties, but for those that end before they begin by more than one: these do not
    touch even their own copies. A range without an end reaches nothing.
    """
    copies = F.when(F.col("end") + 1 < F.col("start"), F.col("n")).otherwise(1)
    distinct = rows.repartition(*keys).groupBy(*keys, "start", "end").agg(F.count("*").alias("n")).select(*keys, "start", "end", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"), "copy")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") > reach + 1, 1).otherwise(0)
    island = distinct.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")

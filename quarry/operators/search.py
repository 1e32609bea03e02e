"""Regular-expression search by lines, with context lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import lines, truncate_marked

#: Results by default and at most; context lines at most; bytes of a shown line, of a pattern, of all shown
#: text; lines of a file.
DEFAULT_RESULTS, MAX_RESULTS, MAX_CONTEXT, MAX_LINE_BYTES = 500, 1000, 20, 64 << 10
MAX_PATTERN_BYTES, MAX_TEXT_BYTES, MAX_LINES = 4096, 2 << 20, 1_000_000


def search(files: DataFrame, pattern: str, case_sensitive: bool = False, extensions: list[str] | None = None, context: int = 0, max_results: int | None = None) -> DataFrame:
    """(relative_path, line_number, line, before, after) in order of path and line.

    Patterns are Unicode-aware. before and after hold up to ``context`` lines and stop at the file's ends. A file that
    can't match is dropped before its lines are made; context comes from the file's own array, without a shuffle. A file
    with too many lines, or results with too much text, make the query fail when it runs.
    """
    if not pattern or len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise ValueError(f"pattern: 1 to {MAX_PATTERN_BYTES} bytes")
    if not 0 <= context <= MAX_CONTEXT:
        raise ValueError(f"context: 0 to {MAX_CONTEXT}")
    limit = DEFAULT_RESULTS if max_results is None else max_results
    if not 1 <= limit <= MAX_RESULTS:
        raise ValueError(f"max_results: 1 to {MAX_RESULTS}")
    rule = ("(?U)" if case_sensitive else "(?iU)") + pattern
    if extensions is not None:
        files = files.filter(paths.extension(F.col("relative_path")).isin(extensions))
    rows = files.filter(F.col("content").rlike(rule if not set("^$\\") & set(pattern) and "(?" not in pattern else "")).select("relative_path", lines("content").alias("all"))
    rows = rows.withColumn("all", F.when(F.size("all") <= MAX_LINES, F.col("all")).otherwise(F.raise_error(F.lit("a file has too many lines"))))
    rows = rows.filter(F.exists("all", lambda x: x.rlike(rule)))
    rows = rows.select("relative_path", "all", F.posexplode("all").alias("at", "line")).filter(F.col("line").rlike(rule))
    first = F.greatest(F.col("at") - context, F.lit(0))
    cut = lambda a: F.transform(a, lambda x: truncate_marked(x, MAX_LINE_BYTES))
    found = rows.select(
        "relative_path",
        (F.col("at") + 1).cast("long").alias("line_number"),
        truncate_marked("line", MAX_LINE_BYTES).alias("line"),
        cut(F.slice("all", first + 1, F.col("at") - first)).alias("before"),
        cut(F.slice("all", F.col("at") + 2, F.lit(context))).alias("after"),
    )
    found = found.orderBy("relative_path", "line_number").limit(limit)
    size = F.octet_length("line") + F.octet_length(F.array_join("before", "")) + F.octet_length(F.array_join("after", ""))
    total = F.sum(size).over(Window.partitionBy())  # of MAX_RESULTS rows at most
    fits = found.withColumn("total", total).withColumn("line", F.when(F.col("total") <= MAX_TEXT_BYTES, F.col("line")).otherwise(F.raise_error(F.lit("the results hold too much text"))))
    return fits.drop("total").orderBy("relative_path", "line_number")


def search_scoped(files: DataFrame, pattern: str, allowed: DataFrame | None, **options) -> DataFrame:
    """The search of a run that may be held to ``allowed`` (relative_path).

    Without a scope the limit is MAX_RESULTS unless given. With one the search goes over all files under the default limit,
    and what is outside the scope is left out afterwards, so a scoped search may give fewer results than there are.
    """
    if allowed is None:
        return search(files, pattern, **({"max_results": MAX_RESULTS} | options))
    found = search(files, pattern, **{k: v for k, v in options.items() if k != "max_results"})
    inside = found.join(allowed.select("relative_path").distinct(), "relative_path", "left_semi").orderBy("relative_path", "line_number")
    return inside.limit(options.get("max_results", MAX_RESULTS))

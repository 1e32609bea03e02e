"""Static detectors: long files, long functions, unfinished-work comments, hard-coded credentials."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import line_count, lines, newlines, trim, truncate_marked
from . import syntax
from .findings import COLUMNS, SCHEMA

# Markers of unfinished work in the order they are looked for; patterns of credentials, and their names;
# values and parts of values that are no credentials.
MARKERS = ["TODO", "FIXME", "HACK", "XXX"]
SECRETS = {
    "API key": r"""(?iU)\b(?:api[_-]?key|apikey)\b\s*[:=]\s*["']([a-z0-9_-]{16,})["']""",
    "password": r"""(?iU)\b(?:password|passwd|pwd)\b\s*[:=]\s*["']([^\s"']{8,})["']""",
    "secret/token": r"""(?iU)\b(?:secret|token)\b\s*[:=]\s*["']([a-z0-9_-]{16,})["']""",
    "AWS access key": r"""(?U)(?i:\baws_access_key_id\b)\s*[:=]\s*["'](AKIA[A-Z0-9]{16})["']""",
    "private key": r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----",
}
PLACEHOLDERS = ["password", "password123", "secret", "secret123"]
PLACEHOLDER_PARTS = ["example", "sample", "placeholder", "changeme", "change_me", "change-me", "replace", "dummy", "redacted", "notasecret", "not_a_secret", "not-a-secret", "your_", "your-"]
MIN_DISTINCT = 4
SNIPPET_BYTES = 16 << 10


#: A cheap look before the patterns: one of these stands, in any case, in every text that one of them matches.
KEYWORDS = ["api_key", "api-key", "apikey", "passw", "pwd", "secret", "token", "aws_access_key_id", "-----begin "]


def _one(**values) -> Column:
    """A finding as a struct: named values as columns or constants, nulls for the rest."""
    pick = lambda c: values[c] if isinstance(values.get(c), Column) else F.lit(values.get(c))
    return F.struct(*(pick(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA if f.name != "file"))


def _none() -> Column:
    return F.array().cast(T.ArrayType(T.StructType([f for f in SCHEMA if f.name != "file"])))


def _rows(files: DataFrame, found: Column) -> DataFrame:
    """Findings from an array of them in each file."""
    return files.select(F.col("relative_path").alias("file"), F.explode(found).alias("f")).select("file", "f.*").select(*COLUMNS)


def _long_file(threshold: int) -> Column:
    n = line_count("content")
    found = _one(category="quality", severity="medium", confidence="high", source="static", rule="quality.file-length", title="Long file", description=F.concat(F.lit("The file has "), n.cast("string"), F.lit(f" lines; the limit is {threshold}.")))
    return F.when(n > threshold, F.array(found)).otherwise(_none())


def _long_functions(threshold: int) -> Column:
    """From the column ``scanned`` (see ``syntax.with_scan``)."""
    size = lambda x: x["line_end"] - x["line_start"] + 1
    long = F.filter(F.coalesce("scanned.found", F.array().cast(syntax.FOUND)), lambda x: x["kind"].isin("function", "method") & (size(x) > threshold))
    return F.transform(long, lambda x: _one(category="quality", severity=F.when(size(x) > 2 * threshold, "high").otherwise("medium"), confidence="high", source="static", rule="quality.function-length", line_start=x["line_start"], line_end=x["line_end"], title=F.concat(F.lit("Long function: "), x["name"]), description=F.concat(F.lit("The function has "), size(x).cast("string"), F.lit(f" lines; the limit is {threshold}."))))


def long_files(files: DataFrame, threshold: int = 500) -> DataFrame:
    return _rows(files, _long_file(threshold))


def long_functions(files: DataFrame, threshold: int = 50) -> DataFrame:
    return _rows(syntax.with_scan(files, line_count("content") > threshold), _long_functions(threshold))


def _comment_flags(text: str) -> list[bool]:
    """Of each line: does it stand in a block comment or begin a comment?"""
    out, inside = [], False
    for line in text.removesuffix("\n").split("\n"):
        t = line.strip()
        opens = t.startswith("/*")
        out.append(inside or opens or t.startswith(("//", "#")))
        if inside:
            inside = "*/" not in t
        elif opens:
            inside = "*/" not in t[2:]
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _flags(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _comment_flags(t))


def _any_of(text: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def _with_flags(files: DataFrame, markers: list[str]) -> DataFrame:
    """Adds ``flags``: of each line, is it a comment? Null without a marker. Only texts with ``/*`` and a marker go to Python."""
    some, block = _any_of(F.col("content"), markers), F.contains("content", F.lit("/*"))
    starts = lambda x: F.startswith(trim(x), F.lit("//")) | F.startswith(trim(x), F.lit("#"))
    rows = files.withColumn("stateful", _flags(F.when(some & block, F.col("content"))))
    return rows.withColumn("flags", F.coalesce("stateful", F.when(some, F.transform(lines("content"), starts)))).drop("stateful")


def _todo(markers: list[str]) -> Column:
    """From the column ``flags``."""
    at = F.transform(lines("content"), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    hit = F.filter(at, lambda x: F.get("flags", x["at"]) & _any_of(x["line"], markers))
    marker = lambda line: F.coalesce(*(F.when(F.contains(line, F.lit(m)), F.lit(m)) for m in markers))
    one = lambda x: _one(category="quality", severity="low", confidence="high", source="static", rule="quality.todo-comment", line_start=x["at"] + 1, line_end=x["at"] + 1, title=F.concat(marker(x["line"]), F.lit(" comment")), description=F.concat(marker(x["line"]), F.lit(" marks unfinished work.")), code_snippet=truncate_marked(trim(x["line"]), SNIPPET_BYTES))
    return F.when(F.col("flags").isNull(), _none()).otherwise(F.transform(hit, one))


def todo_comments(files: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """One finding for each comment line with a marker."""
    markers = MARKERS if markers is None else markers
    return _rows(_with_flags(files, markers), _todo(markers))


def is_placeholder(value: Column) -> Column:
    """A credential's value that stands for another: a reference, a stock word, or fewer than four distinct bytes."""
    low = F.lower(value)
    out = F.startswith(value, F.lit("${")) | F.startswith(value, F.lit("{{")) | F.startswith(value, F.lit("<")) | low.isin(PLACEHOLDERS)
    for part in PLACEHOLDER_PARTS:
        out = out | F.contains(low, F.lit(part))
    hexes = F.regexp_extract_all(F.hex(low.cast("binary")), F.lit("(..)"), F.lit(1))
    return out | (F.size(F.array_distinct(hexes)) < MIN_DISTINCT)


def _with_secrets(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds ``secrets``, an array of (kind, value, line_start, line_end) of all matches of the patterns, in one pass.

    value is null without a group. Lines come from the texts between matches, so everything stays in the JVM.
    """
    parts, rows = [], files.withColumn("low", F.lower(F.upper("content"))).withColumn("may", _any_of(F.col("low"), KEYWORDS)).drop("low")
    for k, kind in enumerate(kinds):
        rule = SECRETS[kind]
        has = F.col("may") & F.col("content").rlike(rule)
        whole = F.regexp_extract_all("content", F.lit(rule), F.lit(0))
        value = F.regexp_extract_all("content", F.lit(rule), F.lit(1)) if "(" in rule.replace("(?", "") else F.transform(whole, lambda x: F.lit(None).cast("string"))
        parts.append({f"v{k}": F.when(has, value), f"w{k}": F.when(has, F.transform(whole, newlines)), f"b{k}": F.when(has, F.transform(F.split("content", rule, -1), newlines))})
        rows = rows.withColumns(parts[-1])
    up_to = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + x)

    def found(k: int, kind: str) -> Column:
        def one(value: Column, i: Column) -> Column:
            start = 1 + up_to(F.col(f"b{k}"), i + 1) + up_to(F.col(f"w{k}"), i)
            return F.struct(F.lit(kind).alias("kind"), value.alias("value"), start.cast("long").alias("line_start"), (start + F.get(f"w{k}", i)).cast("long").alias("line_end"))

        empty = F.array().cast("array<struct<kind:string,value:string,line_start:bigint,line_end:bigint>>")
        return F.when(F.col(f"v{k}").isNull(), empty).otherwise(F.transform(F.col(f"v{k}"), one))

    return rows.withColumn("secrets", F.concat(*(found(k, x) for k, x in enumerate(kinds)))).drop("may", *(c for p in parts for c in p))


def every_secret(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(relative_path, kind, value, line_start, line_end) of all matches of all patterns, or of those of ``kinds``."""
    rows = _with_secrets(files.select("relative_path", "content"), list(SECRETS) if kinds is None else kinds)
    return rows.select("relative_path", F.explode("secrets").alias("s")).select("relative_path", "s.*")


def _credentials() -> Column:
    """From the column ``secrets``. No snippet, so that reports don't spread them."""
    real = F.filter("secrets", lambda x: x["value"].isNull() | ~is_placeholder(x["value"]))
    return F.transform(real, lambda x: _one(category="vulnerability", severity="critical", confidence="medium", source="static", rule="vulnerability.hardcoded-secret", line_start=x["line_start"], line_end=x["line_end"], title=F.concat(F.lit("Hard-coded "), x["kind"]), description=F.concat(F.lit("A value that looks like a credential ("), x["kind"], F.lit(") stands in the source."))))


def secrets(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Hard-coded credentials as findings, without placeholders."""
    return _rows(_with_secrets(files.select("relative_path", "content"), list(SECRETS) if kinds is None else kinds), _credentials())


def static_findings(files: DataFrame, categories: list[str], max_file_lines: int = 500, max_function_lines: int = 50) -> DataFrame:
    """All detectors that the categories ask for, in one pass over the files.

    Files that are scanned already keep their ``scanned``; of others those are scanned that have lines enough for a finding."""
    rows, parts = files, [_none()]
    if "quality" in categories:
        rows = rows if "scanned" in files.columns else syntax.with_scan(rows, line_count("content") > max_function_lines)
        rows = _with_flags(rows, MARKERS)
        parts += [_long_file(max_file_lines), _long_functions(max_function_lines), _todo(MARKERS)]
    if "vulnerability" in categories:
        rows = _with_secrets(rows, list(SECRETS))
        parts.append(_credentials())
    return _rows(rows, F.concat(*parts))

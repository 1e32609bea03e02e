"""Line statistics: blank, comment and code lines by language."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import languages
from ..functions.text import WHITE, newlines


def _opens_block(text: Column, style: Column) -> Column:
    """Does the text hold what opens a block comment of its style?"""
    out = F.lit(False)
    for name, (_, blocks) in languages.STYLES.items():
        for opener, _ in blocks:
            out = out | ((style == name) & F.contains(text, F.lit(opener)))
    return out


def _line_comments(text: Column, style: Column) -> Column:
    """Lines that begin with a line-comment marker of the style, counted in the text without splitting it."""
    out = F.lit(0)
    for name, (markers, _) in languages.STYLES.items():
        if markers:
            out = F.when(style == name, F.regexp_count(text, F.lit(rf"(?m)^(?<![^\n]){WHITE}*(?:{'|'.join(map(re.escape, markers))})"))).otherwise(out)
    return out


def comment_lines(text: str, style: str) -> int:
    """Comment lines of a text with block comments: a line counts if it has comment but no code."""
    markers, blocks = languages.STYLES[style]
    total, close = 0, None
    for line in text.removesuffix("\n").split("\n"):
        rest, comment, code = line.strip(), False, False
        while rest:
            if close:
                comment = True
                head, found, rest = rest.partition(close)
                close = None if found else close
                rest = rest.lstrip()
                continue
            at = sorted((i, k) for k, m in enumerate([b[0] for b in blocks] + markers) if (i := rest.find(m)) >= 0)
            code = code or not at or at[0][0] > 0
            if not at or at[0][1] >= len(blocks):
                comment = comment or bool(at)
                break
            comment = True
            opener, close = blocks[at[0][1]]
            rest = rest[at[0][0] + len(opener) :]
        total += comment and not code
    return total


@F.pandas_udf(T.LongType())
def _comments(text: pd.Series, style: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else comment_lines(t, s) for t, s in zip(text, style, strict=True)], dtype="Int64")


def line_counts(files: DataFrame) -> DataFrame:
    """(relative_path, language, code, comments, blanks) of files with a known language, in one pass.

    Lines are counted by patterns over the whole text. Only texts that open a block comment need state from line to line;
    of all others nothing but nulls goes to Python.
    """
    body = F.when(F.endswith("content", F.lit("\n")), F.expr("left(content, length(content) - 1)")).otherwise(F.col("content"))
    rows = files.filter("language is not null").select("relative_path", "language", languages.style(F.col("language")).alias("style"), body.alias("body"), (F.col("content") == "").alias("empty"))
    rows = rows.select(
        "relative_path",
        "language",
        "style",
        F.when(F.col("empty"), 0).otherwise(newlines(F.col("body")) + 1).cast("long").alias("n"),
        F.when(F.col("empty"), 0).otherwise(F.regexp_count("body", F.lit(rf"(?:\A|\n){WHITE}*(?=\n|\z)"))).cast("long").alias("blanks"),
        _line_comments(F.col("body"), F.col("style")).cast("long").alias("plain"),
        F.when(_opens_block(F.col("body"), F.col("style")), F.col("body")).alias("blocks"),
    )
    rows = rows.select("*", F.coalesce(_comments("blocks", "style"), "plain").alias("comments"))
    return rows.select("relative_path", "language", (F.col("n") - F.col("blanks") - F.col("comments")).alias("code"), "comments", "blanks")


def by_language(counts: DataFrame) -> DataFrame:
    """(language, name, files, code, comments, blanks), most code first, ties by language id."""
    sums = counts.groupBy("language").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("code", "comments", "blanks")))
    return sums.select("language", languages.shown(F.col("language")).alias("name"), "files", "code", "comments", "blanks").orderBy(F.desc("code"), "language")


def totals(counts: DataFrame) -> DataFrame:
    """One row: files, lines, code, comments, blanks."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("code", "comments", "blanks")]
    return counts.agg(F.count("*").alias("files"), *sums).select("files", F.expr("code + comments + blanks").alias("lines"), "code", "comments", "blanks")


def shares(by: DataFrame, top: int = 5) -> DataFrame:
    """(language, percent) of code of the first languages, rounded down; 0 if there is no code at all."""
    every = Window.partitionBy()  # a row a language
    part = by.select("language", "code", F.sum("code").over(every).alias("whole")).orderBy(F.desc("code"), "language").limit(top)
    return part.select("language", F.expr("case when whole = 0 then 0 else code * 100 div whole end").alias("percent"))

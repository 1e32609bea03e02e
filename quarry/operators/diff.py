"""Unified diffs as changed ranges of files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a diff, files, ranges of a file, ranges in all, bytes of a path.
MAX_BYTES, MAX_FILES, MAX_RANGES, MAX_TOTAL, MAX_PATH = 32 << 20, 10_000, 10_000, 100_000, 4096
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", '"': '"', "\\": "\\"}


class DiffError(ValueError):
    """The diff can't be read safely."""


def _path(text: str) -> str | None:
    """The path of a ``---`` or ``+++`` line; null for /dev/null."""
    if text.startswith('"'):
        raw, i = bytearray(), 1
        while True:
            if i >= len(text):
                raise DiffError("quoted path without end")
            c = text[i]
            if c == '"':
                break
            if c != "\\":
                raw += c.encode()
                i += 1
            elif m := re.match(r"[0-3][0-7]{2}", text[i + 1 :]):
                raw.append(int(m[0], 8))
                i += 4
            elif text[i + 1 : i + 2] in _ESCAPES and text[i + 1 : i + 2]:
                raw += _ESCAPES[text[i + 1]].encode()
                i += 2
            else:
                raise DiffError("unknown escape in a quoted path")
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            raise DiffError("path is not UTF-8") from None
    else:
        text = text.split("\t", 1)[0]
    if text == "/dev/null":
        return None
    text = text[2:] if text.startswith(("a/", "b/")) else text
    parts = [p for p in text.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or text.startswith("/") or ".." in parts or ":" in text or len(text.encode()) > MAX_PATH:
        raise DiffError("unsafe path")
    return "/".join(parts)


def parse(diff: str) -> list[tuple[str, int | None, int | None]]:
    """(path, first, last) of new lines; a file without any (deleted, only removals) once with nulls."""
    if len(diff.encode()) > MAX_BYTES:
        raise DiffError("diff too large")
    found: dict[str, list[tuple[int, int]]] = {}
    old, old_left, new_left, path = None, 0, 0, None
    for line in diff.split("\n"):
        line = line.removesuffix("\r")
        before, old = old, None  # the two headers of a file are neighbours
        if old_left > 0 or new_left > 0:  # inside a hunk, whatever its lines look like
            if not line.startswith("\\"):
                old_left -= not line.startswith("+")
                new_left -= not line.startswith("-")
            continue
        if line.startswith("diff --git"):
            path = None
        elif line.startswith("--- "):
            old = line[4:]
        elif line.startswith("+++ ") and before is not None:
            path = _path(line[4:]) or _path(before)
            if path is None:
                raise DiffError("no path on either side")
            found.setdefault(path, [])
            if len(found) > MAX_FILES:
                raise DiffError("too many files")
        elif m := _HUNK.match(line):
            old_left, start, count = int(m[2] or 1), int(m[3]), int(m[4] or 1)
            new_left = count
            if path is not None and start and count and start + count - 1 < 1 << 32:
                found[path].append((start, start + count - 1))
                if len(found[path]) > MAX_RANGES or sum(map(len, found.values())) > MAX_TOTAL:
                    raise DiffError("too many ranges")
    return [(p, a, b) for p, r in sorted(found.items()) for a, b in (r or [(None, None)])]


def hunks(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, start, end, error) of ``diffs`` (diff_id, diff): a row a range, or one row with an error."""
    kind = diffs.schema["diff_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, text in zip(f["diff_id"], f["diff"], strict=True):
                try:
                    out += [(i, *x, None) for x in parse(text or "")]
                except DiffError as e:
                    out.append((i, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["diff_id", "path", "start", "end", "error"]).astype({"start": "Int64", "end": "Int64"})

    return diffs.select("diff_id", "diff").mapInPandas(run, f"diff_id {kind}, path string, start long, end long, error string")


def header_ranges(lines: DataFrame) -> DataFrame:
    """(path, start, end) from hunk headers alone. lines: (path, line). Zero starts and counts have no range."""
    rule = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = lines.filter(F.col("line").rlike(rule)).select("path", F.regexp_extract("line", rule, 1).cast("long").alias("start"), F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(line, r'{rule}', 2), '') as bigint)"), F.lit(1)).alias("n"))
    return rows.filter("start > 0 and n > 0").select("path", "start", (F.col("start") + F.col("n") - 1).alias("end"))

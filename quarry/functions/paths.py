"""Path columns: parts, normal form, order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, unless the name begins with that dot; else empty."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def components(path: Column) -> Column:
    """For ordering by components: ``a/b`` comes before ``a-b``, while bytes order them the other way."""
    return F.split(path, "/")


def normalized(raw: Column) -> tuple[Column, Column]:
    """(normal form, error): backslashes are slashes, empty parts and dots go; exactly one of the two is null."""
    p = F.replace(raw, F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    kept = F.array_join(F.filter(parts, lambda x: ~x.isin("", ".")), "/")
    error = (
        F.when(raw.isNull() | (raw == ""), F.lit("empty"))
        .when(F.contains(raw, F.lit(":")), F.lit("colon"))
        .when(F.startswith(p, F.lit("/")), F.lit("absolute"))
        .when(F.array_contains(parts, ".."), F.lit("parent"))
        .when(kept == "", F.lit("empty"))
    )
    return F.when(error.isNull(), kept), error


def key(raw: Column) -> Column:
    """A path's bytes as text; one that is not UTF-8 as ``<bytes>:`` and its bytes, all but plain ones as ``%XX``."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    letter = lambda x: F.chr(F.conv(x, 16, 10).cast("int"))
    plain = lambda x: F.conv(x, 16, 10).cast("int").between(0x21, 0x7E) & letter(x).rlike("[A-Za-z0-9/._-]")
    shown = F.array_join(F.transform(pairs, lambda x: F.when(plain(x), letter(x)).otherwise(F.concat(F.lit("%"), x))), "")
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("<bytes>:"), shown))

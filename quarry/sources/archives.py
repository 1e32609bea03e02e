"""Zip archives as a source: entries are checked as a relation before a byte of them is unpacked.

A task reads an archive's central directory, by ranges at its end, and gives a row an entry. ``preflight`` names what is
wrong with each; an archive with any problem is refused as a whole. Of the others a second task each streams the entries.
Archives are files that executors can open.
"""

from __future__ import annotations

import os
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import save

#: Entries, bytes unpacked in all and of one entry, depth, compression ratio above a size; bytes of an archive,
#: of a name, of all names.
MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY, MAX_DEPTH, MAX_RATIO, RATIO_FROM = 100_000, 1 << 30, 128 << 20, 128, 1000, 1 << 20
MAX_ARCHIVE, MAX_NAME, MAX_NAMES = 256 << 20, 4096, 32 << 20
ENTRIES = "archive_id string, name string, size long, compressed long, mode int, is_dir boolean, problem string"
_FOOTER = struct.Struct("<4s4H2LH")
_ROWS = 2000


def preflight(entries: DataFrame) -> DataFrame:
    """(archive_id, name, problem) of ``entries`` (archive_id, name, size, compressed, mode, is_dir).

    One rule is one predicate; the first that is broken is named, null if none. An archive has one top-level folder.
    """
    parts = F.filter(F.split("name", "/"), lambda p: p != "")
    every = Window.partitionBy("archive_id")
    kind = F.col("mode").bitwiseAND(0o170000)
    rows = entries.withColumn("parts", parts).withColumn("top", F.get("parts", F.lit(0)))
    rows = rows.withColumn("count", F.count("*").over(every)).withColumn("total", F.sum("size").over(every))
    rows = rows.withColumn("tops", F.size(F.collect_set("top").over(every)))
    rows = rows.withColumn("same", F.count("*").over(Window.partitionBy("archive_id", F.array_join("parts", "/"))))
    problem = (
        F.when(F.col("count") > MAX_ENTRIES, "too many entries")
        .when(F.col("total") > MAX_TOTAL, "archive too large")
        .when(F.col("size") > MAX_ENTRY, "entry too large")
        .when(F.octet_length("name") > MAX_NAME, "name too long")
        .when(F.startswith("name", F.lit("/")), "absolute")
        .when(F.contains("name", F.lit("\\")), "backslash")
        .when(F.col("name").rlike("^[A-Za-z]:"), "drive")
        .when(F.exists("parts", lambda p: p.isin(".", "..")), "dot component")
        .when(F.size("parts") == 0, "empty name")
        .when(F.size("parts") > MAX_DEPTH, "too deep")
        .when(~kind.isin(0, 0o100000, 0o040000), "link or special file")
        .when((F.col("size") > RATIO_FROM) & (F.col("size") > MAX_RATIO * F.greatest(F.col("compressed"), F.lit(1))), "compression ratio")
        .when(F.col("same") > 1, "duplicate")
        .when(F.col("tops") > 1, "more than one top-level folder")
        .when((F.size("parts") == 1) & ~F.col("is_dir"), "the top is no folder")
    )
    return rows.select("archive_id", "name", problem.alias("problem"))


def declared(path: str) -> int:
    """The number of entries that an archive's footer declares; a ValueError if it has none, two, or lies on several disks."""
    size = os.path.getsize(path)
    if size > MAX_ARCHIVE:
        raise ValueError(f"more than {MAX_ARCHIVE} bytes")
    with open(path, "rb") as f:
        f.seek(max(0, size - _FOOTER.size - 0xFFFF))
        tail = f.read()
    found = []
    at = tail.find(b"PK\x05\x06")
    while at >= 0:
        if at + _FOOTER.size <= len(tail):
            _, disk, start, here, total, _, _, comment = _FOOTER.unpack_from(tail, at)
            if at + _FOOTER.size + comment == len(tail):
                found.append((disk, start, here, total, at))
        at = tail.find(b"PK\x05\x06", at + 1)
    if len(found) != 1:
        raise ValueError("no footer" if not found else "two footers")
    disk, start, here, total, at = found[0]
    if total == 0xFFFF and at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        base = size - len(tail)
        offset = struct.unpack_from("<Q", tail, at - 20 + 8)[0]
        if not base <= offset <= base + at - 76:
            raise ValueError("a large archive's footer stands elsewhere")
        disk, start, here, total = struct.unpack_from("<LLQQ", tail, offset - base + 16)
    if disk or start:
        raise ValueError("spans several disks")
    if here != total:
        raise ValueError("declares two numbers of entries")
    return total


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            rows: list[tuple] = []
            try:
                if declared(path) > MAX_ENTRIES:
                    raise ValueError("too many entries")
                with zipfile.ZipFile(path) as z:
                    infos = z.infolist()
                    if sum(len(i.orig_filename.encode()) for i in infos) > MAX_NAMES:
                        raise ValueError("names too long together")
                    rows = [(path, i.orig_filename, i.file_size, i.compress_size, i.external_attr >> 16 if i.create_system == 3 else 0, i.is_dir(), "encrypted" if i.flag_bits & 1 else None) for i in infos]
                    if not any(not i.is_dir() for i in infos):
                        raise ValueError("no files")
            except (OSError, ValueError, zipfile.BadZipFile, struct.error, NotImplementedError) as e:
                rows = [(path, None, None, None, None, None, str(e) or type(e).__name__)]
            for a in range(0, len(rows), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + _ROWS], strict=True), _LISTED, strict=True)], [c.split()[0] for c in ENTRIES.split(", ")])


_LISTED = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]


def _spread(spark, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "archive_id string").repartition(max(1, min(256, len(paths))))


def entries(spark, paths: list[str]) -> DataFrame:
    """ENTRIES of zip archives: a row an entry, or one row with the problem of an archive that cannot be listed."""
    return _spread(spark, paths).mapInArrow(_listed, ENTRIES)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            with zipfile.ZipFile(path) as z:
                for i in z.infolist():
                    if i.is_dir():
                        continue
                    try:
                        with z.open(i) as f:
                            data = f.read(i.file_size + 1)  # no more than was declared, and one byte to tell
                        problem = None if len(data) == i.file_size else "size differs"
                    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, ValueError) as e:
                        data, problem = None, str(e) or type(e).__name__
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i.filename.split("/", 1)[1]]), pa.array([data if problem is None else None], pa.binary()), pa.array([problem], pa.string())], ["archive_id", "relative_path", "data", "problem"])


def unpack(spark, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, refused) of zip archives: (archive_id, relative_path, content binary) below each one's top folder, and
    (archive_id, name, problem) of what the archives that are refused as a whole are refused for."""
    listed = save(entries(spark, paths), "entries")
    bad = listed.filter("problem is not null").select("archive_id", "name", "problem")
    known = listed.join(bad.select("archive_id"), "archive_id", "left_anti").drop("problem")
    refused = save(bad.unionByName(preflight(known).filter("problem is not null")), "refused")
    good = _spread(spark, paths).join(refused.select("archive_id"), "archive_id", "left_anti").repartition(max(1, min(256, len(paths))))
    read = save(good.mapInArrow(_unpacked, "archive_id string, relative_path string, data binary, problem string"), "unpacked")
    broken = read.filter("problem is not null")
    files = read.filter("problem is null").join(broken.select("archive_id"), "archive_id", "left_anti")
    return files.select("archive_id", "relative_path", F.col("data").alias("content")), refused.unionByName(broken.select("archive_id", F.col("relative_path").alias("name"), "problem"))

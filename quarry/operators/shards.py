"""Shards of files under a token budget, maps of signatures, and byte budgets of different kinds."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent_dir
from ..sources.tables import save
from .ordering import ranges, running, runs

#: Shards that are worked on; bytes a token; bytes a line.
MAX_SHARDS, TOKEN_BYTES, LINE_BYTES = 50, 4, 30


def file_tokens() -> Column:
    """Tokens of a file: its bytes and those of its line in a listing, a quarter each, one at least."""
    listing = F.octet_length("relative_path") + F.octet_length(F.floor(F.col("size_bytes") / LINE_BYTES).cast("string")) + 12
    return F.greatest(F.lit(1), F.floor((F.col("size_bytes") + listing) / TOKEN_BYTES)).cast("long")


def directory_runs(files: DataFrame) -> DataFrame:
    """(relative_path, size_bytes, directory, run, place): files in byte order, numbered by runs of one directory.

    The byte order can part a directory's files, so one directory may have several runs.
    """
    d = files.select("relative_path", "size_bytes", parent_dir(F.col("relative_path")).alias("directory"))
    return runs(d, ["relative_path"], "directory", "run")


def _steps(tokens: np.ndarray, budget: int) -> tuple[list[int], list[int], list[int]]:
    """What a range of units does to the shard that is open before it, for every amount that may be in that.

    Its unit i begins a new shard if the amount and the units up to i overflow, but not those before. For each i that can be
    the first one to do so: the units' sum up to and with it, and then the amount in the shard that is open behind the range
    and the number of shards begun in it.
    """
    until = np.cumsum(tokens)
    before = until - tokens
    n = len(tokens)
    following = np.maximum(np.arange(n) + 1, np.searchsorted(until, before + budget, "right")).tolist()
    amount, begun = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = following[i]
        amount[i], begun[i] = (int(until[-1] - before[i]), 1) if j == n else (amount[j], begun[j] + 1)
    first = min(n, int(np.searchsorted(until, budget, "right")) + 1)  # an open shard holds something, so none is beyond
    return until[:first].tolist(), amount[:first], begun[:first]


def pack_shards(files: DataFrame, budget: int) -> DataFrame:
    """(relative_path, tokens, shard_id): runs of a directory together while they fit; a larger run goes file by file.

    Each unit goes to the present shard, or, if that would overflow, to a new one. A file beyond the budget is alone.
    Units are dealt into ranges of their order. What a range makes of the shard that is open before it depends on the amount
    in that alone, and takes at most as many values as the budget has tokens: all ranges find theirs at once. From these the
    amounts before each range follow, a row a range, and then all ranges give their units' shards at once.
    """
    sized = save(directory_runs(files).withColumn("tokens", file_tokens()), "sized")
    whole = sized.groupBy("run").agg(F.sum("tokens").alias("total"), F.min("place").alias("first"))
    units = save(sized.join(whole, "run").select("relative_path", "tokens", F.when(F.col("total") > budget, F.col("place")).otherwise(F.col("first")).alias("unit")), "units")
    table = ranges(units.groupBy("unit").agg(F.sum("tokens").alias("tokens")), ["unit"])

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)  # one range, or several
        if held:
            for part, f in pd.concat(held).groupby("part"):
                until, amount, begun = _steps(f.sort_values("at")["tokens"].to_numpy(), budget)
                yield pd.DataFrame({"part": [part], "total": [int(f["tokens"].sum())], "until": [until], "amount": [amount], "begun": [begun]})

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table.repartitionById(n, "part")
    found = dealt.mapInPandas(look, "part int, total long, until array<long>, amount array<long>, begun array<long>")
    entries, amount, shard = [], 0, -1
    for r in found.orderBy("part").toLocalIterator():  # a row a range, with at most as many numbers as the budget
        entries.append((r.part, amount, shard))
        # The first unit that overflows; the very first one of all begins a shard.
        i = 0 if shard < 0 else bisect_right(r.until, budget - amount)
        if i < len(r.until):
            amount, shard = r.amount[i], shard + r.begun[i]
        else:
            amount += r.total

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, used, shard = None, 0, -1
        for f in frames:
            ids = []
            for p, n, a, s in zip(f["part"].tolist(), f["tokens"].tolist(), f["amount"].tolist(), f["shard"].tolist(), strict=True):
                if p != part:
                    part, used, shard = p, a, s
                if shard < 0 or used and used + n > budget:
                    shard, used = shard + 1, 0
                used += n
                ids.append(shard)
            yield pd.DataFrame({"unit": f["unit"], "shard_id": ids})

    known = files.sparkSession.createDataFrame(entries, "part int, amount long, shard long")
    sorted_ = table.join(F.broadcast(known), "part").repartitionById(n, "part").sortWithinPartitions("part", "at")
    return units.join(sorted_.mapInPandas(pack, "unit long, shard_id long"), "unit").select("relative_path", "tokens", "shard_id")


def processed(shards: DataFrame, most: int = MAX_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(files of the first shards, rows (relative_path, reason) of all others)."""
    rest = shards.filter(F.col("shard_id") >= most)
    return shards.filter(F.col("shard_id") < most), rest.select("relative_path", F.lit("shard limit reached").alias("reason"))


def stop_at_budget(rows: DataFrame, order: list[str], size: str, budget: int, least: int = 8) -> DataFrame:
    """Rows up to the first that overflows the budget; that one is kept, with ``room`` for a part of it, if at least
    ``least`` bytes are free. ``room`` is null for rows that fit."""
    r = running(rows, order, size, "used").withColumn("before", F.col("used") - F.col(size))
    r = r.filter((F.col("used") <= budget) | ((F.col("before") <= budget) & (budget - F.col("before") >= least)))
    return r.withColumn("room", F.when(F.col("used") > budget, budget - F.col("before"))).drop("used", "before")


def _admitted(rows: DataFrame, order: list[str], sizes: list[str], most: list[int]) -> DataFrame:
    """Rows in order while they fit: sums of ``sizes`` up to ``most``, with part and at, their place in the order. One that
    would overflow is left out, later smaller ones may still come in.

    Rows are dealt into ranges of their order, of which the sums and least sizes are known. A range that fits as a whole
    comes in as a whole; one whose least row no longer fits is not looked at; the few others are gone through one after the
    other, each by a task of its own. Nothing but a row a range and the sums reaches the driver.
    """
    table = ranges(rows, order)
    room, whole, parts = list(most), [], []

    def fold(frames: Iterator[pd.DataFrame], room: list[int]) -> Iterator[pd.DataFrame]:
        left = list(room)
        for f in frames:
            keep = []
            for own in zip(*(f[c].tolist() for c in sizes), strict=True):
                ok = all(x <= r for x, r in zip(own, left, strict=True))
                left = [r - x * ok for x, r in zip(own, left, strict=True)]
                keep.append(ok)
            yield f[keep]

    facts = [*(F.sum(c).alias(f"_sum{k}") for k, c in enumerate(sizes)), *(F.min(c).alias(f"_min{k}") for k, c in enumerate(sizes))]
    for r in table.groupBy("part").agg(*facts).orderBy("part").collect():  # a row a range
        if any(r[f"_min{k}"] > x for k, x in enumerate(room)):
            continue
        sums = [r[f"_sum{k}"] for k in range(len(sizes))]
        if all(x <= y for x, y in zip(sums, room, strict=True)):
            whole.append(r.part)
        else:
            one = table.filter(F.col("part") == r.part).coalesce(1).sortWithinPartitions("at")
            parts.append(save(one.mapInPandas(partial(fold, room=list(room)), table.schema), "admitted"))
            sums = parts[-1].agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in sizes)).first()
        room = [int(y - x) for x, y in zip(sums, room, strict=True)]
    out = table.filter(F.col("part").isin(whole))
    for p in parts:
        out = out.unionByName(p)
    return out


def admit_each(rows: DataFrame, order: list[str], size: str, most: int, most_bytes: int) -> DataFrame:
    """Rows in order while they fit into ``most`` rows and ``most_bytes``: one that would overflow is left out, later smaller
    ones may still come in."""
    kept = _admitted(rows.withColumn("_one", F.lit(1)), order, ["_one", size], [most, most_bytes])
    return kept.orderBy("part", "at").drop("part", "at", "_one")


def admit_submissions(rows: DataFrame, size: str, most: int, most_bytes: int) -> DataFrame:
    """Rows (with ``submission``, a growing number) of the submissions that fit as a whole, in order."""
    sums = rows.groupBy("submission").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return rows.join(_admitted(sums, ["submission"], ["n", "bytes"], [most, most_bytes]), "submission", "left_semi")


def diagnostics(rows: DataFrame, order: list[str], most: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(kept, one row with ``omitted``) of messages (text): those that fit in this order, shown sorted; the rest is counted."""
    sized = rows.withColumn("bytes", F.octet_length("text"))
    kept = admit_each(sized, order, "bytes", most, most_bytes).drop("bytes")
    counts = rows.select(F.lit(1).alias("n")).union(kept.select(F.lit(-1))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("omitted"))
    return kept.orderBy("text"), counts


def listing(files: DataFrame, signatures: DataFrame, budget: int, most_bytes: int) -> DataFrame:
    """(relative_path, line, signatures): the lines of a repository listing in path order that fit into ``most_bytes``, each
    with its signatures as long as those fit into ``budget`` tokens.

    A line that does not fit is left out, later ones may still come in; signatures stop for good at the first file that
    overflows. files: (relative_path, size_bytes); signatures: (relative_path, line_start, text).
    """
    line = F.concat(F.lit("- "), "relative_path", F.lit(" (~"), F.floor(F.col("size_bytes") / LINE_BYTES).cast("string"), F.lit(" lines)\n"))
    lines = files.select("relative_path", line.alias("line"), F.octet_length(line).alias("bytes"))
    kept = save(admit_each(lines, ["relative_path"], "bytes", 1 << 62, most_bytes).select("relative_path", "line"), "listing")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "text"))), lambda x: F.concat(F.lit("    "), x["text"], F.lit("\n"))), "")
    texts = signatures.join(kept.select("relative_path"), "relative_path", "left_semi").groupBy("relative_path").agg(shown.alias("signatures"))
    texts = texts.withColumn("tokens", F.ceil(F.octet_length("signatures") / TOKEN_BYTES).cast("long"))
    fit = running(texts, ["relative_path"], "tokens", "used").filter(F.col("used") <= budget).select("relative_path", "signatures")
    return kept.join(fit, "relative_path", "left").select("relative_path", "line", "signatures")

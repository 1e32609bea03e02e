"""Ignore rules as relations: which paths of a table do the rules of a table leave out?

Sources are ignore files: (folder, kind, content). A rule holds for what lies below its folder. Every path is judged with
all its folders, since nothing below an ignored folder can be reinstated; folders are joined to the rules that lie in them and
above, once for all paths of a folder. Of the sources of one kind the nearest folder that says anything decides,
in it the last rule that matches; of the kinds the first in the order of ``KINDS``.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import globs
from ..sources.tables import save

#: ``.ignore``; ``.gitignore``; a checkout's ``info/exclude``; the user's own, which lie in the root.
KINDS = ["ignore", "gitignore", "exclude", "global"]


@F.pandas_udf(T.StructType([T.StructField("regex", T.StringType()), T.StructField("reinstates", T.BooleanType()), T.StructField("folders", T.BooleanType()), T.StructField("problem", T.StringType())]))
def _compiled(lines: pd.Series) -> pd.DataFrame:
    out = []
    for line in lines:
        try:
            r = globs.rule(line)
            out.append((r.regex, r.reinstates, r.folders, None) if r else (None, None, None, None))
        except ValueError as e:
            out.append((None, None, None, str(e)))
    return pd.DataFrame(out, columns=["regex", "reinstates", "folders", "problem"])


def rules(sources: DataFrame) -> DataFrame:
    """(folder, kind, line, pattern, regex, reinstates, folders, problem): a row a pattern; problem: why one is left out."""
    text = F.regexp_replace("content", "^﻿", "")
    lines = sources.select("folder", "kind", F.posexplode(F.split(text, "\r?\n")).alias("i", "pattern")).filter("pattern rlike '(?U)[^\\\\s]' and not startswith(pattern, '#')")
    return lines.withColumn("r", _compiled("pattern")).select("folder", "kind", (F.col("i") + 1).alias("line"), "pattern", "r.*").filter("regex is not null or problem is not null")


def _prefixes(path: Column) -> Column:
    """All folders above a path and the path itself: structs of what is judged and whether it is a folder."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


@lru_cache(maxsize=4096)
def _matcher(regex: str) -> re.Pattern:
    return globs.compiled(regex)


@lru_cache(maxsize=1024)
def _chain(text: str) -> list[list[tuple[int, list[tuple[bool, bool, re.Pattern]]]]]:
    """Of each kind its sources, the nearest first: characters of a path that its folder takes, and its rules, the last first."""
    kinds: dict[int, list] = {}
    for source in json.loads(text):
        own = [(r["folders"], not r["reinstates"], _matcher(r["regex"])) for r in reversed(source["rules"])]
        kinds.setdefault(source["kind"], []).append((source["cut"], own))
    return list(kinds.values())


@F.arrow_udf(T.BooleanType())
def _said(subject: pa.Array, is_folder: pa.Array, chain: pa.Array) -> pa.Array:
    """Is a path left out (true), kept (false), or does no rule match it?"""
    out: list[bool | None] = []
    for path, folder, text in zip(subject.to_pylist(), is_folder.to_pylist(), chain.to_pylist(), strict=True):
        said = None
        for sources in _chain(text) if text is not None and path is not None else ():
            for cut, own in sources:
                rest = path[cut:]
                said = next((ignores for folders, ignores, matcher in own if (folder or not folders) and matcher.match(rest)), None)
                if said is not None:
                    break
            if said is not None:
                break
        out.append(said)
    return pa.array(out, pa.bool_())


def _key(path: str) -> Column:
    """What stands up to the last slash and with it: the same for all paths of a folder."""
    p = F.col(path)
    return F.substring(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)))


def _above(key: str) -> Column:
    """The folders of a key, without the root."""
    k = F.col(key)
    return F.when(k == "", F.array().cast("array<string>")).otherwise(_prefixes(F.substring(k, F.lit(1), F.length(k) - 1)))


def _folders(paths: DataFrame, rules_: DataFrame) -> DataFrame:
    """(key, chain, gone), a row a folder that paths lie in: the rules above what lies there, and is the folder left out?"""
    keys = paths.filter("relative_path is not null").select(_key("relative_path").alias("key")).distinct()
    whole = save(keys.select("key", F.explode_outer(_above("key")).alias("folder")), "folders")
    folders = whole.filter("folder is not null").select("folder").distinct().withColumn("key", _key("folder"))
    own = rules_.filter("regex is not null").filter(F.col("kind").isin(KINDS)).groupBy("folder", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "regex", "reinstates", "folders"))), lambda r: F.struct(r["regex"].alias("regex"), r["reinstates"].alias("reinstates"), r["folders"].alias("folders"))).alias("rules"))
    place = F.create_map(*(F.lit(x) for kv in zip(KINDS, range(len(KINDS)), strict=True) for x in kv))[F.col("kind")]
    above = whole.select("key").union(folders.select("key")).distinct().select("key", F.posexplode(F.concat(F.array(F.lit("")), _above("key"))).alias("depth", "folder"))
    cut = F.when(F.col("folder") == "", 0).otherwise(F.length("folder") + 1)
    reached = above.join(own, "folder").select("key", F.struct(place.alias("kind"), (-F.col("depth")).alias("near"), cut.alias("cut"), "rules").alias("source"))
    chains = save(reached.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list("source"))).alias("chain")), "chains")
    left_out = folders.join(chains, "key", "left").filter(_said("folder", F.lit(True), "chain")).select("folder")
    gone = whole.join(left_out, "folder").select("key").distinct().withColumn("gone", F.lit(True))
    return save(whole.select("key").distinct().join(chains, "key", "left").join(gone, "key", "left"), "judged")


def _flagged(paths: DataFrame, rules_: DataFrame, is_folder: Column) -> DataFrame:
    """``paths`` with ignored. Folders are judged once; a path then meets its folder's row only, which is sent to all tasks
    where the table of folders is small."""
    rows = paths.withColumn("_key", _key("relative_path")).join(_folders(paths, rules_).toDF("_key", "_chain", "_gone"), "_key", "left")
    said = _said("relative_path", is_folder, F.when(F.col("_gone").isNull(), F.col("_chain")))
    return rows.withColumn("ignored", F.coalesce("_gone", said, F.lit(False))).select(*(F.col(c) for c in paths.columns), "ignored")


def judged(paths: DataFrame, rules_: DataFrame) -> DataFrame:
    """(relative_path, is_folder, ignored) of each row of ``paths`` (relative_path, is_folder). rules_: as ``rules`` gives them."""
    rows = paths.filter("relative_path is not null").select("relative_path", "is_folder").distinct()
    return _flagged(rows, rules_, F.col("is_folder"))


def kept(files: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of ``files`` (relative_path, ...) that no rule of ``sources`` leaves out."""
    return _flagged(files, rules(sources), F.lit(False)).filter("not ignored").drop("ignored")

"""The findings relation: schema, total order, ids, filters, the two ways of removing duplicates, summaries."""

from __future__ import annotations

from bisect import bisect_right
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import save
from .ordering import placed

# Ranks of severities and confidences, order and id prefixes of categories.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]
CATEGORIES = {"bug": "BUG", "quality": "QUAL", "solid": "SOLID", "vulnerability": "VULN"}
SOURCES = ["static", "ai"]

COLUMNS = "category severity title description file line_start line_end code_snippet suggestion rule confidence source".split()
SCHEMA = T.StructType([T.StructField(c, T.LongType() if c.startswith("line_") else T.StringType()) for c in COLUMNS])


def rank(column: str, names) -> Column:
    """The place of a name in its order; null for others."""
    return F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))[F.col(column)]


def shaped(rows: DataFrame, **values) -> DataFrame:
    """Findings from rows: named values as columns or constants, nulls for the rest."""
    kinds = {f.name: f.dataType for f in SCHEMA}
    pick = lambda c: values[c] if isinstance(values.get(c), Column) else F.lit(values.get(c))
    return rows.select(*(pick(c).cast(kinds[c]).alias(c) for c in COLUMNS))


def total_order() -> list[Column]:
    """Severity, confidence, category, path by components, lines (nulls last), source, rule (nulls first), texts."""
    return [
        rank("severity", SEVERITIES).desc(),
        rank("confidence", CONFIDENCES).desc(),
        rank("category", CATEGORIES).asc(),
        F.split("file", "/").asc(),
        F.col("line_start").asc_nulls_last(),
        F.col("line_end").asc_nulls_last(),
        rank("source", SOURCES).asc(),
        F.col("rule").asc_nulls_first(),
        F.col("title").asc(),
        F.col("description").asc(),
        F.col("code_snippet").asc_nulls_first(),
        F.col("suggestion").asc_nulls_first(),
    ]


def numbered(findings: DataFrame) -> DataFrame:
    """Adds id, ``PREFIX-001`` by the place among all findings, as its first column; in this order."""
    prefix = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))[F.col("category")]
    return placed(findings.select(*COLUMNS), total_order()).orderBy("place").select(F.format_string("%s-%03d", prefix, F.col("place")).alias("id"), *COLUMNS)


#: Islands of rows that are worked on together.
ISLANDS = 1000


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds island: rows of a key whose lines overlap, one after the other, have the same number; rows of different islands
    never meet. And cell: ISLANDS of them, so that a busy file is many groups."""
    low, high = F.least("line_start", "line_end"), F.greatest("line_start", "line_end")
    order = Window.partitionBy(*keys).orderBy(low, high)
    new = F.when(low <= F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new").withColumn("cell", F.expr(f"island div {ISLANDS}"))


def kept(findings: DataFrame, min_confidence: str = "low", categories: list[str] | None = None) -> DataFrame:
    out = findings.filter(rank("confidence", CONFIDENCES) >= CONFIDENCES.index(min_confidence))
    return out if categories is None else out.filter(F.col("category").isin(categories))


def normal_rule(rule: Column) -> Column:
    """What follows the last dot, letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.substring_index(rule, ".", -1), "[^A-Za-z0-9]", ""))


class _Kept:
    """Kept findings of one source, by lines: which is the first that lines a to z meet?

    A binary tree over the distinct lines that there can be, ordered by their beginnings. A node has the smallest number and the
    largest end of what is kept under it, so that a search leaves out what cannot meet or cannot be earlier.
    """

    def __init__(self, first: list[int], last: list[int]):
        spans = sorted(set(zip(first, last, strict=True)))
        self.at = {s: k for k, s in enumerate(spans)}
        self.begins = [a for a, _ in spans]
        self.leaves = 1 << (len(spans) - 1).bit_length()
        self.numbers: list[list[int]] = [[] for _ in spans]  # of each span, a heap
        self.least = [_NO_NUMBER] * (2 * self.leaves)
        self.end: list[float] = [_NO_END] * (2 * self.leaves)

    def _set(self, k: int, z: int) -> None:
        least, end, at = self.least, self.end, self.leaves + k
        own = self.numbers[k]
        least[at], end[at] = (own[0], z) if own else (_NO_NUMBER, _NO_END)
        while at > 1:
            at >>= 1
            x, y = 2 * at, 2 * at + 1
            n, e = min(least[x], least[y]), max(end[x], end[y])
            if n == least[at] and e == end[at]:
                break
            least[at], end[at] = n, e

    def add(self, n: int, a: int, z: int) -> None:
        k = self.at[a, z]
        heappush(self.numbers[k], n)
        if self.numbers[k][0] == n:
            self._set(k, z)

    def remove(self, n: int, a: int, z: int) -> None:
        """n is the smallest number of its lines, as ``first`` has found it."""
        k = self.at[a, z]
        heappop(self.numbers[k])
        self._set(k, z)

    def first(self, a: int, z: int) -> int | None:
        least, end, leaves = self.least, self.end, self.leaves
        if end[1] < a:
            return None
        most = leaves + bisect_right(self.begins, z)  # leaves from here on begin later
        best, todo = _NO_NUMBER, [(1, leaves, leaves)]
        while todo:
            at, low, size = todo.pop()
            if low >= most or end[at] < a or least[at] >= best:
                continue
            if size == 1:
                best = least[at]
                continue
            x, half = 2 * at, size >> 1
            both = [(x, low, half), (x + 1, low + half, half)]
            todo += both[::-1] if least[x] < least[x + 1] else both  # the smaller number first
        return None if best == _NO_NUMBER else best


_NO_NUMBER, _NO_END = 1 << 62, float("-inf")


def merge_sources(findings: DataFrame) -> DataFrame:
    """Static and model findings of one place become one.

    In total order, a finding joins the first one kept before it that has another source, the same category, file and
    normal rule, and overlapping lines. The static one stays; severity and confidence become the larger, a missing
    snippet or suggestion is filled in. Findings without rule or lines never join.
    """
    can = F.col("rule").isNotNull() & F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    order = F.struct(*([-rank("severity", SEVERITIES), -rank("confidence", CONFIDENCES)] + [c for c in (F.split("file", "/"), F.col("line_start"), F.col("line_end"), rank("source", SOURCES), F.coalesce("rule", F.lit("")), F.col("title"), F.col("description"))] + [F.col("code_snippet").isNotNull(), F.coalesce("code_snippet", F.lit("")), F.col("suggestion").isNotNull(), F.coalesce("suggestion", F.lit(""))]))
    keyed = findings.filter(can).withColumn("norm", normal_rule(F.col("rule")))
    # The order's rank within a group stands in for the whole order.
    keyed = _islands(keyed, ["category", "file", "norm"])
    keyed = keyed.withColumn("place", F.row_number().over(Window.partitionBy("category", "file", "norm", "island").orderBy(order)))

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("island", "ascending"), ("place", "ascending")])
        source, first, last = (group.column(c).to_pylist() for c in ("source", "line_start", "line_end"))
        ranks = {}
        for name, names in (("severity", SEVERITIES), ("confidence", CONFIDENCES)):
            ranks[name] = pc.fill_null(pc.index_in(group.column(name), pa.array(names)), -1).to_pylist()
        there = {name: group.column(name).is_valid().to_pylist() for name in ("code_snippet", "suggestion")}
        # Of each finding that is kept the row that it is, and the rows that its severity, confidence, snippet and suggestion come from.
        base: list[int] = []
        taken: dict[str, list[int]] = {c: [] for c in (*ranks, *there)}
        island, begun, kept_of = group.column("island").to_pylist(), None, {}
        for i, own in enumerate(source):
            if island[i] != begun:
                begun, end = island[i], i + 1
                while end < len(island) and island[end] == begun:
                    end += 1
                kept_of = {s: _Kept(first[i:end], last[i:end]) for s in set(source[i:end])} if len(set(source[i:end])) > 1 else {}
            a, z = first[i], last[i]
            k = min((n for s, kept_ in kept_of.items() if s != own and (n := kept_.first(a, z)) is not None), default=None)
            if k is None:
                k = len(base)
                base.append(i)
                for rows_ in taken.values():
                    rows_.append(i)
                if kept_of:
                    kept_of[own].add(k, a, z)
                continue
            have = base[k]
            stays = source[have] == "static"
            for name, rank_ in ranks.items():
                x, y = taken[name][k], i
                if rank_[x] < rank_[y] or rank_[x] == rank_[y] and not stays:
                    taken[name][k] = y
            for name, has in there.items():
                x, y = (taken[name][k], i) if stays else (i, taken[name][k])
                taken[name][k] = x if has[x] else y
            if not stays:
                kept_of[source[have]].remove(k, first[have], last[have])
                kept_of[own].add(k, a, z)
                base[k] = i
        return pa.table({c: group.column(c).take(pa.array(taken.get(c, base), pa.int64())) for c in COLUMNS})

    merged = keyed.groupBy("category", "file", "norm", "cell").applyInArrow(merge, SCHEMA)
    return merged.unionByName(findings.filter(~F.coalesce(can, F.lit(False))).select(*COLUMNS))


def dedupe_run(findings: DataFrame) -> DataFrame:
    """Findings of one run (with ``ordinal``, the order of submission) without repeats.

    Per file and in order: a finding with a rule goes if it overlaps a kept one of the same rule, or a kept one without
    rule of the same title; one without rule goes if it overlaps a kept one of the same title. Findings without both
    lines stay. Dropped findings cover nothing. Reversed lines are turned round for the comparison.
    """
    has = F.col("line_start").isNotNull() & F.col("line_end").isNotNull()

    def dedupe(group: pd.DataFrame) -> pd.DataFrame:
        keep, by_rule, by_title, bare = [], {}, {}, {}
        for i, rule, title, a, b, island in group.sort_values("ordinal")[["rule", "title", "line_start", "line_end", "island"]].itertuples():
            a, b = min(a, b), max(a, b)
            rule, title = None if pd.isna(rule) else (island, rule), (island, title)
            seen = by_title.get(title, []) if rule is None else by_rule.get(rule, []) + bare.get(title, [])
            if any(x <= b and a <= y for x, y in seen):
                continue
            keep.append(i)
            by_title.setdefault(title, []).append((a, b))
            if rule is None:
                bare.setdefault(title, []).append((a, b))
            else:
                by_rule.setdefault(rule, []).append((a, b))
        return group.loc[keep]

    spans, names = findings.filter(has), findings.columns
    return _islands(spans, ["file"]).groupBy("file", "cell").applyInPandas(lambda g: dedupe(g)[names], spans.schema).unionByName(findings.filter(~has))


def finalize(findings: DataFrame, min_confidence: str = "low", categories: list[str] | None = None) -> DataFrame:
    """Filter, merge sources, order, number. What is left by the filter is written once, so the corpus is read once."""
    return numbered(merge_sources(save(kept(findings, min_confidence, categories), "found")))


def summary(findings: DataFrame) -> DataFrame:
    """(kind, name, n): total, by severity, by category; names that occur only. One pass."""
    sets = findings.groupingSets([[], ["severity"], ["category"]], "severity", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "severity").otherwise("category")
    return sets.select(kind.alias("kind"), F.coalesce("severity", "category", F.lit("all")).alias("name"), "n")


def above(findings: DataFrame, severity: str) -> DataFrame:
    """One row (fails): is any finding at least as severe? False if there is none."""
    return findings.agg(F.coalesce(F.bool_or(rank("severity", SEVERITIES) >= SEVERITIES.index(severity)), F.lit(False)).alias("fails"))


def retained_bytes(numbered: bool = False) -> Column:
    """UTF-8 bytes of a finding's texts; numbered: with its id."""
    out = F.lit(0)
    for c in ["id"] * numbered + ["title", "description", "file", "code_snippet", "suggestion", "rule"]:
        out = out + F.coalesce(F.octet_length(c), F.lit(0))
    return out.cast("long")


#: Static findings of a scan, and their bytes.
MAX_STATIC, MAX_STATIC_BYTES = 10_000, 8 << 20


def sizes(findings: DataFrame) -> list[Column]:
    """Aggregates: n and bytes of findings."""
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(retained_bytes("id" in findings.columns)), F.lit(0)).alias("bytes")]


def check_sizes(got: dict, most: int = MAX_STATIC, most_bytes: int = MAX_STATIC_BYTES) -> None:
    if got["n"] > most or got["bytes"] > most_bytes:
        raise ValueError(f"{got['n']} findings of {got['bytes']} bytes exceed {most} findings and {most_bytes} bytes")


def admit(findings: DataFrame, most: int = MAX_STATIC, most_bytes: int = MAX_STATIC_BYTES) -> DataFrame:
    """The findings, after one count; raises if they are too many or too large together."""
    check_sizes(findings.agg(*sizes(findings)).first().asDict(), most, most_bytes)
    return findings


#: Findings of a submission; bytes of a finding's title, description, snippet, suggestion and rule.
MAX_SUBMISSION = 1000
MAX_FIELDS = {"title": 512, "description": 16 << 10, "code_snippet": 64 << 10, "suggestion": 16 << 10, "rule": 256}


def submitted(findings: DataFrame) -> DataFrame:
    """(submission, n, problem) of ``findings`` with ``submission``: why a submission is rejected as a whole, else null.

    One bad finding rejects all of its submission: an unknown severity, confidence or category, an empty title or
    description, a text that is too long, or lines that are not paired, not from 1, or in the wrong order.
    """
    bad = F.when(~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)), "severity").when(~F.coalesce(F.col("confidence").isin(CONFIDENCES), F.lit(False)), "confidence").when(~F.coalesce(F.col("category").isin(list(CATEGORIES)), F.lit(False)), "category")
    for c in ("title", "description"):
        bad = bad.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{c} is empty")
    for c, most in MAX_FIELDS.items():
        bad = bad.when(F.octet_length(c) > most, f"{c} is too long")
    bad = bad.when(F.col("line_start").isNull() != F.col("line_end").isNull(), "one line only").when((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), "lines")
    per = findings.groupBy("submission").agg(F.count("*").alias("n"), F.min(bad).alias("bad"))
    return per.select("submission", "n", F.when(F.col("n") > MAX_SUBMISSION, "too many findings").otherwise(F.col("bad")).alias("problem"))

"""Syntax trees as a relation, and free syntax queries over it as joins.

``nodes`` gives a row a node (see ``functions.nodetree`` for the kinds and fields there are): its number in document
order, the number of its last descendant, its parent's, kind, field, offsets, lines and, of leaves, text. A query is a text
of patterns, of which this is understood:

* ``(kind)``, ``(_)`` and ``_`` for any node, ``[...]`` for one of several patterns; a comment from ``;`` to the line's end;
* children, in order but not next to each other: ``(kind (kind) field: (kind))``; ``!field``: no child has that field;
* captures: ``@name`` after a pattern;
* predicates, within a pattern or in a bracket around it: ``(#eq? @a "text")`` or ``(#eq? @a @b)``, ``#not-eq?``,
  ``#match?`` and ``#not-match?`` with a regular expression, ``#any-of? @a "x" "y"``, ``#has-ancestor? @a kind``.

Quantifiers, anchors, literal tokens and groups of siblings are not, and are errors, as are kinds and fields that the
language does not have. Each way to find a pattern is a match; a match stands for its first capture, in the order of the
pattern; one without captures is left out.

A match lies within one file, so files are dealt over the tasks and nothing of them is shuffled after that: a task lays the
trees of some files side by side in arrays (``Forest``), and a step of a pattern is a join of nodes with the parents that are
found so far, for all those files at once. Lines of plain calls are read once for all that look the same. What predicates
ask of texts is Spark's.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nodetree
from ..functions.tokens import CALL
from .syntax import LANGUAGES, MAX_MATCH_BYTES, MAX_MATCHES, MAX_MATCHES_BYTES

#: Fixed value: bytes of a query.
MAX_QUERY_BYTES = 16 << 10
#: Patterns that the alternatives of a query may give.
MAX_PATTERNS = 64
_NODE = pa.schema([("id", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("field", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("text", pa.string())])
#: Of a file that does not parse: its only node.
ERROR = "ERROR"
#: Characters of files whose trees are held at once, apart from what the last file has beyond; rows of matches that are
#: made at once, apart from a node's children; characters of a batch of results.
FOREST_CHARS, ROWS, BATCH_CHARS = 1 << 20, 1 << 20, 4 << 20


def _parsed(text: str, language: str, plain: list | None = None) -> list[tuple]:
    try:
        return nodetree.nodes(text, language, plain)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser's stack is a MemoryError
        return [(0, 0, None, ERROR, None, 0, len(text), 1, 1 + text.count("\n"), None)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, language, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            found = _parsed(text, language)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _NODE, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.repeat(path, len(found)), pa.repeat(language, len(found)), *columns], ["relative_path", "language", *_NODE.names])


def nodes(files: DataFrame) -> DataFrame:
    """(relative_path, language, id, last, parent, kind, field, start, end, line_start, line_end, text) of the files in a
    language that has trees."""
    known = files.filter(F.col("language").isin(LANGUAGES) & F.col("content").isNotNull()).select("relative_path", "language", "content")
    return known.mapInArrow(_batches, "relative_path string, language string, id int, last int, parent int, kind string, field string, start int, end int, line_start int, line_end int, text string")


@dataclass(frozen=True)
class Step:
    """A node of a pattern: parent is its place among the steps; kind None is any."""

    kind: str | None
    field: str | None = None
    parent: int = -1
    captures: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    inner: tuple[Step, ...] = ()


@dataclass(frozen=True)
class Pattern:
    """Steps in document order, and predicates: (name, capture, values)."""

    steps: tuple[Step, ...]
    predicates: tuple[tuple[str, str, tuple[str, ...]], ...] = field(default=())

    def place(self, capture: str) -> int:
        return next(i for i, s in enumerate(self.steps) if capture in s.captures)


_TOKEN = re.compile(r'\s+|;[^\n]*|(?P<token>[()\[\]]|"(?:[^"\\]|\\.)*"|@[\w.-]+|#[\w-]+[?!]|![\w-]+|[\w-]+:|[\w-]+|.)', re.S)
_PREDICATES = {"#eq?": 1, "#not-eq?": 1, "#match?": 1, "#not-match?": 1, "#any-of?": None, "#has-ancestor?": None}


class _Reader:
    def __init__(self, query: str):
        self.tokens = [m["token"] for m in _TOKEN.finditer(query) if m["token"]] + ["end"]
        self.at = 0

    @property
    def next(self) -> str:
        return self.tokens[self.at]

    def take(self, *wanted: str) -> str:
        t = self.next
        if wanted and t not in wanted or t == "end" and self.at == len(self.tokens) - 1:
            raise ValueError(f"syntax query: {t!r} at token {self.at + 1}")
        self.at += 1
        return t

    def captures(self) -> tuple[str, ...]:
        found = []
        while self.next.startswith("@"):
            found.append(self.take()[1:])
        return tuple(found)

    def predicate(self) -> tuple[str, str, tuple[str, ...]]:
        name, on, values = self.take(), self.take(), []
        if name not in _PREDICATES or not on.startswith("@"):
            raise ValueError(f"syntax query: predicate {name} {on}")
        while self.next != ")":
            t = self.take()
            values.append(re.sub(r"\\(.)", r"\1", t[1:-1]) if t[0] == '"' and len(t) > 1 else t)
        self.take(")")
        if not values or _PREDICATES[name] not in (None, len(values)):
            raise ValueError(f"syntax query: values of {name}")
        return name, on[1:], tuple(values)

    def pattern(self, predicates: list) -> list[Step]:
        """The alternatives of one pattern, with inner steps."""
        t = self.take()
        if t == "[":
            found: list[Step] = []
            while self.next != "]":
                found += self.pattern(predicates)
            self.take("]")
        elif t == "_":
            found = [Step(None)]
        elif t == "(" and self.next == "(":
            found = self.pattern(predicates)
            while self.next == "(" and self.tokens[self.at + 1].startswith("#"):
                self.take()
                predicates.append(self.predicate())
            self.take(")")
        elif t == "(":
            kind = self.take()
            if not re.fullmatch(r"[\w-]+", kind):
                raise ValueError(f"syntax query: kind {kind!r}")
            found = self.children(Step(None if kind == "_" else kind), predicates)
        else:
            raise ValueError(f"syntax query: {t!r} at token {self.at}")
        more = self.captures()
        return [replace(s, captures=s.captures + more) for s in found]

    def children(self, step: Step, predicates: list) -> list[Step]:
        parts: list[list[Step]] = []
        while self.next != ")":
            if self.next == "(" and self.tokens[self.at + 1].startswith("#"):
                self.take()
                predicates.append(self.predicate())
            elif self.next.startswith("!"):
                step = replace(step, without=(*step.without, self.take()[1:]))
            else:
                name = self.take()[:-1] if re.fullmatch(r"[\w-]+:", self.next) else None
                parts.append([replace(s, field=name) for s in self.pattern(predicates)])
            if len(list(itertools.islice(itertools.product(*parts), MAX_PATTERNS + 1))) > MAX_PATTERNS:
                raise ValueError("syntax query: too many alternatives")
        self.take(")")
        return [replace(step, inner=inner) for inner in itertools.product(*parts)]


def _flat(step: Step, parent: int = -1, at: int = 0) -> Iterator[Step]:
    yield replace(step, parent=parent, inner=())
    n = at + 1
    for s in step.inner:
        own = list(_flat(s, at, n))
        n += len(own)
        yield from own


def parse(query: str, language: str) -> list[Pattern]:
    """The patterns of a query; a ValueError says what is wrong with it."""
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise ValueError(f"syntax query: at most {MAX_QUERY_BYTES} bytes")
    if language not in LANGUAGES:
        raise ValueError(f"no syntax trees for {language}")
    kinds, fields = nodetree.vocabulary(language)
    reader, out = _Reader(query), []
    while reader.at < len(reader.tokens) - 1:
        predicates: list = []
        for step in reader.pattern(predicates):
            p = Pattern(tuple(_flat(step)))
            names = [c for s in p.steps for c in s.captures]
            for s in p.steps:
                if s.kind is not None and s.kind not in kinds or {s.field, *s.without} - {None} - fields:
                    raise ValueError(f"syntax query: {language} has no {s.kind} with {s.field or s.without}")
            for name, on, values in predicates:
                if {on, *(v[1:] for v in values if v.startswith("@"))} - set(names):
                    raise ValueError(f"syntax query: {name} of what is not captured")
                if name == "#has-ancestor?" and set(values) - kinds:
                    raise ValueError(f"syntax query: {language} has no {values}")
            out.append(replace(p, predicates=tuple(predicates)))
        if len(out) > MAX_PATTERNS:
            raise ValueError("syntax query: too many patterns")
    if not out:
        raise ValueError("syntax query: empty")
    return out


class Forest:
    """The nodes of some texts in document order, as arrays: parent (-1: none), kind and field by ``code``, start, end,
    line_start, line_end, and of: the text each belongs to."""

    COLUMNS = ("parent", "kind", "field", "start", "end", "line_start", "line_end")

    def __init__(self, texts: list[str], language: str):
        self._codes: dict[str | None, int] = {None: 0}
        trees, plain, calls, edge = [], [], [], 0
        distinct: dict[str, int] = {}
        for k, text in enumerate(texts):
            lines: list[tuple[int, int, int, int]] = []
            trees.append(_parsed(text, language, lines))
            for at, parent, a, z in lines:
                own = CALL.findall(text, a, z)
                calls += [distinct.setdefault(x, len(distinct)) for x in own]
                plain.append((edge + at, edge + parent, a, text.count("\n", 0, a), len(own), k))
            edge += len(trees[-1])
        sizes = np.array([len(x) for x in trees], np.int64)
        table = self._table([n for t in trees for n in t])
        table[0] += np.where(table[0] >= 0, np.repeat(np.cumsum(sizes) - sizes, sizes), 0)
        of = np.repeat(np.arange(len(texts)), sizes)
        if plain:
            table, of = self._with_calls(table, of, np.array(plain, np.int64).T, np.array(calls), list(distinct), language)
        self.of = of
        self.parent, self.kind, self.field, self.start, self.end, self.line_start, self.line_end = table

    def code(self, name: str | None) -> int:
        return self._codes.setdefault(name, len(self._codes))

    def _table(self, found: list[tuple]) -> np.ndarray:
        """COLUMNS by nodes."""
        if not found:
            return np.zeros((7, 0), np.int64)
        _, _, parent, kind, field_, *places, _ = zip(*found, strict=True)
        return np.array([[-1 if p is None else p for p in parent], list(map(self.code, kind)), list(map(self.code, field_)), *places], np.int64)

    def _with_calls(self, table: np.ndarray, of: np.ndarray, plain: np.ndarray, calls: np.ndarray, distinct: list[str], language: str) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of lines of plain calls put in their places.

        plain: of each stretch of calls the node that it stands before, its parent, offset, lines before it, number of
        calls and text; calls: their numbers in ``distinct``."""
        at, above, offset, line, many, text = plain
        # The nodes of all distinct calls, by their own beginnings.
        chars, breaks = (np.array(x, np.int64) for x in ([len(x) for x in distinct], [x.count("\n") for x in distinct]))
        own = self._table(nodetree.nodes("".join(distinct), language)[1:])
        whose = np.searchsorted(np.cumsum(chars), own[3], "right")
        n = np.bincount(whose, minlength=len(distinct))
        first = np.cumsum(n) - n
        own[0] -= 1 + np.where(own[0] > 0, first[whose], 0)  # -1: around the call
        own[3:5] -= (np.cumsum(chars) - chars)[whose]
        own[5:7] -= (np.cumsum(breaks) - breaks)[whose] + 1
        # Calls: their stretches, offsets, lines and nodes.
        stretch = np.repeat(np.arange(len(many)), many)
        opens = np.cumsum(many) - many
        since = lambda v: (np.cumsum(v) - v) - (np.cumsum(v) - v)[opens][stretch]
        offset, line = offset[stretch] + since(chars[calls]), line[stretch] + since(breaks[calls]) + 1
        count = n[calls]
        before = np.cumsum(count) - count
        added = np.append(before, count.sum())[np.append(opens, len(calls))]  # nodes before each stretch
        place = np.arange(table.shape[1])
        place += added[np.searchsorted(at, place, "right")]
        out = np.empty((7, table.shape[1] + int(count.sum())), np.int64)
        texts = np.empty(out.shape[1], np.int64)
        out[:, place], texts[place] = table, of
        out[0, place] = np.where(table[0] >= 0, place[table[0]], -1)
        call = np.repeat(np.arange(len(calls)), count)
        made = own[:, (first[calls] - before)[call] + np.arange(len(call))]
        begin = at[stretch] + before
        made[0] = np.where(made[0] >= 0, made[0] + begin[call], place[above[stretch]][call])
        made[3:5] += offset[call]
        made[5:7] += line[call]
        there = at[stretch][call] + np.arange(len(call))
        out[:, there], texts[there] = made, text[stretch][call]
        return out, texts

    def below(self, kinds: tuple[str, ...]) -> np.ndarray:
        """Does a node descend from one of these kinds? Known for twice as many generations in each turn."""
        up = self.parent
        found = np.isin(self.kind, [self.code(k) for k in kinds])[up] & (up >= 0)
        while (up >= 0).any():
            found = found | (up >= 0) & found[up]
            up = np.where(up >= 0, up[up], -1)
        return found

    def found(self, pattern: Pattern) -> Iterator[np.ndarray]:
        """Matches in parts: a row a match, with the node of each step."""
        candidates = []
        for i, step in enumerate(pattern.steps):
            ok = self.parent >= 0 if i else np.ones(len(self.parent), bool)
            if step.kind is not None:
                ok &= self.kind == self.code(step.kind)
            if step.field is not None:
                ok &= self.field == self.code(step.field)
            for f in step.without:
                owners = self.parent[self.field == self.code(f)]
                ok[owners[owners >= 0]] = False
            for name, on, values in pattern.predicates:
                if name == "#has-ancestor?" and pattern.place(on) == i:
                    ok &= self.below(values)
            own = np.flatnonzero(ok)
            candidates.append(own[np.argsort(self.parent[own], kind="stable")] if i else own)

        def grow(rows: np.ndarray) -> Iterator[np.ndarray]:
            i = rows.shape[1]
            if i == len(pattern.steps):
                yield rows
                return
            own, parent = candidates[i], pattern.steps[i].parent
            above, sought = self.parent[own], rows[:, parent]
            low = np.searchsorted(above, sought, "left")
            n = np.searchsorted(above, sought, "right") - low
            ends, a = np.cumsum(n), 0
            while a < len(rows):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROWS, "right")))
                row = np.repeat(np.arange(a, z), n[a:z])
                child = own[np.repeat(low[a:z] - (ends[a:z] - n[a:z] - (ends[a - 1] if a else 0)), n[a:z]) + np.arange(len(row))]
                ok = np.ones(len(row), bool)
                for k in (k for k in range(i) if pattern.steps[k].parent == parent):
                    ok &= child > rows[row, k]
                if ok.any():
                    yield from grow(np.column_stack([rows[row[ok]], child[ok]]))
                a = z

        return grow(candidates[0][:, None])


def _asked(pattern: Pattern) -> list[str]:
    """The captures whose texts the predicates ask for."""
    return list(dict.fromkeys(x for name, on, values in pattern.predicates if name != "#has-ancestor?" for x in (on, *(v[1:] for v in values if v.startswith("@")))))


def _holds(pattern: Pattern) -> Column:
    """Do the predicates on texts hold? Column texts: of ``_asked``."""
    text = lambda capture: F.col("texts")[_asked(pattern).index(capture)]
    out = F.lit(True)
    for name, on, values in pattern.predicates:
        if name == "#has-ancestor?":
            continue
        against = [text(v[1:]) if v.startswith("@") else F.lit(v) for v in values]
        if name == "#any-of?":
            holds = F.array_contains(F.array(*against), text(on))
        elif "match" in name:
            holds = F.regexp(text(on), against[0])
        else:
            holds = text(on) == against[0]
        out = out & (~holds if name.startswith("#not-") else holds)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    """Paths and texts of about FOREST_CHARS."""
    paths, texts, size = [], [], 0
    for b in batches:
        for path, text in zip(b.column(0), b.column(1), strict=True):  # one text at a time
            paths.append(path.as_py())
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= FOREST_CHARS:
                yield paths, texts
                paths, texts, size = [], [], 0
    if texts:
        yield paths, texts


def matches(files: DataFrame, patterns: list[Pattern], language: str, code: bool) -> DataFrame:
    """(relative_path, pattern, line_start, line_end) of every match in ``files`` (relative_path, content), all of one
    language: its first capture; with its text, matched_code, or else with start, end, and path, the numbers of all its nodes."""
    kept = [(k, p) for k, p in enumerate(patterns) if any(s.captures for s in p.steps)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, texts in _groups(batches):
            f, names = Forest(texts, language), pa.array(paths, pa.string())
            for k, p in kept:
                first = next(i for i, s in enumerate(p.steps) if s.captures)
                cut = [p.place(c) for c in _asked(p)]
                for rows in f.found(p):
                    size = np.cumsum(sum((f.end[rows[:, i]] - f.start[rows[:, i]] for i in (*cut, first)), np.full(len(rows), 64)))
                    a = 0
                    while a < len(rows):
                        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BATCH_CHARS, "right")))
                        some, a = rows[a:z], z
                        own = some[:, first]
                        of = f.of[own]
                        text = lambda v, of=of.tolist(): [texts[k][x:y] for k, x, y in zip(of, f.start[v].tolist(), f.end[v].tolist(), strict=True)]  # noqa: B023, E731
                        asked = pa.nulls(len(own), pa.list_(pa.string()))
                        if cut:
                            flat = [x for row in zip(*(text(some[:, i]) for i in cut), strict=True) for x in row]
                            asked = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(cut)), pa.array(flat, pa.string()))
                        more = [pa.array(text(own), pa.string())]
                        if not code:
                            more = [pa.array(f.start[own].astype(np.int32)), pa.array(f.end[own].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * some.shape[1]), pa.array(some.reshape(-1).astype(np.int32)))]
                        lines = [pa.array(v[own].astype(np.int32)) for v in (f.line_start, f.line_end)]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.repeat(pa.scalar(k, pa.int32()), len(own)), *lines, *more, asked], columns)

    more = ["matched_code string"] if code else ["start int", "end int", "path array<int>"]
    schema = ["relative_path string", "pattern int", "line_start int", "line_end int", *more, "texts array<string>"]
    columns = [c.split()[0] for c in schema]
    found = files.filter(F.col("content").isNotNull()).select("relative_path", "content").mapInArrow(run, ", ".join(schema))
    holds = F.lit(True)
    for k, p in kept:
        if _asked(p):
            holds = F.when(F.col("pattern") == k, _holds(p)).otherwise(holds)
    return found.filter(holds).drop("texts")


def search_corpus(files: DataFrame, query: str, language: str) -> DataFrame:
    """(relative_path, line_start, line_end, matched_code) of all matches in the files of one language that parse.

    Files are dealt evenly over the cluster first: a small table of keys may make a large corpus."""
    patterns = parse(query, language)
    own = files.filter((F.col("language") == language) & F.col("content").isNotNull()).select("relative_path", "content")
    dealt = own.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "relative_path")
    return matches(dealt, patterns, language, True).select("relative_path", "line_start", "line_end", "matched_code")


def search_ast(files: DataFrame, path: str, query: str, max_results: int = MAX_MATCHES) -> DataFrame:
    """(relative_path, line_start, line_end, matched_code, language) of the first matches in one file, in document order.

    A file without trees, one that does not parse, and a match or matches beyond their size are errors."""
    if not 1 <= max_results <= MAX_MATCHES:
        raise ValueError(f"max_results: 1 to {MAX_MATCHES}")
    one = files.filter(F.col("relative_path") == path)
    known = one.select("language").first()
    if known is None:
        raise ValueError(f"{path}: no such file")
    patterns = parse(query, known["language"])
    if not nodes(one).filter(F.col("kind") == ERROR).isEmpty():
        raise ValueError(f"{path}: does not parse")
    order = ["start", F.desc("end"), "pattern", "path"]
    found = matches(one, patterns, known["language"], False).orderBy(*order).limit(max_results)
    code = found.join(one.select("relative_path", "content"), "relative_path").withColumn("code", F.substring("content", F.col("start") + 1, F.col("end") - F.col("start"))).drop("content")
    size = F.octet_length("code")
    total = F.sum(size).over(Window.partitionBy("relative_path"))  # of one file, and at most max_results rows
    checked = F.when(size > MAX_MATCH_BYTES, F.raise_error(F.lit("a match is too large"))).when(total > MAX_MATCHES_BYTES, F.raise_error(F.lit("the matches are too large"))).otherwise(F.col("code"))
    return code.withColumn("matched_code", checked).orderBy(*order).select("relative_path", "line_start", "line_end", "matched_code", F.lit(known["language"]).alias("language"))

"""The six calls over a corpus: arguments are checked before anything runs, output is bounded, what was read is recorded."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import corpus, coverage, findings, nodes, search, stats
from ..operators.corpus import DiscoverOptions, Exclusions

#: Bytes of a call's output; values of a filter and bytes of one; bytes of a file's pattern, a path, a
#: language; depth of folders; lines around a match by default.
MAX_OUTPUT, MAX_FILTERS, MAX_FILTER_BYTES = 2 << 20, 32, 32
MAX_FILE_PATTERN, MAX_PATH, MAX_LANGUAGE, MAX_DEPTH, CONTEXT = 256, 4096, 32, 256, 3


class CallError(ValueError):
    """A call that is refused; the text says why."""


def text(most: int) -> Callable:
    def check(name: str, value):
        if not isinstance(value, str) or not value.strip():
            raise CallError(f"{name}: a text that is not empty")
        if len(value.encode("utf-8", "surrogatepass")) > most:
            raise CallError(f"{name}: at most {most} bytes")
        return value

    return check


def whole(least: int, most: int) -> Callable:
    def check(name: str, value):
        if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
            raise CallError(f"{name}: a whole number from {least} to {most}")
        return value

    return check


def flag(name: str, value):
    if not isinstance(value, bool):
        raise CallError(f"{name}: true or false")
    return value


def filters(name: str, value):
    if not isinstance(value, list) or len(value) > MAX_FILTERS:
        raise CallError(f"{name}: at most {MAX_FILTERS} values")
    return [text(MAX_FILTER_BYTES)(name, v) for v in value]


def submission(name: str, value):
    if not isinstance(value, list) or len(value) > findings.MAX_SUBMISSION:
        raise CallError(f"{name}: at most {findings.MAX_SUBMISSION} findings")
    return [_arguments(_FINDING, v, f"finding {k + 1}") for k, v in enumerate(value)]


def _text(name: str, value):
    if not isinstance(value, str):
        raise CallError(f"{name}: a text")
    return value


_LINE = whole(1, (1 << 32) - 1)
#: Of each call its arguments: how they are checked, and whether they are required.
SHAPES: dict[str, dict[str, tuple[Callable, bool]]] = {
    "discover_files": {"extensions": (filters, False), "pattern": (text(MAX_FILE_PATTERN), False), "max_depth": (whole(1, MAX_DEPTH), False), "max_results": (whole(1, search.MAX_RESULTS), False)},
    "search_text": {"pattern": (text(search.MAX_PATTERN_BYTES), True), "case_sensitive": (flag, False), "file_extensions": (filters, False), "max_results": (whole(1, search.MAX_RESULTS), False), "context_lines": (whole(0, search.MAX_CONTEXT), False)},
    "read_file": {"path": (text(MAX_PATH), True), "start_line": (_LINE, False), "end_line": (_LINE, False)},
    "project_stats": {},
    "search_ast": {"path": (text(MAX_PATH), True), "query": (text(nodes.MAX_QUERY_BYTES), True), "language": (text(MAX_LANGUAGE), True)},
    "submit_findings": {"findings": (submission, True)},
}
_FINDING = {c: (_text, c in ("category", "severity", "title", "description", "file")) for c in findings.COLUMNS if c not in ("source", "line_start", "line_end")} | {"line_start": (_LINE, False), "line_end": (_LINE, False)}


def _arguments(shape: dict, given, what: str) -> dict:
    if not isinstance(given, dict):
        raise CallError(f"{what}: an object")
    if unknown := sorted(set(given) - set(shape)):
        raise CallError(f"{what}: unknown field {unknown[0]}")
    out = {}
    for name, (check, required) in shape.items():
        if given.get(name) is not None:
            out[name] = check(name, given[name])
        elif required:
            raise CallError(f"{what}: {name} is missing")
    return out


@dataclass
class Calls:
    """Calls over ``files`` (relative_path, content, size_bytes, language), which ``rules`` may exclude.

    allowed: (relative_path), all that may be listed and read; hunks: (path, start, end), what findings have to touch. read:
    the paths that ``read_file`` has given; accepted: the findings of all submissions.
    """

    files: DataFrame
    allowed: DataFrame | None = None
    hunks: DataFrame | None = None
    rules: Exclusions = Exclusions()
    read: list[str] = field(default_factory=list)
    accepted: list[DataFrame] = field(default_factory=list)

    def call(self, name: str, arguments: dict | str) -> str:
        """The output as JSON text; a CallError if the arguments, or the output's size, are not allowed."""
        if name not in SHAPES:
            raise CallError(f"no call {name}")
        try:
            given = json.loads(arguments) if isinstance(arguments, str) else arguments
        except ValueError as e:
            raise CallError(f"{name}: {e}") from None
        return getattr(self, f"_{name}")(**_arguments(SHAPES[name], given, name))

    def coverage(self) -> DataFrame:
        """(path) of the files that were read, each once."""
        return self.files.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(self.read)], "path string")

    def _shown(self, rows: DataFrame) -> list[dict]:
        """At most MAX_RESULTS rows, after their size is known."""
        size = rows.select(F.to_json(F.struct("*")).alias("j")).agg(F.coalesce(F.sum(F.octet_length("j")), F.lit(0))).first()[0]
        if size > MAX_OUTPUT:
            raise CallError(f"the output exceeds {MAX_OUTPUT} bytes")
        return [r.asDict(True) for r in rows.collect()]

    @staticmethod
    def _written(value) -> str:
        out = json.dumps(value, indent=2, ensure_ascii=False)
        if len(out.encode()) > MAX_OUTPUT:
            raise CallError(f"the output exceeds {MAX_OUTPUT} bytes")
        return out

    def _discover_files(self, extensions=None, pattern=None, max_depth=None, max_results=search.MAX_RESULTS) -> str:
        listed = corpus.discover(corpus.select_files(corpus.admitted(self.files, self.rules), self.allowed), DiscoverOptions(extensions, pattern, max_depth, max_results))
        return self._written(self._shown(listed))

    def _search_text(self, pattern, case_sensitive=False, file_extensions=None, max_results=None, context_lines=CONTEXT) -> str:
        options = {"max_results": max_results} if max_results else {}
        found = search.search_scoped(corpus.admitted(self.files, self.rules), pattern, self.allowed, case_sensitive=case_sensitive, extensions=file_extensions, context=context_lines, **options)
        return self._written(self._shown(found))

    def _path(self, path: str) -> str:
        """The normal form of a path that may be read."""
        spark = self.files.sparkSession
        normal, error = paths.normalized(F.lit(path))
        flags = corpus.exclusion_flags(F.col("normal"), self.rules)
        row = spark.range(1).select(normal.alias("normal"), error.alias("error")).withColumn("excluded", flags["protected"] | flags["directory"] | flags["ending"] | flags["sensitive"]).first()
        if row.error is not None:
            raise CallError(f"{path}: {row.error}")
        if self.allowed is not None and self.allowed.filter(F.col("relative_path") == row.normal).isEmpty():
            raise CallError(f"{path}: outside the scope")
        if row.excluded:
            raise CallError(f"{path}: excluded")
        return row.normal

    def _read_file(self, path, start_line=None, end_line=None) -> str:
        own = self._path(path)
        try:
            rows = corpus.read_file(self.files, own, start_line, end_line, self.rules)
        except ValueError as e:
            raise CallError(f"{path}: {e}") from None
        found = self._shown(rows)
        if not found:
            raise CallError(f"{path}: no such file")
        out = self._written(found[0])
        self.read.append(own)
        return out

    def _project_stats(self) -> str:
        counts = stats.line_counts(corpus.admitted(self.files, self.rules))
        return self._written({"languages": self._shown(stats.by_language(counts)), **stats.totals(counts).first().asDict()})

    def _search_ast(self, path, query, language) -> str:
        own = self._path(path)
        try:
            rows = nodes.search_ast(self.files.filter(F.col("relative_path") == own).withColumn("language", F.lit(language)), own, query)
        except ValueError as e:
            raise CallError(str(e)) from None
        return self._written(self._shown(rows))

    def _submit_findings(self, **submitted) -> str:
        given = submitted["findings"]
        if not given:
            return "Accepted 0 findings."
        spark = self.files.sparkSession
        for f in given:
            text(MAX_PATH)("file", f["file"])
            f["file"] = self._path(f["file"])
        rows = [tuple({"confidence": "medium", "source": "ai"}.get(c) if f.get(c) is None else f[c] for c in findings.COLUMNS) for f in given]
        frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in findings.SCHEMA), "k long"]))
        problem = findings.submitted(frame.withColumn("submission", F.lit(0))).first()
        if problem is not None and problem.problem is not None:
            raise CallError(f"submit_findings: {problem.problem}")
        told = F.col("code_snippet").isNotNull() | F.col("line_start").isNotNull()
        checked = coverage.evidence(frame, self.files.join(F.broadcast(frame.select(F.col("file").alias("relative_path")).distinct()), "relative_path", "left_semi"))
        needs = told | F.lit(self.hunks is not None) | (F.col("problem") == "no such file")
        bad = checked.filter(F.col("problem").isNotNull() & needs).orderBy("k").first()
        if bad is not None:
            raise CallError(f"finding {bad.k + 1}: {bad.file}: {bad.problem}")
        if self.hunks is not None:
            outside = checked.join(coverage.overlapping(checked, self.hunks).select("k"), "k", "left_anti").orderBy("k").first()
            if outside is not None:
                raise CallError(f"finding {outside.k + 1}: {outside.file}: touches no changed line")
        self.accepted.append(checked.select(*findings.COLUMNS))
        return f"Accepted {len(given)} findings."

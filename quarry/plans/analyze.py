"""Whole analyses: corpus in, numbered findings and coverage out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import corpus, coverage, detectors, diff, findings, syntax
from ..sources import archives, directory
from ..sources.tables import save


@dataclass(frozen=True)
class Config:
    """Categories, the least confidence that is reported, the severity that fails a run, and the detectors' limits."""

    categories: list[str] = field(default_factory=lambda: ["bug", "quality", "solid", "vulnerability"])
    min_confidence: str = "low"
    fail_severity: str = "high"
    max_file_lines: int = 500
    max_function_lines: int = 50

    def __post_init__(self):
        if not self.categories or set(self.categories) - set(findings.CATEGORIES):
            raise ValueError("categories")
        if self.min_confidence not in findings.CONFIDENCES or self.fail_severity not in findings.SEVERITIES:
            raise ValueError("confidence or severity")
        if self.max_file_lines < 1 or self.max_function_lines < 1:
            raise ValueError("limits")


@dataclass(frozen=True)
class Result:
    findings: DataFrame
    summary: DataFrame
    fails: DataFrame
    scan: DataFrame


def analyze(files: DataFrame, config: Config = Config(), model_findings: DataFrame | None = None, unreadable: DataFrame | None = None, rules: corpus.Exclusions | None = corpus.Exclusions()) -> Result:
    """Static detectors over ``files``, with a model's findings if given, finalized.

    Files that ``rules`` exclude are left out; a walk has done that already. Each file is read and parsed once, while the
    inventory is written; findings are counted in the job that writes them, and too many fail the scan. unreadable:
    (relative_path, reason) of entries that the walk could not read.
    """
    inventory = files if rules is None else corpus.admitted(files, rules)
    quality = "quality" in config.categories
    inventory = save(syntax.with_scan(inventory) if quality else inventory, "inventory")
    found, counts = detectors.static_findings(inventory, config.categories, config.max_file_lines, config.max_function_lines), Observation("static")
    found = save(found.observe(counts, *findings.sizes(found)), "static")
    findings.check_sizes(counts.get)
    if model_findings is not None:
        found = found.unionByName(model_findings.select(*findings.COLUMNS))
    final = save(findings.finalize(found, config.min_confidence, config.categories), "final")
    failed = inventory.filter("not scanned.parsed") if quality else inventory.limit(0)
    unparsed = failed.select("relative_path", F.lit("parse failure").alias("reason"))
    return Result(final, findings.summary(final), findings.above(final, config.fail_severity), coverage.scan_status(inventory, unparsed, unreadable=unreadable))


def analyze_tree(spark, root: str, config: Config = Config(), max_file_bytes: int = corpus.MAX_FILE_BYTES, excludes: str | None = None) -> Result:
    """``analyze`` of a directory tree, under its own ignore rules and the default exclusions."""
    files, unreadable = directory.read_directory(spark, root, max_file_bytes, excludes=excludes)
    return analyze(files, config, unreadable=unreadable, rules=None)


def _scoped(whole: Result, hunks: DataFrame, config: Config) -> Result:
    final = findings.numbered(coverage.overlapping(whole.findings, hunks))
    return Result(final, findings.summary(final), findings.above(final, config.fail_severity), whole.scan)


def analyze_review(files: DataFrame, hunks: DataFrame, config: Config = Config(), model_findings: DataFrame | None = None) -> Result:
    """The same for changed files only; findings have to overlap changed lines."""
    changed = corpus.select_files(files, hunks.select(F.col("path").alias("relative_path")))
    return _scoped(analyze(changed, config, model_findings), hunks, config)


def review_tree(spark, root: str, diff_text: str, config: Config = Config()) -> Result:
    """A review of the tree that a diff leads to. It is not trusted: its own ignore files decide nothing."""
    hunks = diff.hunks(spark.createDataFrame([(0, diff_text)], "diff_id long, diff string")).filter("path is not null and start is not null").select("path", "start", "end")
    files, unreadable = directory.read_directory(spark, root, ignore_files=False)
    changed = corpus.select_files(files, hunks.select(F.col("path").alias("relative_path")))
    return _scoped(analyze(changed, config, unreadable=unreadable, rules=None), hunks, config)


def review_archive(spark, archive: str, diff_text: str, config: Config = Config()) -> Result:
    """A review of a zip archive's tree by a local diff. A refused archive is an error; files that hold no text are left out."""
    unpacked, refused = archives.unpack(spark, [archive])
    problem = refused.orderBy("name", "problem").first()
    if problem is not None:
        raise ValueError(f"{archive}: {problem['name']}: {problem['problem']}")
    hunks = diff.hunks(spark.createDataFrame([(0, diff_text)], "diff_id long, diff string"))
    error = hunks.filter("error is not null").first()
    if error is not None:
        raise ValueError(error["error"])
    text = unpacked.filter(~F.contains(F.substring("content", 1, 8192), F.lit(bytearray(b"\0")))).select("relative_path", F.expr("make_valid_utf8(cast(content as string))").alias("content"))
    return analyze_review(corpus.with_language(text), hunks.filter("start is not null").select("path", "start", "end"), config)

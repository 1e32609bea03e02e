"""Reports: JSON and Markdown made from findings by Spark, written from the driver. A report is of limited size."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_fence, markdown_block, markdown_code, markdown_inline
from ..sources.tables import save

MAX_REPORT = 256 << 20


def json_report(findings: DataFrame, version: str, project: str, mode: str, scan: dict, analyzed_at: str) -> str:
    """One document with a summary; fails rather than cuts when it is too large, before anything is collected."""
    findings = save(findings, "report")
    size = findings.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    if size > MAX_REPORT:
        raise ValueError("report too large")
    rows = [r.asDict() for r in findings.collect()]
    count = lambda c: {k: sum(r[c] == k for r in rows) for k in sorted({r[c] for r in rows})}
    doc = {"version": version, "project": project, "analyzed_at": analyzed_at, "mode": mode, "summary": {"total": len(rows), "by_severity": count("severity"), "by_category": count("category")}, "scan": scan, "findings": rows}
    text = json.dumps(doc, indent=2, ensure_ascii=False)
    if len(text.encode()) > MAX_REPORT:
        raise ValueError("report too large")
    return text


def markdown(findings: DataFrame) -> DataFrame:
    """(id, text): a section for each numbered finding."""
    label = lambda name, c: F.concat(F.lit(f"**{name}:** "), c, F.lit("\n"))
    given = lambda c, text: F.when(F.col(c).isNotNull(), text).otherwise("")
    code = markdown_code("code_snippet")
    fence = code_fence(code)
    snippet = F.concat(F.lit("**Code:**\n\n"), fence, F.lit("\n"), code, F.when(F.endswith(code, F.lit("\n")), "").otherwise("\n"), fence, F.lit("\n\n"))
    lines = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), label("Lines", F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string")))).otherwise("")
    return findings.select(
        "id",
        F.concat(
            F.concat(F.lit("## ["), "severity", F.lit("] "), markdown_inline("title"), F.lit("\n\n")),
            *(label(n, c) for n, c in (("ID", markdown_inline("id")), ("Category", F.col("category")), ("Confidence", F.col("confidence")), ("Source", F.col("source")), ("File", markdown_inline("file")))),
            lines,
            given("rule", label("Rule", markdown_inline("rule"))),
            F.concat(F.lit("\n"), markdown_block("description"), F.lit("\n\n")),
            given("code_snippet", snippet),
            given("suggestion", F.concat(F.lit("**Suggestion:** "), markdown_block("suggestion"), F.lit("\n\n"))),
            F.lit("---\n\n"),
        ).alias("text"),
    )


def markdown_report(findings: DataFrame, scan: DataFrame, skipped: DataFrame, uninspected: DataFrame, title: str = "Analysis report") -> str:
    """The whole report: a head, the findings in the order of their numbers, and what was covered.

    scan: one row (presented, inspected, skipped, complete); skipped: (relative_path, reason); uninspected: (path). Its size
    is known before anything is collected.
    """
    number = F.substring_index("id", "-", -1).cast("long")
    sections = save(markdown(findings).select(number.alias("place"), "text"), "sections")
    entries = save(skipped.select(F.lit("Files never presented").alias("label"), markdown_inline(F.concat("relative_path", F.lit(" ("), "reason", F.lit(")"))).alias("entry")).union(uninspected.select(F.lit("Files presented but not inspected"), markdown_inline("path"))), "entries")
    n, size = sections.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if size + (entries.agg(F.sum(F.octet_length("entry") + 3)).first()[0] or 0) > MAX_REPORT:
        raise ValueError("report too large")
    out = [f"# {title}\n\n**Findings:** {n}\n\n"] + ([] if n else ["No issues found.\n\n"]) + [r["text"] for r in sections.orderBy("place").collect()]
    status = scan.first()
    out.append(f"## Coverage\n\n**Completeness:** {'complete' if status['complete'] else 'partial'}\n**Files inspected:** {status['inspected']}/{status['presented']}\n")
    listed = [r.asDict() for r in entries.orderBy("label", "entry").collect()]
    for label in ("Files never presented", "Files presented but not inspected"):
        own = [r["entry"] for r in listed if r["label"] == label]
        if own:
            out.append(f"\n**{label}:** {len(own)}\n\n" + "".join(f"- {e}\n" for e in own))
    return "".join(out)


def write_atomically(path: str, text: str) -> None:
    """The file appears whole or not at all."""
    fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


#: Exit codes of runs that could not be finished.
ERRORS = {"configuration": 2, "model": 3, "project": 4, "cancelled": 130}


def exit_code(complete: bool, fails: bool, error: str | None = None) -> int:
    """An error's own code; else a partial scan (5) goes before findings (1) and success (0)."""
    return ERRORS[error] if error else 5 if not complete else 1 if fails else 0


def root_cause(error: BaseException) -> str:
    """The message of the error that all others on the way were raised from."""
    seen = set()
    while id(error) not in seen and (source := error.__cause__ or (None if error.__suppress_context__ else error.__context__)) is not None:
        seen.add(id(error))
        error = source
    return str(error)

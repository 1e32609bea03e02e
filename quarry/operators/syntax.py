"""Signatures of functions and types: by tokens for languages with braces, by Python's own parser for Python.

No grammar library is at hand, so this is an approximation: a file is read once into tokens, every opening bracket gets its
end from a stack, and declarations are told by the tokens around their names (``functions.declarations``). Python is
parsed; of a file that does not parse ``parsed`` is false, ``found`` is null and ``problem`` says why, so that it is told
from a file without signatures. Any other failure is an error. A declaration whose block has no end is none.

Not found, as no pattern asks for them: classes and methods of C++ (its functions and structs are), functions of C that
return pointers, arrow functions and generators, abstract classes, targets of ``impl`` with type parameters, enums outside
Rust, interfaces outside Java and TypeScript.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.declarations import FINDERS, declarations
from ..functions.text import line_slice, lines, trim, truncate_marked
from ..functions.tokens import Tokens

#: Languages with signatures; languages that are known but have none.
LANGUAGES, BARE = [*FINDERS, "python"], ["yaml", "json"]
#: Bytes of a shown line; matches of a query, bytes of one, of all.
MAX_LINE_BYTES = 4 << 10
MAX_MATCHES, MAX_MATCH_BYTES, MAX_MATCHES_BYTES = 1_000, 64 << 10, 2 << 20

def _python(text: str) -> list[tuple]:
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return sorted((n.lineno, n.end_lineno, kinds[type(n)], n.name) for n in ast.walk(ast.parse(text)) if type(n) in kinds)


def _scan(text: str, language: str) -> list[tuple]:
    t = Tokens(text, language, brief=True)
    return [(t.line(t.at[a]), t.line(t.ends[z] - 1), kind, name) for a, z, kind, name, _ in declarations(t)]


def _found(text: str, language: str) -> tuple[list[tuple] | None, str | None]:
    """(line_start, line_end, kind, name) of a text, and null; of one that does not parse null, and why."""
    if language != "python":  # every text has tokens
        return _scan(text, language), None
    try:
        return _python(text), None
    except SyntaxError as e:
        return None, "does not parse" if e.lineno is None else f"does not parse: line {e.lineno}"
    except (ValueError, RecursionError, MemoryError) as e:  # null bytes in older versions; the parser's stack is a MemoryError
        return None, f"does not parse: {type(e).__name__}"


def scan(text: str, language: str) -> dict:
    found, problem = _found(text, language)
    rows = None if found is None else [dict(zip(("line_start", "line_end", "kind", "name"), x, strict=True)) for x in found]
    return {"parsed": problem is None, "found": rows, "problem": problem}


FOUND = T.ArrayType(T.StructType([T.StructField("line_start", T.LongType()), T.StructField("line_end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())]))


@F.arrow_udf(T.StructType([T.StructField("parsed", T.BooleanType()), T.StructField("found", FOUND), T.StructField("problem", T.StringType())]))
def _signatures(text: pa.Array, language: pa.Array) -> pa.Array:
    parsed, problems, ends, rows = [], [], [0], []
    for t, x in zip(text, language.to_pylist(), strict=True):  # one text at a time
        found, problem = (None, None) if (t := t.as_py()) is None else _found(t, x)
        parsed.append(None if t is None else problem is None)
        problems.append(problem)
        rows += found or ()
        ends.append(len(rows))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    item = pa.StructArray.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.string()) for k, c in enumerate(columns)], ["line_start", "line_end", "kind", "name"])
    missing = pa.array([not p for p in parsed], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(parsed, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item, mask=missing), pa.array(problems, pa.string())], ["parsed", "found", "problem"])


def with_scan(files: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds ``scanned`` (parsed, found, problem), nulls for languages without signatures and what is not wanted: their texts stay in the JVM."""
    known = F.col("language").isin(LANGUAGES)
    return files.withColumn("scanned", _signatures(F.when(known if wanted is None else known & wanted, F.col("content")), "language"))


def scanned(files: DataFrame) -> DataFrame:
    """(relative_path, language, parsed, found, problem) of files in a language with signatures."""
    rows = files.filter(F.col("language").isin(LANGUAGES)).select("relative_path", "language", _signatures("content", "language").alias("s"))
    return rows.select("relative_path", "language", "s.*")


def _each(found: str, problem: str) -> Column:
    """A row a signature; one null for a file that could not be read, which is told so from one without signatures."""
    return F.explode(F.when(F.col(problem).isNull(), F.col(found)).otherwise(F.array(F.lit(None).cast(FOUND.elementType))))


def signature_lines(files: DataFrame) -> DataFrame:
    """(relative_path, line_start, kind, name, text, problem): signatures with the trimmed line that each begins on, cut at
    4 KiB. A file that does not parse is one row with its problem and nulls."""
    rows = with_scan(files.filter(F.col("language").isin(LANGUAGES))).select("relative_path", lines("content").alias("all"), _each("scanned.found", "scanned.problem").alias("f"), "scanned.problem")
    text = truncate_marked(trim(F.element_at("all", F.col("f.line_start").cast("int"))), MAX_LINE_BYTES)
    return rows.select("relative_path", "f.line_start", "f.kind", "f.name", text.alias("text"), "problem")


def signatures(files: DataFrame) -> DataFrame:
    """(relative_path, language, line_start, line_end, kind, name, problem). A file that does not parse is one row with its
    problem and nulls."""
    return scanned(files).select("relative_path", "language", _each("found", "problem").alias("f"), "problem").select("relative_path", "language", "f.*", "problem")


def search_nodes(files: DataFrame, path: str, kind: str | None = None, name: str | None = None, max_results: int = MAX_MATCHES) -> DataFrame:
    """(relative_path, language, line_start, line_end, kind, name, code): declarations of one file in document order, with
    their source: the documented part of a free syntax query. A file that does not parse is an error, as is a match or are all
    matches beyond their size."""
    if not 1 <= max_results <= MAX_MATCHES:
        raise ValueError(f"max_results: 1 to {MAX_MATCHES}")
    one = files.filter((F.col("relative_path") == path) & F.col("language").isin(LANGUAGES))
    parsed = F.when(F.col("scanned.problem").isNull(), F.col("scanned.found")).otherwise(F.raise_error(F.concat_ws(" ", "relative_path", "scanned.problem")))
    found = with_scan(one).select("relative_path", "language", "content", F.explode(parsed).alias("f")).select("relative_path", "language", "content", "f.*")
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    if name is not None:
        found = found.filter(F.col("name").rlike(name))
    found = found.orderBy("line_start", "line_end", "name").limit(max_results)
    code = found.withColumn("code", line_slice("content", F.col("line_start").cast("int"), F.col("line_end").cast("int"))).drop("content")
    size = F.octet_length("code")
    total = F.sum(size).over(Window.partitionBy("relative_path"))  # of one file, and at most max_results rows
    checked = F.when(size > MAX_MATCH_BYTES, F.raise_error(F.lit("a match is too large"))).when(total > MAX_MATCHES_BYTES, F.raise_error(F.lit("the matches are too large"))).otherwise(F.col("code"))
    return code.withColumn("code", checked).orderBy("line_start", "line_end", "name")

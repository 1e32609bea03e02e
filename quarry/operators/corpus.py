"""The corpus relation: relative_path, content, size_bytes, language; its views, filters, counts and limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import languages, paths
from ..functions.text import line_count, lines

# Directories, extensions and names that are left out by default; directories that always are.
EXCLUDED_DIRS = [
    ".git", ".svn", ".hg", ".aws", ".ssh", ".gnupg", "node_modules", ".next", ".nuxt", ".output", "bower_components", "target",
    "__pycache__", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages", ".eggs",
    "vendor", ".gradle", ".m2", "obj", "packages", "dist", "build", "out", ".cache", "coverage", ".nyc_output", ".idea",
    ".vscode", ".vs", ".eclipse", ".docker", ".terraform",
]
EXCLUDED_EXTENSIONS = [
    "lock", "map", "wasm", "pyc", "pyo", "class", "o", "so", "dylib", "dll", "exe", "a", "lib", "jar", "war", "ear", "zip",
    "tar", "gz", "png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "pdf", "db", "sqlite",
    "sqlite3",
]
EXCLUDED_SUFFIXES = [".min.js", ".min.css", ".bundle.js"]
SENSITIVE_NAMES = [
    ".env", ".envrc", ".git-credentials", ".netrc", ".npmrc", ".pypirc", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa",
]
PROTECTED_DIRS = [
    ".git", ".aws", ".ssh", ".gnupg",
]
#: Limits of one walk: files, their bytes, bytes of one; visited entries, messages and their bytes, bytes of paths.
MAX_FILES, MAX_SOURCE_BYTES, MAX_FILE_BYTES = 100_000, 4 << 30, 1 << 20
MAX_VISITED, MAX_MESSAGES, MAX_MESSAGE_BYTES, MAX_PATH_BYTES = 1_000_000, 10_000, 16 << 20, 32 << 20


@dataclass(frozen=True)
class Exclusions:
    dirs: list[str] = field(default_factory=lambda: list(EXCLUDED_DIRS))
    extensions: list[str] = field(default_factory=lambda: list(EXCLUDED_EXTENSIONS))
    suffixes: list[str] = field(default_factory=lambda: list(EXCLUDED_SUFFIXES))


@dataclass(frozen=True)
class DiscoverOptions:
    """extensions: exact, case matters. pattern: part of the file name. max_depth: components. max_results: after sorting."""

    extensions: list[str] | None = None
    pattern: str | None = None
    max_depth: int | None = None
    max_results: int | None = None


def from_documents(docs: DataFrame) -> DataFrame:
    """A table of documents as a corpus; the language of the text picks the extension."""
    ending = F.create_map(*(F.lit(x) for kv in {"en": ".py", "fr": ".rs", "de": ".js", "es": ".sql"}.items() for x in kv))
    path = F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.coalesce(F.try_element_at(ending, F.col("lang")), F.lit(".txt")))
    return with_language(docs.select(path.alias("relative_path"), F.coalesce("text", F.lit("")).alias("content")))


def with_language(files: DataFrame) -> DataFrame:
    """Adds size_bytes, and language by the path alone (discovery does not open files)."""
    return files.select("relative_path", "content", F.octet_length("content").cast("long").alias("size_bytes"), languages.by_path(F.col("relative_path")).alias("language"))


def exclusion_flags(path: Column, rules: Exclusions = Exclusions()) -> dict[str, Column]:
    """Why a path is left out: a protected directory (any case), an excluded one, an excluded ending, a sensitive name."""
    parts, name = F.split(path, "/"), paths.file_name(path)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    low = F.lower(name)
    ending = F.lower(paths.extension(path)).isin(rules.extensions)
    for s in rules.suffixes:
        ending = ending | F.endswith(low, F.lit(s))
    return {
        "protected": F.exists(parts, lambda c: F.lower(c).isin(PROTECTED_DIRS)),
        "directory": F.exists(folders, lambda c: c.isin(rules.dirs)),
        "ending": ending,
        "sensitive": name.isin(SENSITIVE_NAMES) | F.startswith(name, F.lit(".env.")),
    }


def admitted(files: DataFrame, rules: Exclusions = Exclusions(), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files that no rule leaves out, not too large, and text: no NUL among the first 8192 bytes."""
    flags = exclusion_flags(F.col("relative_path"), rules)
    out = F.lit(False)
    for f in flags.values():
        out = out | f
    return files.filter(~out & (F.col("size_bytes") <= max_bytes)).filter(~F.contains(F.substring(F.col("content").cast("binary"), 1, 8192), F.lit(bytearray(b"\0"))))


def discover(files: DataFrame, options: DiscoverOptions = DiscoverOptions()) -> DataFrame:
    """(relative_path, size_bytes, language) in byte order of the path."""
    path = F.col("relative_path")
    found = files.select("relative_path", "size_bytes", "language")
    if options.extensions is not None:
        found = found.filter(paths.extension(path).isin(options.extensions))
    if options.pattern is not None:
        found = found.filter(F.contains(paths.file_name(path), F.lit(options.pattern)))
    if options.max_depth is not None:
        found = found.filter(paths.depth(path) <= options.max_depth)
    found = found.orderBy("relative_path")
    return found if options.max_results is None else found.limit(options.max_results)


def within_limits(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_SOURCE_BYTES) -> DataFrame:
    """The files, after one count; raises if there are too many or they are too large together."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    if n > max_files or size > max_bytes:
        raise ValueError(f"{n} files of {size} bytes exceed the limits of {max_files} files and {max_bytes} bytes")
    return files


def counts(root: str = "") -> list[Column]:
    """Aggregates over the entries of a walk (relative_path, status, size_bytes, reason): visited, files, source_bytes, messages,
    message_bytes, path_bytes; a path counts twice, with and without the root."""
    file, said = F.col("status") == "file", F.col("status") == "unreadable"
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    sums = {
        "visited": F.count(F.lit(1)),
        "files": F.count(F.when(file, 1)),
        "source_bytes": F.sum(F.when(file, F.col("size_bytes"))),
        "messages": F.count(F.when(said, 1)),
        "message_bytes": F.sum(F.when(said, size(F.col("relative_path")) + size(F.col("reason")))),
        "path_bytes": F.sum(F.when(file, 2 * size(F.col("relative_path")) + len(root.encode()) + 1)),
    }
    return [F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in sums.items()]


def accounting(entries: DataFrame, root: str = "") -> DataFrame:
    """One row with the ``counts`` of a walk."""
    return entries.agg(*counts(root))


def check_counts(got: dict[str, int]) -> None:
    """Raises if a walk with these ``counts`` exceeds a limit."""
    most = {"visited": MAX_VISITED, "files": MAX_FILES, "source_bytes": MAX_SOURCE_BYTES, "messages": MAX_MESSAGES, "message_bytes": MAX_MESSAGE_BYTES, "path_bytes": MAX_PATH_BYTES}
    over = [f"{k}: {got[k]}, at most {n}" for k, n in most.items() if got[k] > n]
    if over:
        raise ValueError("the walk is too large; " + "; ".join(over))


def check_walk(entries: DataFrame, root: str = "") -> DataFrame:
    """``entries``, after one count; raises if the walk exceeds a limit."""
    check_counts(accounting(entries, root).first().asDict())
    return entries


def select_files(files: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Files whose path stands in ``allowed`` (relative_path); all if that is None."""
    return files if allowed is None else files.join(allowed.select("relative_path"), "relative_path", "left_semi")


def read_file(files: DataFrame, path: str, start: int | None = None, end: int | None = None, rules: Exclusions = Exclusions(), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(relative_path, content, total_lines, language) of one file, whole or lines start..end.

    The path is brought to its normal form and held to the rules first; a file whose size is not that of its content, or
    beyond ``max_bytes``, is not given.
    """
    if (start is None) != (end is None) or start is not None and not 1 <= start <= end:
        raise ValueError("start and end: both, from 1, in order")
    text = F.col("content") if start is None else F.array_join(F.slice(lines("content"), start, end - start + 1), "\n")
    language = languages.detect(F.col("relative_path"), F.try_element_at(lines("content"), F.lit(1)))
    normal, _ = paths.normalized(F.lit(path))
    out = F.lit(False)
    for f in exclusion_flags(F.col("relative_path"), rules).values():
        out = out | f
    same = (F.col("size_bytes") == F.octet_length("content")) & (F.col("size_bytes") <= max_bytes)
    return files.filter((F.col("relative_path") == normal) & ~out & same).select("relative_path", text.alias("content"), line_count("content").alias("total_lines"), language.alias("language"))

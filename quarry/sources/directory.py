"""A directory tree as a corpus: hidden files too, under repository ignore rules and exclusions.

The tree is walked in rounds, a job for each level: the folders found so far are listed in parallel, and what they hold is
written. Then the files that no rule leaves out are dealt into at most ``PARTS`` partitions of about equally many bytes and
read. Every visited entry gives a row with its status, and the walk's limits are checked by counts taken in the job that
writes the rows. Folders and files are opened from the root's handle name by name, never through a link that leads out, so
nothing that is swapped meanwhile leads outside.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import globs
from ..operators import corpus, ordering
from ..operators.corpus import MAX_FILE_BYTES, Exclusions
from .tables import save

#: Partitions of files at most, and the bytes that one is made for; folders that a task lists.
PARTS, PART_BYTES, FOLDERS = 256, 8 << 20, 32
# Bytes of an ignore file and of a line in it, patterns and their bytes in all; links that are followed.
MAX_IGNORE_BYTES, MAX_IGNORE_LINE, MAX_PATTERNS, MAX_PATTERN_BYTES, MAX_LINKS = 1 << 20, 16 << 10, 100_000, 16 << 20, 40
ENTRY = "raw binary, relative_path string, size_bytes long, reason string, status string"
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]
_ROWS = 1000


def shown_path(path: str) -> str:
    """A path that is not UTF-8 as ``<bytes>:`` and its bytes, all but plain ones as ``%XX``."""
    try:
        path.encode()
        return path
    except UnicodeEncodeError:
        return "<bytes>:" + "".join(chr(c) if chr(c) in "/._-" or chr(c).isalnum() and c < 128 else f"%{c:02X}" for c in os.fsencode(path))


def _bounded(path: str) -> bytes | None:
    """A small file's bytes, None if it cannot be read; one beyond the limit is an error."""
    try:
        with open(path, "rb") as f:
            raw = f.read(MAX_IGNORE_BYTES + 1)
    except OSError:
        return None
    if len(raw) > MAX_IGNORE_BYTES:
        raise ValueError(f"{path}: at most {MAX_IGNORE_BYTES} bytes are read")
    return raw


def _lines(raw: bytes, path: str) -> list[bytes]:
    found = raw.removesuffix(b"\n").split(b"\n") if raw else []
    if any(len(x) > MAX_IGNORE_LINE for x in found):
        raise ValueError(f"{path}: at most {MAX_IGNORE_LINE} bytes a line are read")
    return [x.removesuffix(b"\r") for x in found]


def _first(path: str) -> str | None:
    raw = _bounded(path)
    lines = _lines(raw, path) if raw else []
    try:
        return lines[0].decode() if lines else None
    except UnicodeDecodeError:
        return None


def git_directory(marker: str) -> str | None:
    """Where a checkout's own excludes lie: ``.git``, or for a worktree the folder that its redirect leads to."""
    if os.path.isdir(marker):
        return marker
    line = _first(marker)
    if line is None or not line.startswith("gitdir: "):
        return None
    target = line.removeprefix("gitdir: ")
    common = _first(os.path.join(target, "commondir"))
    if common is None:
        return None
    return os.path.join(target, common) if common.startswith(".") else common


def user_excludes(environment: dict[str, str] | None = None) -> str | None:
    """The user's own ignore file: what the first git configuration with ``excludesFile`` names, or git's default."""
    env = os.environ if environment is None else environment
    home = env.get("HOME") or None
    config = env.get("XDG_CONFIG_HOME") or (os.path.join(home, ".config") if home else None)
    places = [env.get("GIT_CONFIG_GLOBAL"), home and os.path.join(home, ".gitconfig"), config and os.path.join(config, "git/config"), env.get("GIT_CONFIG_SYSTEM") or "/etc/gitconfig"]
    for place in filter(None, places):
        raw = _bounded(place)
        for line in _lines(raw, place) if raw else []:
            m = re.match(r'\s*excludesfile\s*=\s*"?\s*([^\s"]+)\s*"?\s*\Z', line.decode("utf-8", "replace"), re.I)
            if m:
                return m[1].replace("~", home) if home else m[1]
    return os.path.join(config, "git/ignore") if config else None


class IgnoreRules:
    """Of each directory the rules of ``.ignore``, ``.gitignore`` and, where it is a checkout, of ``info/exclude``. Of each
    of the three the nearest directory that says anything decides; ``.ignore`` goes before ``.gitignore``, that before
    ``info/exclude``, and last come the user's own excludes.

    Two models. A walk looks above the root too, and applies git's rules only inside a checkout, up to its top. A query
    about a path (``walk`` is false) takes the root for the top of a checkout and never looks above it.
    """

    def __init__(self, root: str, enabled: bool = True, walk: bool = True, excludes: str | None = None):
        self.root, self.enabled, self.walk, self.excludes = os.path.abspath(root), enabled, walk, excludes
        self.cache: dict[str, tuple] = {}
        self.patterns = self.bytes = 0
        #: (source, reason) of ignore files with a malformed rule, which is left out.
        self.failures: list[tuple[str, str]] = []

    def _rules(self, source: str) -> list[tuple[re.Pattern, bool, bool]]:
        raw, out, failure = _bounded(source), [], None
        for k, line in enumerate(_lines(raw, source) if raw else []):
            try:
                text = line.decode()
            except UnicodeDecodeError:
                failure = f"line {k + 1} is not UTF-8"
                break
            text = text.removeprefix("﻿") if not k else text
            pattern = globs.retained(text)
            if pattern is None:
                continue
            try:
                r = globs.rule(text)
                compiled = globs.compiled(r.regex) if r else None
            except (ValueError, re.error) as e:
                failure = failure or f"line {k + 1}: {e}"
                continue
            self.patterns += 1
            self.bytes += len(pattern.encode())
            if self.patterns > MAX_PATTERNS or self.bytes > MAX_PATTERN_BYTES:
                raise ValueError("too many ignore patterns")
            if r:
                out.append((compiled, r.reinstates, r.folders))
        if failure:
            self.failures.append((source, failure))
        return out

    def _of(self, folder: str) -> tuple:
        """(rules of .ignore, of .gitignore, of info/exclude, is it a checkout) of a folder."""
        if folder not in self.cache:
            marker = os.path.join(folder, ".git")
            checkout = os.path.exists(marker) or os.path.exists(os.path.join(folder, ".jj"))
            git = git_directory(marker) if os.path.exists(marker) else None
            exclude = self._rules(os.path.join(git, "info/exclude")) if git else []
            self.cache[folder] = self._rules(os.path.join(folder, ".ignore")), self._rules(os.path.join(folder, ".gitignore")), exclude, checkout
        return self.cache[folder]

    @staticmethod
    def _said(rules: list, rest: str, folder: bool) -> bool | None:
        return next((not back for rule, back, only in reversed(rules) if (folder or not only) and rule.match(rest)), None)

    def ignored(self, path: str, folder: bool) -> bool:
        """Is this entry ignored, its folders not being so?"""
        if not self.enabled:
            return False
        full = os.path.join(self.root, path)
        above, at = [], os.path.dirname(full)
        while True:
            above.append(at)
            if at == os.path.dirname(at) or not self.walk and at == self.root:
                break
            at = os.path.dirname(at)
        found = [self._of(f) for f in above]
        inside, passed, said = not self.walk or any(f[3] for f in found), False, [None, None, None]
        for base, rules in zip(above, found, strict=True):
            rest = os.path.relpath(full, base)
            for k in range(3):
                if said[k] is None and (k == 0 or inside and not passed):
                    said[k] = self._said(rules[k], rest, folder)
            passed = passed or rules[3]
        last = self._said(self._own(), os.path.relpath(full, self.root), folder) if inside and self.excludes else None
        return next((s for s in (*said, last) if s is not None), False)

    def _own(self) -> list:
        if "" not in self.cache:
            self.cache[""] = (self._rules(self.excludes),)
        return self.cache[""][0]


class Handles:
    """Folders and files below a root, opened from its handle name by name."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)
        self.top = os.open(self.root, os.O_RDONLY | os.O_DIRECTORY)
        self.last: tuple[bytes, int] | None = None

    def close(self) -> None:
        if self.last:
            os.close(self.last[1])
        os.close(self.top)

    def folder(self, raw: bytes) -> int:
        """The handle of a folder, by names that are no links. The last one stays open."""
        if not raw:
            return self.top
        if self.last and self.last[0] == raw:
            return self.last[1]
        fd = os.dup(self.top)
        for name in raw.split(b"/"):
            try:
                inner = os.open(name, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=fd)
            finally:
                os.close(fd)
            fd = inner
        if self.last:
            os.close(self.last[1])
        self.last = raw, fd
        return fd

    def file(self, raw: bytes) -> int:
        """A regular file's handle. Links are followed by hand, and never out of the root."""
        for _ in range(MAX_LINKS):
            folder, _, name = raw.rpartition(b"/")
            at = self.folder(folder)
            try:
                fd = os.open(name, os.O_RDONLY | os.O_NONBLOCK | os.O_NOFOLLOW, dir_fd=at)
            except OSError:
                target = os.readlink(name, dir_fd=at)  # what is no link is an error here
                raw = self._within(folder, target)
                continue
            if not stat.S_ISREG(os.fstat(fd).st_mode):
                os.close(fd)
                raise OSError("not a regular file")
            return fd
        raise OSError("too many links")

    def _within(self, folder: bytes, target: bytes) -> bytes:
        """Where a link leads, below the root: the folders on the way are resolved, and opened without links afterwards."""
        full = os.path.realpath(os.path.join(os.fsencode(self.root), folder, os.path.dirname(target)))
        top = os.fsencode(self.root)
        if full != top and not full.startswith(top + b"/"):
            raise OSError("a link leads outside")
        return os.path.join(full[len(top) + 1 :], os.path.basename(target))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


_KINDS = [pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string()]


def _entry(name: bytes, path: str, at: int, rules: IgnoreRules, root: str, most: int) -> tuple:
    """(size, reason, status) of an entry of the folder ``at``; status None: a file to be read."""
    try:
        info = os.stat(name, dir_fd=at, follow_symlinks=False)
        size = info.st_size
        if stat.S_ISLNK(info.st_mode):
            real = os.path.realpath(os.path.join(root, path))
            if real != root and not real.startswith(root + "/"):
                return size, None, "outside"
            info = os.stat(real)
            size = info.st_size
            if stat.S_ISDIR(info.st_mode):
                return size, None, "special"
        folder = stat.S_ISDIR(info.st_mode)
        if rules.ignored(path, folder) or folder and name == b".git":
            return size, None, "ignored"
        if folder:
            return size, None, "folder"
        if not stat.S_ISREG(info.st_mode):
            return size, None, "special"
        return size, None, "too large" if size > most else None
    except OSError as e:
        return None, e.strerror or str(e), "unreadable"


def _lister(root: str, most: int, ignore_files: bool, excludes: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles, rules = Handles(root), IgnoreRules(root, ignore_files, excludes=excludes)
        rows: list[tuple] = []
        try:
            for b in batches:
                for raw in b.column(0).to_pylist():
                    told = len(rules.failures)
                    try:
                        at = handles.folder(raw)
                        names = sorted(os.fsencode(e) if isinstance(e, str) else e for e in os.listdir(at))
                    except OSError as e:
                        rows.append((raw, shown_path(os.fsdecode(raw)), None, e.strerror or str(e), "unreadable"))
                        continue
                    for name in names:
                        own = raw + b"/" + name if raw else name
                        path = os.fsdecode(own)
                        rows.append((own, shown_path(path), *_entry(name, path, at, rules, handles.root, most)))
                        if len(rows) >= _ROWS:
                            yield _table(rows, _NAMES, _KINDS)
                            rows = []
                    below = os.path.join(handles.root, os.fsdecode(raw))
                    for source, reason in rules.failures[told:]:  # those above the folder are told by their own
                        if os.path.dirname(source) == below.rstrip("/") or not raw:
                            rows.append((b"", shown_path(os.path.relpath(source, handles.root)), None, reason, "unreadable"))
            if rows:
                yield _table(rows, _NAMES, _KINDS)
        finally:
            handles.close()

    return run


def _reader(root: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles = Handles(root)
        names, kinds = ["relative_path", "content", "size_bytes", "reason", "status"], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        rows, held = [], 0
        try:
            for b in batches:
                for raw, path, size in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    rows.append((path, *_content(handles, raw, size, most)))
                    held += len(rows[-1][1] or "")
                    if len(rows) >= _ROWS or held > PART_BYTES:
                        yield _table(rows, names, kinds)
                        rows, held = [], 0
            if rows:
                yield _table(rows, names, kinds)
        finally:
            handles.close()

    return run


def _content(handles: Handles, raw: bytes, size: int, most: int) -> tuple:
    """(content, size, reason, status) of a file."""
    try:
        os.fsdecode(raw).encode()
    except UnicodeEncodeError:
        return None, size, "the path is not UTF-8", "unreadable"
    try:
        with os.fdopen(handles.file(raw), "rb") as f:
            data = f.read(most + 1)
    except OSError as e:
        return None, size, e.strerror or str(e), "unreadable"
    if len(data) > most:
        return None, size, None, "too large"
    if b"\0" in data[:8192]:
        return None, size, None, "binary"
    return data.decode("utf-8", "replace"), len(data), None, "file"


def entries(spark, root: str, max_file_bytes: int = MAX_FILE_BYTES, ignore_files: bool = True, excludes: str | None = None) -> DataFrame:
    """ENTRY of all that is visited below ``root``; status is null for files that are to be read. A job a level."""
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    lister = _lister(root, max_file_bytes, ignore_files, excludes)
    frontier, n, found = spark.createDataFrame([(bytearray(),)], "raw binary"), 1, None
    while n:
        listed = save(frontier.repartition(min(PARTS, -(-n // FOLDERS))).mapInArrow(lister, ENTRY), "listing")
        found = listed if found is None else found.unionByName(listed)
        frontier = listed.filter("status = 'folder'").select("raw")
        n = frontier.count()
    return found


def walk(spark, root: str, max_file_bytes: int = MAX_FILE_BYTES, ignore_files: bool = True, excludes: str | None = None, rules: Exclusions | None = Exclusions()) -> DataFrame:
    """Every visited entry of a tree, written: (relative_path, content, size_bytes, reason, status).

    status: file, folder, ignored, excluded, sensitive, too large, binary, outside (a link out of the tree), special, or
    unreadable, with a reason; an ignore file with a malformed rule is unreadable too. What rules exclude is not opened.
    excludes: a file with rules of the user's own, see ``user_excludes``. An untrusted snapshot sets ignore_files to false.
    A walk beyond its limits is an error.
    """
    found = entries(spark, root, max_file_bytes, ignore_files, excludes)
    status = F.col("status")
    if rules is not None:
        flags = corpus.exclusion_flags(F.col("relative_path"), rules)
        left_out = F.when(flags["protected"] | flags["directory"] | flags["ending"], "excluded").when(flags["sensitive"], "sensitive")
        status = F.when(status.isNull() | (status == "too large"), F.coalesce(left_out, status)).otherwise(status)
    found = found.withColumn("status", status)
    todo = save(found.filter("status is null").drop("reason", "status"), "todo")
    total = todo.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    parts = max(1, min(PARTS, -(-total // PART_BYTES)))
    placed = ordering.running(todo, ["relative_path"], "size_bytes", "until")
    part = F.least(F.lit(parts - 1), F.floor((F.col("until") - F.col("size_bytes")) * parts / max(1, total))).cast("int")
    dealt = placed.withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("raw").select("raw", "relative_path", "size_bytes")
    read = dealt.mapInArrow(_reader(os.path.realpath(root), max_file_bytes), "relative_path string, content string, size_bytes long, reason string, status string")
    rest = found.filter("status is not null").select("relative_path", F.lit(None).cast("string").alias("content"), "size_bytes", "reason", "status")
    counts = Observation("walk")
    out = save(rest.unionByName(read).observe(counts, *corpus.counts(os.path.realpath(root))), "walk")
    corpus.check_counts(counts.get)
    return out


def read_directory(spark, root: str, max_file_bytes: int = MAX_FILE_BYTES, ignore_files: bool = True, excludes: str | None = None, rules: Exclusions | None = Exclusions()) -> tuple[DataFrame, DataFrame]:
    """(files, unreadable) of a tree; unreadable in the order of path and reason."""
    rows = walk(spark, root, max_file_bytes, ignore_files, excludes, rules)
    unreadable = rows.filter("status = 'unreadable'").select("relative_path", "reason", F.concat("relative_path", F.lit(" ("), "reason", F.lit(")")).alias("shown"))
    return corpus.with_language(rows.filter("status = 'file'")), unreadable.orderBy("relative_path", "reason")

"""Directory trees and ignore rules."""

import os

import pytest

from quarry.functions import globs
from quarry.operators import corpus, ignore
from quarry.sources import directory

GLOBS = [
    ("*.py", "a/b.py", True), ("*.py", "b.pyc", False), ("/a", "a", True), ("/a", "x/a", False), ("a/b", "a/b", True), ("a/b", "x/a/b", False), ("**/a/b", "x/y/a/b", True), ("**/a/b", "a/b", True),
    ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**", "a/x/y", True), ("a/**", "a", False), ("**", "x/y", True), ("a**b", "axb", True), ("a**b", "a/x/b", False),
    ("a?c", "abc", True), ("a?c", "a/c", False), ("a[!b]c", "adc", True), ("a[!b]c", "abc", False), ("a[!b]c", "a/c", False), ("[^x]y", "xy", False), ("[]x]", "]", True), ("[a-c-]", "-", True), ("[[:space:]x]", " ", True), ("[[:digit:]]", "7", True), ("[\\]]", "]", True),
    ("*.{js,ts}", "a.ts", True), ("*.{js,ts}", "a.tsx", False), ("{a,b/{c,d}}/e", "b/d/e", True), ("a,b", "a,b", True), (r"\#x", "#x", True), (r"\!x", "!x", True), (r"\*", "*", True), (r"\*", "x", False), ("a b\\ ", "a b ", True), ("a\\\\z", "a\\z", True), ("é[à-ü]", "éé", True), ("a.b", "axb", False), ("a&&b", "a&&b", True), ("[&&x]", "&", True),
]


@pytest.mark.parametrize(("line", "path", "hit"), GLOBS)
def test_globs(line, path, hit):
    assert bool(globs.compiled(globs.rule(line).regex).match(path)) == hit


def test_globs_are_read_by_java_alike(spark):
    rows = spark.createDataFrame([(path, globs.rule(line).regex, hit) for line, path, hit in GLOBS], "path string, regex string, hit boolean")
    assert rows.selectExpr("path", "regex", "hit", "path rlike regex as found").filter("found != hit").collect() == []


@pytest.mark.parametrize("line", ["[z-a]", "a[", "[", "{a", "a}", "x\\"])
def test_malformed_globs(line):
    with pytest.raises(ValueError):
        globs.rule(line)


def test_lines_without_a_rule():
    assert [globs.rule(x) for x in ("", "  ", "# x", "/", "!")] == [None] * 5
    assert (globs.rule("!a/ ").reinstates, globs.rule("a/").folders, globs.rule("a").folders) == (True, True, False)


def grow(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body if isinstance(body, bytes) else body.encode())


def statuses(rows):
    return {r.relative_path: r.status for r in rows.collect()}


def test_what_is_excluded_is_never_opened(spark, tmp_path):
    grow(tmp_path, {".env": "S=1", ".env.local": "S=1", "id_rsa": "k", "node_modules/a.js": "x", "src/a.rs": "fn f() {}", "src/b.min.js": "x", "src/.SSH/c": "x", "deep/a/b/c/d.py": "x = 1\n", "lib.lock": "x"})
    for locked in (".env", "node_modules/a.js"):
        os.chmod(tmp_path / locked, 0)
    rows = directory.walk(spark, str(tmp_path))
    got = statuses(rows)
    assert {k: v for k, v in got.items() if v != "folder"} == {".env": "sensitive", ".env.local": "sensitive", "id_rsa": "sensitive", "node_modules/a.js": "excluded", "src/a.rs": "file", "src/b.min.js": "excluded", "src/.SSH/c": "excluded", "deep/a/b/c/d.py": "file", "lib.lock": "excluded"}
    assert {k for k, v in got.items() if v == "folder"} == {"node_modules", "src", "src/.SSH", "deep", "deep/a", "deep/a/b", "deep/a/b/c"}
    assert all(r.content is None for r in rows.collect() if r.status != "file")
    assert statuses(directory.walk(spark, str(tmp_path), rules=None))["id_rsa"] == "file"


def test_a_large_folder_makes_few_partitions(spark, tmp_path):
    for k in range(3000):
        (tmp_path / f"f{k:04}.py").write_bytes(b"x = %d\n" % k * (k % 50))
    (tmp_path / "empty").mkdir()
    rows = directory.walk(spark, str(tmp_path))
    assert rows.count() == 3001 and statuses(rows)["empty"] == "folder"
    assert {r.relative_path: r.content for r in rows.filter("status = 'file'").collect()} == {f"f{k:04}.py": f"x = {k}\n" * (k % 50) for k in range(3000)}
    assert spark.read.parquet(*[f for f in rows.inputFiles()]).count() == 3001 and len(rows.inputFiles()) <= directory.PARTS + 20


def test_files_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(directory, "PART_BYTES", 1000)
    monkeypatch.setattr(directory, "PARTS", 8)
    for k in range(200):
        (tmp_path / f"f{k:03}.py").write_bytes(b"x" * (k % 7 * 50))
    rows = directory.walk(spark, str(tmp_path))
    from pyspark.sql import functions as F

    sizes = [r.s for r in rows.filter("status = 'file'").groupBy(F.input_file_name().alias("f")).agg(F.sum("size_bytes").alias("s")).collect()]
    assert 4 <= len(sizes) <= 8 and max(sizes) < 2 * sum(sizes) / 8


def test_links_do_not_lead_outside(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    grow(root, {"a/real.py": "inside", "b/x.py": "x"})
    grow(other, {"secret.py": "outside"})
    (root / "link.py").symlink_to("a/real.py")
    (root / "b/up.py").symlink_to("../a/real.py")
    (root / "out.py").symlink_to(other / "secret.py")
    (root / "folder").symlink_to(other)
    (root / "inner").symlink_to("a")
    (root / "gone.py").symlink_to("nothing.py")
    os.mkfifo(root / "pipe")
    rows = {r.relative_path: r for r in directory.walk(spark, str(root)).collect()}
    assert {k: (r.status, r.content) for k, r in rows.items() if r.status not in ("folder", "unreadable")} == {"a/real.py": ("file", "inside"), "b/x.py": ("file", "x"), "link.py": ("file", "inside"), "b/up.py": ("file", "inside"), "out.py": ("outside", None), "folder": ("outside", None), "inner": ("special", None), "pipe": ("special", None)}
    assert rows["gone.py"].status == "unreadable"
    # A folder, and a file, swapped for links after they were listed.
    handles = directory.Handles(str(root))
    (root / "a/real.py").unlink()
    (root / "a/real.py").symlink_to(other / "secret.py")
    with pytest.raises(OSError, match="outside"):
        handles.file(b"a/real.py")
    (root / "b/x.py").rename(tmp_path / "moved")
    (root / "b/up.py").unlink()
    (root / "b").rmdir()
    (root / "b").symlink_to(other)
    with pytest.raises(OSError):
        handles.file(b"b/secret.py")
    handles.close()


def test_malformed_rules_and_names_are_told(spark, tmp_path):
    grow(tmp_path, {".ignore": "[z-a]\nskip.py\n", "skip.py": "x", "keep.py": "x", "d/.ignore": b"a\n\xff\nb.py\n", "d/b.py": "x"})
    with open(os.path.join(os.fsencode(tmp_path), b"n\xff.py"), "w") as f:
        f.write("x")
    rows = directory.walk(spark, str(tmp_path)).filter("status != 'folder'").collect()
    assert {(r.relative_path, r.status) for r in rows} == {(".ignore", "file"), (".ignore", "unreadable"), ("skip.py", "ignored"), ("keep.py", "file"), ("d/.ignore", "file"), ("d/.ignore", "unreadable"), ("d/b.py", "file"), ("<bytes>:n%FF.py", "unreadable")}
    assert {r.relative_path: r.reason for r in rows if r.status == "unreadable" and "ignore" in r.relative_path} == {".ignore": "line 1: z-a is no range", "d/.ignore": "line 2 is not UTF-8"}


def test_limits_are_checked_by_the_job_that_writes(spark, tmp_path, monkeypatch):
    grow(tmp_path, {f"{k}.py": "x" for k in range(5)})
    monkeypatch.setattr(corpus, "MAX_FILES", 4)
    with pytest.raises(ValueError, match="files: 5, at most 4"):
        directory.walk(spark, str(tmp_path))


def test_worktrees_and_user_excludes(tmp_path, spark):
    root, store = tmp_path / "tree", tmp_path / "main/.git"
    grow(tmp_path, {"main/.git/info/exclude": "hidden.py\n", "main/.git/worktrees/t/commondir": "../..\n", "tree/hidden.py": "x", "tree/own.py": "x", "tree/a.py": "x", "conf/.gitconfig": '[core]\n\tExcludesFile = "~/mine"\n', "conf/mine": "own.py\n"})
    (root / ".git").write_text(f"gitdir: {store}/worktrees/t\n")
    excludes = directory.user_excludes({"HOME": str(tmp_path / "conf"), "GIT_CONFIG_SYSTEM": str(tmp_path / "none")})
    assert excludes == str(tmp_path / "conf/mine")
    assert directory.user_excludes({"HOME": "/h"}) in ("/h/.config/git/ignore", directory.user_excludes({"HOME": "/h", "XDG_CONFIG_HOME": "/h/.config"}))
    assert directory.user_excludes({"GIT_CONFIG_SYSTEM": "/none"}) is None
    got = statuses(directory.walk(spark, str(root), excludes=excludes))
    assert (got["hidden.py"], got["own.py"], got["a.py"]) == ("ignored", "ignored", "file")


def test_rules_of_a_table(spark, tmp_path):
    """The same tree by its tables, and walked."""
    grow(tmp_path, {
        ".git/info/exclude": "ex*.py\n", ".gitignore": "*.js\n!keep.js\n/only/\nbuild/\n", ".ignore": "*.tmp\n[z-a]\n", "src/.gitignore": "!*.js\nbuild\n", "src/.ignore": "keep.js\n!a.tmp\n",
        "a.js": "", "keep.js": "", "a.tmp": "", "ex1.py": "", "only/x.py": "", "src/only/x.py": "", "src/b.js": "", "src/keep.js": "", "src/a.tmp": "", "src/c/a.tmp": "", "src/build": "", "build/keep.js": "", "src/ex2.py": "", "src/c/é.js": "",
    })
    names = {os.path.relpath(os.path.join(d, f), tmp_path) for d, _, found in os.walk(tmp_path) for f in found if "/.git/" not in f"{d}/"}
    walked = {r.relative_path for r in directory.walk(spark, str(tmp_path), rules=None).filter("status = 'file'").collect()}
    text = lambda p: (tmp_path / p).read_text()
    sources = [("", "gitignore", text(".gitignore")), ("", "ignore", text(".ignore")), ("", "exclude", text(".git/info/exclude")), ("src", "gitignore", text("src/.gitignore")), ("src", "ignore", text("src/.ignore")), ("elsewhere", "ignore", "*")]
    sources = spark.createDataFrame(sources, "folder string, kind string, content string")
    assert [(r.folder, r.line, r.problem) for r in ignore.rules(sources).filter("problem is not null").collect()] == [("", 2, "z-a is no range")]
    files = spark.createDataFrame([(n, 1) for n in names], "relative_path string, x int")
    assert {r.relative_path for r in ignore.kept(files, sources).collect()} == walked
    assert "src/c/a.tmp" in walked and "src/b.js" in walked and not walked & {"a.js", "a.tmp", "ex1.py", "only/x.py", "src/keep.js", "src/build", "build/keep.js", "src/ex2.py"}
    judged = ignore.judged(spark.createDataFrame([("build", True), ("build", False), ("only", True)], "relative_path string, is_folder boolean"), ignore.rules(sources))
    assert {(r.relative_path, r.is_folder): r.ignored for r in judged.collect()} == {("build", True): True, ("build", False): False, ("only", True): True}
    assert ignore.judged(files.limit(0).selectExpr("relative_path", "false as is_folder"), ignore.rules(sources)).count() == 0

"""The six calls; cancellation and progress."""

import json
import threading
import time

import pytest

from quarry.operators import corpus, report
from quarry.plans import calls, running

FILES = [("src/a.py", "def f():\n    return 1\n# TODO\n"), ("src/b.rs", "fn one() { two(); }\n"), ("c.txt", "hit\n" * 3), (".env", "hit"), ("node_modules/x.py", "hit")]


@pytest.fixture
def over(spark):
    files = corpus.with_language(spark.createDataFrame(FILES, "relative_path string, content string"))
    return lambda **k: calls.Calls(files, **k)


def test_calls(spark, over):
    c = over()
    call = lambda name, **a: json.loads(c.call(name, json.dumps(a)))
    assert [f["relative_path"] for f in call("discover_files")] == ["c.txt", "src/a.py", "src/b.rs"]
    assert [f["relative_path"] for f in call("discover_files", extensions=["py", "rs"], max_results=1)] == ["src/a.py"]
    found = call("search_text", pattern="HIT", context_lines=1)
    assert [(f["relative_path"], f["line_number"], f["before"], f["after"]) for f in found] == [("c.txt", 1, [], ["hit"]), ("c.txt", 2, ["hit"], ["hit"]), ("c.txt", 3, ["hit"], [])]
    assert call("search_text", pattern="HIT", case_sensitive=True) == []
    assert call("read_file", path="./src//a.py", start_line=2, end_line=9)["content"] == "    return 1\n# TODO" and c.read == ["src/a.py"]
    assert [m["matched_code"] for m in call("search_ast", path="src/b.rs", query="(call_expression function: (identifier) @f)", language="rust")] == ["two"]
    got = call("project_stats")
    assert (got["files"], got["comments"], [x["language"] for x in got["languages"]]) == (2, 1, ["python", "rust"]) or got["files"] == 3
    given = {"category": "bug", "severity": "low", "title": "t", "description": "d", "file": "src/a.py"}
    assert c.call("submit_findings", {"findings": [given, given | {"code_snippet": "# TODO"}]}) == "Accepted 2 findings."
    assert sorted((r.line_start or 0, r.confidence, r.source) for r in c.accepted[0].collect()) == [(0, "medium", "ai"), (3, "medium", "ai")]
    assert [r.path for r in c.coverage().collect()] == ["src/a.py"]


@pytest.mark.parametrize(
    ("name", "arguments", "why"),
    [
        ("nothing", {}, "no call"), ("project_stats", {"x": 1}, "unknown field x"), ("discover_files", "[]", "an object"), ("discover_files", "{", "discover_files"), ("discover_files", {"extensions": ["x" * 33]}, "32 bytes"), ("discover_files", {"extensions": ["a"] * 33}, "32 values"),
        ("discover_files", {"max_depth": 0}, "1 to 256"), ("discover_files", {"max_results": 1001}, "1 to 1000"), ("discover_files", {"max_results": True}, "1 to 1000"), ("discover_files", {"pattern": " "}, "not empty"), ("search_text", {}, "pattern is missing"), ("search_text", {"pattern": "é" * 2049}, "4096 bytes"), ("search_text", {"pattern": "x", "context_lines": 21}, "0 to 20"), ("search_text", {"pattern": "x", "case_sensitive": 1}, "true or false"),
        ("read_file", {"path": "../x"}, "parent"), ("read_file", {"path": ".env"}, "excluded"), ("read_file", {"path": "absent"}, "no such file"), ("read_file", {"path": "c.txt", "start_line": 1}, "both"), ("read_file", {"path": "c.txt", "start_line": 3, "end_line": 2}, "order"),
        ("search_ast", {"path": "src/b.rs", "query": "(nope)", "language": "rust"}, "syntax query"), ("search_ast", {"path": "src/b.rs", "query": "(identifier) @x", "language": "cobol"}, "no syntax trees"), ("submit_findings", {"findings": [{"category": "bug"}]}, "finding 1: severity is missing"),
        ("submit_findings", {"findings": [{"category": "odd", "severity": "low", "title": "t", "description": "d", "file": "c.txt"}]}, "category"), ("submit_findings", {"findings": [{"category": "bug", "severity": "low", "title": "t", "description": "d", "file": "c.txt", "code_snippet": "hit"}]}, "exactly once"), ("submit_findings", {"findings": [{"category": "bug", "severity": "low", "title": "t", "description": "d", "file": "c.txt", "line_start": 2, "line_end": 9}]}, "outside the file"), ("submit_findings", {"findings": [{"x": 1}]}, "unknown field x"),
    ],
)
def test_calls_that_are_refused(over, name, arguments, why):
    with pytest.raises(calls.CallError, match=why):
        over().call(name, arguments)


def test_scope_and_bounds(spark, over, monkeypatch):
    c = over(allowed=spark.createDataFrame([("src/a.py",)], "relative_path string"), hunks=spark.createDataFrame([("src/a.py", 3, 3)], "path string, start int, end int"))
    assert [f["relative_path"] for f in json.loads(c.call("discover_files", {}))] == ["src/a.py"] and json.loads(c.call("search_text", {"pattern": "hit"})) == []
    with pytest.raises(calls.CallError, match="outside the scope"):
        c.call("read_file", {"path": "c.txt"})
    given = {"category": "bug", "severity": "low", "title": "t", "description": "d", "file": "src/a.py"}
    assert c.call("submit_findings", {"findings": [given | {"line_start": 3, "line_end": 3}]}) == "Accepted 1 findings."
    for bad, why in (({"line_start": 1, "line_end": 1}, "no changed line"), ({}, "no lines")):
        with pytest.raises(calls.CallError, match=why):
            c.call("submit_findings", {"findings": [given | bad]})
    monkeypatch.setattr(calls, "MAX_OUTPUT", 20)
    for name, arguments in (("discover_files", {}), ("read_file", {"path": "src/a.py"}), ("project_stats", {})):
        with pytest.raises(calls.CallError, match="exceeds"):
            c.call(name, arguments)
    assert c.read == []


def test_a_cancelled_run_leaves_nothing(spark, tmp_path):
    def slow(frames):
        for f in frames:
            time.sleep(0.2)
            yield f

    out, seen = tmp_path / "report.json", []
    with pytest.raises(running.Cancelled) as e, running.Run(spark) as run:

        def watch():
            time.sleep(3)
            seen.append(run.fraction())
            run.cancel()

        threading.Thread(target=watch).start()
        rows = spark.range(400).repartition(100).mapInPandas(slow, "id long")
        for _ in range(20):
            rows.count()
            run.check()
        report.write_atomically(str(out), "{}")
    assert e.value.code == 130 and list(tmp_path.iterdir()) == [] and 0 <= seen[0] < 1


def test_progress_never_falls(spark):
    seen = []
    with running.Run(spark) as run:
        for n in (4, 40, 2):
            spark.range(100).repartition(n).count()
            seen.append(run.fraction())
    assert seen == sorted(seen) and 0 < seen[-1] < 1 and run.fraction() == 1.0


def test_the_root_cause_is_the_deepest_error():
    with pytest.raises(ValueError) as e:
        try:
            try:
                raise PermissionError("denied")
            except PermissionError as inner:
                raise OSError("cannot be read") from inner
        except OSError:
            raise ValueError("no such file")  # noqa: B904
    assert report.root_cause(e.value) == "denied" and report.root_cause(KeyError("x")) == "'x'"

"""Folding of server-sent events, as a batch and as a stream."""

import itertools
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.streaming import events


def line(delta=None, **more):
    return b"data: " + json.dumps({"choices": [{"delta": delta or {}, **more}]}).encode() + b"\n"


def call(**fragment):
    return line({"tool_calls": [fragment]})


def fold(*chunks):
    f = events.Fold()
    for c in chunks:
        f.add(c)
    f.close()
    return dict(zip(events._COLUMNS, f.result("s"), strict=True))


STREAM = line({"content": "hé"}) + b"\n: note\n  data: \n" + call(index=0, id="i", function={"name": "f", "arguments": '{"a"'}) + call(function={"arguments": ":1}"}) + b"data: nonsense\ndata: \xff\n"
STREAM += b'data: {"choices":[],"usage":{"prompt_tokens":7,"completion_tokens":2}}\r\ndata: [DONE]\n' + line({"content": "late"})
WANT = ("s", "hé", [{"id": "i", "name": "f", "arguments": '{"a":1}', "input": '{"a":1}'}], "tool_use", True, True, None, 7, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, len(STREAM)), max_size=8))
def test_cuts_do_not_matter(cuts):
    """Nor does a fold that goes on from what another has kept."""
    f, text, pieces = events.Fold(), [], []
    for a, b in itertools.pairwise([0, *sorted(cuts), len(STREAM)]):
        f.add(STREAM[a:b])
        text += f.text
        pieces += f.pieces
        f = events.Fold(f.head(), f.calls)
    f.close()
    assert f.result("s", "".join(text + f.text), pieces + f.pieces) == WANT


def test_what_lines_are_ignored_and_what_is_malformed():
    ignored = fold(b"data:\n", b"data:   \n", b"event: x\n", b"  \n", b"\xc2\xa0data: [DONE]\xc2\xa0\n")
    assert (ignored["malformed"], ignored["complete"], ignored["stop_reason"]) == (False, True, None)
    for bad in (b"{", b"[]", b'"x"', b"1", b"null", b"NaN", b'{"choices":null}', b'{"choices":{}}', b'{"choices":[1]}', b'{"choices":[{"delta":null}]}', b'{"choices":[{"delta":{"content":1}}]}', b'{"choices":[{"finish_reason":2}]}', b'{"choices":[],"choices":[]}', b'{"choices":[{"delta":{"content":"\\ud800"}}]}',
                b'{"choices":[{"delta":{"tool_calls":null}}]}', b'{"choices":[{"delta":{"tool_calls":[{"index":"0"}]}}]}', b'{"choices":[{"delta":{"tool_calls":[{"index":-1}]}}]}', b'{"choices":[{"delta":{"tool_calls":[{"index":true}]}}]}', b'{"choices":[{"delta":{"tool_calls":[{"index":1.0}]}}]}', b'{"usage":{"prompt_tokens":-1}}', b'{"x":' + b"[" * 200 + b"]" * 200 + b"}", b"[" * 100_000, b"1" * 5000):
        got = fold(b"data: " + bad + b"\n", line({"content": "ok"}))
        assert got["malformed"] and got["text"] == "ok", bad
    for good in (b"{}", b'{"choices":[{"delta":{"content":null,"role":"x"},"finish_reason":null}],"usage":null,"other":[[NULL]]}'.replace(b"NULL", b"null"), b'{"choices":[{}]}', b'{"x":"' + b"[" * 500 + b'"}', b'{"a":1,"a":2}'):
        assert not fold(b"data: " + good + b"\n")["malformed"], good


def test_a_bad_call_leaves_nothing_of_its_chunk():
    got = fold(line({"content": "x", "tool_calls": [{"index": 0, "function": {"name": "a"}}, {"index": "1"}]}))
    assert (got["text"], got["tool_calls"], got["malformed"]) == ("", [], True)


def test_all_choices_are_read_and_names_are_replaced():
    both = b"data: " + json.dumps({"choices": [{"delta": {"content": "a"}}, {"delta": {"content": "b"}, "finish_reason": "length"}]}).encode() + b"\n"
    assert (fold(both)["text"], fold(both)["stop_reason"]) == ("ab", "max_tokens")
    got = fold(call(index=0, id="x", function={"name": "get"}), call(index=0, id="", function={"name": "", "arguments": "{"}), call(index=0, function={"name": "get", "arguments": "}"}))
    assert got["tool_calls"] == [{"id": "x", "name": "get", "arguments": "{}", "input": "{}"}]


def test_indexes_of_calls():
    f = lambda n: {"name": n, "arguments": n}
    got = fold(call(function=f("a")), call(function={"arguments": "1"}), call(function=f("b")), call(index=7, function=f("c")), call(index=3), call(function={"arguments": "2"}), call(function=f("d")))
    assert [(c["name"], c["arguments"], c["input"]) for c in got["tool_calls"]] == [("a", "a1", "{}"), ("b", "b", "{}"), ("", "2", "2"), ("c", "c", "{}"), ("d", "d", "{}")]
    assert fold(line(finish_reason="tool_calls"))["stop_reason"] == "tool_use" and fold(line(finish_reason="stop"))["stop_reason"] == "end_turn"


def test_a_fragment_that_overflows_is_not_taken(monkeypatch):
    monkeypatch.setattr(events, "MAX_ARGUMENT", 10)
    monkeypatch.setattr(events, "MAX_ARGUMENTS", 15)
    fits = [call(index=0, function={"arguments": "x" * 10}), call(index=1, function={"arguments": "é" * 2})]
    assert fold(*fits)["error"] is None
    one = fold(*fits, call(index=0, function={"arguments": "y"}), line({"content": "late"}))
    assert one["error"] == "a call's arguments are too large" and one["tool_calls"][0]["arguments"] == "x" * 10 and one["text"] == ""
    every = fold(*fits, call(index=2, function={"arguments": "zz"}))
    assert every["error"] == "arguments too large" and len(every["tool_calls"]) == 2
    monkeypatch.setattr(events, "MAX_STREAM", 30)
    assert fold(b"x" * 30)["error"] is None and fold(b"x" * 30, b"y")["error"] == "stream too large"


def test_batches_and_streams_agree(spark, tmp_path):
    ends = STREAM.replace(b"late", b"later")
    rows = [("s", i, STREAM[i * 20 : i * 20 + 20]) for i in range(len(STREAM) // 20 + 1)] + [("t", i, ends[i * 90 : i * 90 + 90]) for i in range(len(ends) // 90 + 1)]
    rows += [("open", 0, line({"content": "x"}, finish_reason="length")[:-1])]
    chunks = spark.createDataFrame(rows, "stream_id string, seq int, chunk binary")
    want = {r.stream_id: r.asDict(True) for r in events.fold_streams(chunks.repartition(3)).collect()}
    assert tuple(want["s"].values()) == WANT and (want["open"]["text"], want["open"]["stop_reason"], want["open"]["complete"]) == ("x", "max_tokens", True)
    for part in range(4):  # four batches; the last has what comes after the end
        chunks.filter(f"seq % 100 div 6 = {part}" if part < 3 else "seq div 6 >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # of the state, as batches are small
    live = events.stream(spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("events_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    files, until = len(list((tmp_path / "in").glob("*.parquet"))), time.time() + 120
    while sum(p.numInputRows > 0 for p in q.recentProgress) < files and time.time() < until:  # timers keep it running
        time.sleep(0.5)
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {r.stream_id: r.asDict(True) for r in spark.table("events_out").collect()}
    assert got == {k: want[k] for k in ("s", "t")} and spark.table("events_out").count() == 2


@pytest.mark.parametrize("text", ["", " ", "{", '{"a":NaN}', "[" * 5000])
def test_arguments_that_are_no_json_are_an_empty_object(text):
    assert events.as_input(text) == "{}" and events.as_input('{"a": 1}') == '{"a": 1}'

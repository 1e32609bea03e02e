"""Server-sent events folded into responses: as a batch over ordered chunks and as a stateful stream.

Chunks may cut lines, and characters, anywhere. Lines are trimmed; those that don't begin with ``data:``, or have nothing
after it, are ignored; ``[DONE]`` ends the stream. A line that is not UTF-8, no JSON, or JSON of another shape is noted as
malformed and leaves nothing behind. Texts are joined; fragments of tool calls are joined by their index (without one: the
last call, unless a new name starts), an id or a name that is not empty replaces the one before.

Limits are those of bytes of a stream, of one call's arguments and of all arguments: the chunk or fragment that would
overflow is not taken in, and the stream ends with an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Bytes of a stream, of one call's arguments, of all arguments; depth of JSON.
MAX_STREAM, MAX_ARGUMENT, MAX_ARGUMENTS, MAX_DEPTH = 64 << 20, 1 << 20, 8 << 20, 128
#: Milliseconds of silence after which a stream has ended, and for which an ended one is remembered.
SILENCE = 600_000
RESULT = "stream_id string, text string, tool_calls array<struct<id:string,name:string,arguments:string,input:string>>, stop_reason string, complete boolean, malformed boolean, error string, input_tokens long, output_tokens long"
_COLUMNS = "stream_id text tool_calls stop_reason complete malformed error input_tokens output_tokens".split()
_KNOWN = {"choices", "usage", "delta", "finish_reason", "content", "tool_calls", "index", "id", "function", "name", "arguments", "prompt_tokens", "completion_tokens"}


class Malformed(ValueError):
    pass


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs) and len({k for k, _ in pairs} & _KNOWN) < sum(k in _KNOWN for k, _ in pairs):
        raise Malformed("a field stands twice")
    return found


def _no_constant(name: str) -> None:
    raise Malformed(name)


_OUTSIDE = re.compile(r'"(?:[^"\\]|\\.)*+"?|[\[\]{}]', re.S)


def _depth(payload: str) -> int:
    level = most = 0
    for m in _OUTSIDE.finditer(payload):
        if m[0] in "[{":
            level += 1
            most = max(most, level)
        elif m[0] in "]}":
            level -= 1
    return most


def _is(value, kind: type, least: int | None = None, most: int = (1 << 64) - 1):
    """The value, if it is of this kind; whole numbers from ``least`` to ``most``; strings that UTF-8 can hold."""
    if not isinstance(value, kind) or isinstance(value, bool):
        raise Malformed(repr(value)[:40])
    if kind is int and not (least or 0) <= value <= most:
        raise Malformed("number")
    if kind is str:
        try:
            value.encode()
        except UnicodeEncodeError:
            raise Malformed("half a surrogate pair") from None
    return value


def _optional(holder: dict, name: str, kind: type, **limits):
    value = holder.get(name)
    return None if value is None else _is(value, kind, **limits)


def read_chunk(payload: str) -> tuple[list[dict], tuple[int, int] | None]:
    """The choices (finish, text, calls) and the usage of one payload; Malformed if it has another shape."""
    if payload.count("[") + payload.count("{") > MAX_DEPTH and _depth(payload) > MAX_DEPTH:
        raise Malformed("too deep")
    try:
        chunk = _is(json.loads(payload, object_pairs_hook=_object, parse_constant=_no_constant), dict)
    except (ValueError, RecursionError) as e:
        raise Malformed(str(e)) from None
    choices = []
    for c in _is(chunk.get("choices", []), list):
        delta = _is(_is(c, dict).get("delta", {}), dict)
        calls = []
        for fragment in _is(delta.get("tool_calls", []), list):
            function = _optional(_is(fragment, dict), "function", dict) or {}
            calls.append({"index": _optional(fragment, "index", int), "id": _optional(fragment, "id", str), "name": _optional(function, "name", str), "arguments": _optional(function, "arguments", str) or ""})
        choices.append({"finish": _optional(c, "finish_reason", str), "text": _optional(delta, "content", str), "calls": calls})
    usage = _optional(chunk, "usage", dict)
    tokens = lambda name: _is(usage.get(name, 0), int, most=(1 << 32) - 1)
    return choices, None if usage is None else (tokens("prompt_tokens"), tokens("completion_tokens"))


class Fold:
    """A stream so far. ``head`` and ``calls`` have what goes on; texts and arguments are pieces that are only added to."""

    HEAD = "rest binary, size long, finish string, done boolean, malformed boolean, error string, last long, arguments long, input_tokens long, output_tokens long"

    def __init__(self, head: tuple | None = None, calls: dict[int, tuple[str, str, int]] | None = None):
        self.rest, self.size, self.finish, self.done, self.malformed, self.error, self.last, self.argument_bytes, *self.usage = head or (b"", 0, None, False, False, None, None, 0, 0, 0)
        self.rest = bytes(self.rest)
        self.calls = dict(calls or {})  # index: (id, name, bytes of arguments)
        self.text: list[str] = []
        self.pieces: list[tuple[int, str]] = []
        self.touched: set[int] = set()

    def head(self) -> tuple:
        return self.rest, self.size, self.finish, self.done, self.malformed, self.error, self.last, self.argument_bytes, *self.usage

    @property
    def ended(self) -> bool:
        return self.done or self.error is not None

    def add(self, chunk: bytes) -> None:
        if self.ended:
            return
        if self.size + len(chunk) > MAX_STREAM:
            self.rest, self.error = b"", "stream too large"
            return
        self.size += len(chunk)
        *lines, rest = (self.rest + chunk).split(b"\n")
        for line in lines:
            self._line(line)
            if self.ended:
                rest = b""
                break
        self.rest = rest

    def close(self) -> None:
        """The last line may lack its end."""
        if not self.error and self.rest:
            rest, self.rest = self.rest, b""
            self._line(rest)

    def _line(self, raw: bytes) -> None:
        try:
            line = raw.decode().strip()
        except UnicodeDecodeError:
            self.malformed = True
            return
        if not line.startswith("data:"):
            return
        payload = line[5:].strip()
        if payload == "[DONE]":
            self.done = True
        elif payload:
            try:
                choices, usage = read_chunk(payload)
            except Malformed:
                self.malformed = True
                return
            self.usage = list(usage) if usage else self.usage
            for c in choices:
                self.finish = self.finish if c["finish"] is None else c["finish"]
                if c["text"]:
                    self.text.append(c["text"])
                for fragment in c["calls"]:
                    self._call(**fragment)

    def _call(self, index: int | None, id: str | None, name: str | None, arguments: str) -> None:
        if index is None:
            index = self.last if self.last is not None and not name else max(self.calls, default=-1) + 1
        self.last = index
        own, size = self.calls.get(index, ("", "", 0)), len(arguments.encode())
        if own[2] + size > MAX_ARGUMENT or self.argument_bytes + size > MAX_ARGUMENTS:
            self.error = self.error or ("a call's arguments are too large" if own[2] + size > MAX_ARGUMENT else "arguments too large")
            return
        self.argument_bytes += size
        self.calls[index] = id or own[0], name or own[1], own[2] + size
        self.touched.add(index)
        if arguments:
            self.pieces.append((index, arguments))

    def result(self, stream_id: str, text: str | None = None, pieces: list[tuple[int, str]] | None = None) -> tuple:
        """RESULT of the whole stream, after ``close``; text and pieces: all there were, if not only those since the beginning."""
        text = "".join(self.text) if text is None else text
        given: dict[int, list[str]] = {}
        for i, piece in self.pieces if pieces is None else pieces:
            given.setdefault(i, []).append(piece)
        calls = []
        for i in sorted(self.calls):
            arguments = "".join(given.get(i, []))
            calls.append({"id": self.calls[i][0], "name": self.calls[i][1], "arguments": arguments, "input": as_input(arguments)})
        stop = "tool_use" if calls or self.finish == "tool_calls" else "max_tokens" if self.finish == "length" else "end_turn"
        if not text and not calls and self.finish is None:
            stop = None  # no response
        return (stream_id, text, calls, stop, self.done or self.finish is not None, self.malformed, self.error, *self.usage)


def as_input(arguments: str) -> str:
    """The arguments if they are JSON, else an empty object."""
    try:
        json.loads(arguments, parse_constant=_no_constant)
        return arguments
    except (ValueError, RecursionError):
        return "{}"


def fold_streams(chunks: DataFrame) -> DataFrame:
    """One row for each stream of ``chunks`` (stream_id, seq, chunk binary)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        f = Fold()
        for chunk in group.sort_values("seq")["chunk"]:
            f.add(bytes(chunk))
        f.close()
        return pd.DataFrame([f.result(group["stream_id"].iloc[0])], columns=_COLUMNS)

    return chunks.groupBy("stream_id").applyInPandas(run, RESULT)


class Folding(StatefulProcessor):
    """Keeps a stream's head as a value, its calls as a map, texts and arguments as lists that only grow."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", Fold.HEAD)
        self.calls = handle.getMapState("calls", "index long", "id string, name string, bytes long")
        self.text = handle.getListState("text", "piece string")
        self.arguments = handle.getListState("arguments", "index long, piece string")

    def _load(self) -> Fold:
        head = self.head.get() if self.head.exists() else None
        return Fold(head, {k[0]: tuple(v) for k, v in self.calls.iterator()} if head and self.calls.exists() else None)

    def _end(self, key: tuple, f: Fold) -> pd.DataFrame:
        f.close()
        text = [x[0] for x in self.text.get()] + f.text if self.text.exists() else f.text
        pieces = [tuple(x) for x in self.arguments.get()] + f.pieces if self.arguments.exists() else f.pieces
        row = f.result(key[0], "".join(text), pieces)
        for state in (self.calls, self.text, self.arguments):
            state.clear()
        return pd.DataFrame([row], columns=_COLUMNS)

    def _wake(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + SILENCE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        f = self._load()
        if f.ended:  # its row is out; what comes late is dropped
            return
        for chunk in pd.concat(list(rows)).sort_values("seq")["chunk"]:
            f.add(bytes(chunk))
        self._wake(timerValues.getCurrentProcessingTimeInMs())
        if f.ended:
            yield self._end(key, f)
        else:
            if f.text:
                self.text.appendList([(x,) for x in f.text])
            if f.pieces:
                self.arguments.appendList(f.pieces)
            for i in f.touched:
                self.calls.updateValue((i,), f.calls[i])
        self.head.update(f.head())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        f = self._load()
        if not f.ended:
            yield self._end(key, f)
        self.head.clear()

    def close(self) -> None:
        pass


def stream(chunks: DataFrame) -> DataFrame:
    """The same over a streaming frame (stream_id, seq, chunk): a row when a stream ends or stays silent for ten minutes.

    Chunks of a stream have to arrive in order; within one micro-batch they are sorted. Chunks after a stream's end are
    dropped for ten minutes. The state store has to be RocksDB, which is set unless the session names another.
    """
    spark = chunks.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(provider).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return chunks.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=Folding(), outputStructType=RESULT, outputMode="Append", timeMode="ProcessingTime")

"""The line model, byte budgets, escapes and paths."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import languages, paths, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("\n", [""]), ("a\r\r\nb\r\n", ["a\r", "b"]), ("a\n\nb", ["a", "", "b"]), ("x\r", ["x\r"]), (None, None), ("a\n\n", ["a", ""])])
def test_lines(spark, given, want):
    assert one(spark, given, text.lines("t")) == want


@pytest.mark.parametrize("size", range(0, 12))
def test_truncate_cuts_between_characters(spark, size):
    for s in ("aé日x\U0001f600z", "abc", "", "ééé", "x�é"):
        got = one(spark, s, text.truncate("t", size))
        want = s.encode()[:size].decode("utf-8", "ignore") if len(s.encode()) > size else s
        assert got == want


def test_truncate_marked(spark):
    assert one(spark, "é" * 20, text.truncate_marked("t", 20)) == "é" * 3 + text.MARKER
    assert one(spark, "é" * 10, text.truncate_marked("t", 20)) == "é" * 10


def test_trim_is_unicode_aware(spark):
    assert one(spark, "\t  a b \r\n", text.trim("t")) == "a b"


def test_once_lines(spark):
    rows = spark.createDataFrame([("a\nb\nc", "b"), ("aXaXa", "aXa"), ("b\nb", "b"), ("x", "y"), ("x", ""), ("a\nb\nc\n", "b\nc\n"), ("aa", "a")], "t string, p string")
    got = [tuple(r) for r in rows.select(*(c.alias(f"c{i}") for i, c in enumerate(text.once_lines("t", "p")))).collect()]
    assert got == [(2, 2), (1, 1), (None, None), (None, None), (None, None), (2, 3), (None, None)]


def test_sanitize_and_markdown(spark):
    assert one(spark, "a\x1b[0m‮b\n", text.sanitize("t")) == "a\\u{1b}[0m\\u{202e}b\\u{a}"
    assert one(spark, "a*b\n`c` <&> =\x07", text.markdown_inline("t")) == r"a\*b\u{a}\`c\` &lt;&amp;&gt; \=\u{7}"
    assert one(spark, "a*b\n<c>\t", text.markdown_block("t")) == "a\\*b\n&lt;c&gt;\\u{9}"
    assert one(spark, "a*b\n<c>\t", text.markdown_code("t")) == "a*b\n<c>\\u{9}"


@pytest.mark.parametrize(
    ("source", "size", "want"),
    [("plain", 5, "plain"), ("plain words", 10, "…[trunca"), ("a\x1b b", 9, "a\\u{1b} b"), ("abcdefgh\x1bijklmnopqrstuvw", 22, "abcdefgh…[truncated]"), ("é" * 20, 20, "ééé…[truncated]"), ("xyz", 2, ""), ("ab\x1bcdefghijklmnop", 20, "ab…[truncated]"), ("", 0, "")],
)
def test_bounded_sanitizing(spark, source, size, want):
    got = one(spark, source, text.sanitize_bounded("t", size))
    assert got == want and len(got.encode()) <= size


@pytest.mark.parametrize(("raw", "want"), [(b"a/b.rs", "a/b.rs"), ("ü".encode(), "ü"), (b"a b/\xff-\xc3_", "<bytes>:a%20b/%FF-%C3_")])
def test_path_keys(spark, raw, want):
    assert spark.createDataFrame([(bytearray(raw),)], "t binary").select(paths.key(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("snippet", "fence"), [("x", "```"), ("a ``` b", "~~~"), ("``` ~~~", "````"), ("```` ~~~", "~~~~")])
def test_code_fence(spark, snippet, fence):
    assert one(spark, snippet, text.code_fence("t")) == fence


@pytest.mark.parametrize(("raw", "normal", "error"), [("a/./b//c", "a/b/c", None), ("a\\b", "a/b", None), ("../a", None, "parent"), ("/a", None, "absolute"), ("c:x", None, "colon"), ("", None, "empty"), (".", None, "empty"), (None, None, "empty"), ("a..b", "a..b", None)])
def test_paths(spark, raw, normal, error):
    n, e = paths.normalized(F.col("t"))
    assert (one(spark, raw, n), one(spark, raw, e)) == (normal, error)


def test_component_order(spark):
    names = ["a-b", "a/b", "a"]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.p for r in frame.orderBy(paths.components(F.col("p"))).collect()] == ["a", "a/b", "a-b"]
    assert [r.p for r in frame.orderBy("p").collect()] == ["a", "a-b", "a/b"]


@pytest.mark.parametrize(("line", "want"), [("#!/usr/bin/env python3", "python"), ("#!/usr/bin/node", "javascript"), ("#!/bin/sh", "bash"), ("#!/usr/bin/perl -w", "perl"), ("python", None), ("#!/bin/awk", None)])
def test_first_line(spark, line, want):
    assert one(spark, line, languages.by_first_line(F.col("t"))) == want


def test_every_language_has_a_style():
    assert set(languages.EXTENSIONS) | set(languages.NAMES) | {"perl"} == set(languages.STYLE_OF)

"""Benchmark decontamination by a positional inverted index of the training texts.

``build_index`` stores every token's place: a row of the index is a *segment*, the postings of some whole documents.
A segment holds its distinct terms (64-bit word hashes, sorted), where each term's list begins, and all lists of places,
ascending. Places count on over the segment's documents with one number left free between two, so a run of consecutive
places never crosses documents.

``search`` takes benchmark items in blocks of bounded size to all segments. A window of consecutive item words starts
from the list of its rarest term in the segment, shifted to the window's start, and is intersected with the other lists,
each shifted by its own offset, from the rarest to the most frequent; all windows of a block go side by side. What is
left are exact phrase matches. Where all terms of a window stand near each other in one document, but not as the phrase,
it is a proximity match.

Nulls and empty texts have no words. Items of fewer words than a window, but not none, are one window. Benchmark rows
that share an item_id are one item; rows whose item_id is null count for hits but have no name to list. Repeated
documents are judged row by row. An empty benchmark leaves every document clean; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import lean, save
from ._words import hashed_words

WINDOW = 13
#: Tokens of a segment, apart from what its last document has beyond.
SEGMENT_TOKENS = 1 << 19
#: UTF-8 bytes of benchmark texts that are searched for at once.
BLOCK_BYTES = 16 << 20


def _index_of(token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """bounds, terms, starts, places of a segment: ``token``, the words of documents of ``n`` words each."""
    first = np.cumsum(n + 1) - (n + 1)  # one free place after each document
    place = np.arange(len(token)) + np.repeat(np.arange(len(n)), n)
    order = np.argsort(token, kind="stable")
    terms, starts = np.unique(token[order], return_index=True)
    return np.append(first, first[-1] + n[-1] + 1).astype("<i8"), terms.astype("<u8"), np.append(starts, len(token)).astype("<u4"), place[order].astype("<u4")


def _segments(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows, their words and numbers of words, for segments of about ``size`` tokens. text: the column of texts."""
    rows, words, counts, held = [], [], [], 0
    for b in batches:
        for i, j, w, at in hashed_words(b.column(text)):
            rows.append(b.slice(i, j - i))
            words.append(w)
            counts.append(np.diff(at))
            held += len(w) + j - i
            if held >= size:
                yield rows, np.concatenate(words), np.concatenate(counts)
                rows, words, counts, held = [], [], [], 0
    if rows:
        yield rows, np.concatenate(words), np.concatenate(counts)


def build_index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The index of ``docs`` (doc_id, text): (doc_ids, bounds, terms, starts, places), a row a segment."""
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType))] + [T.StructField(c, T.BinaryType()) for c in ("bounds", "terms", "starts", "places")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, counts in _segments(batches, 1, segment_tokens):
            ids = pa.concat_arrays([r.column(0) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in _index_of(words, counts))], schema.names)

    return save(docs.select("doc_id", "text").mapInArrow(lean(run), schema), "index")


class Queries:
    """A block of benchmark items: distinct terms; item words as numbers of terms; windows by their length."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        self.ids = ids
        words, sizes = [], []
        for _, _, w, at in hashed_words(pa.array(texts, pa.string())):
            words.append(w)
            sizes.append(np.diff(at))
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.terms, self.word = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        ends = np.cumsum(sizes)
        self.windows: list[tuple[int, np.ndarray, np.ndarray]] = []  # length, starts, items
        for n in np.unique(np.minimum(sizes, window)).tolist():
            own = np.flatnonzero(np.minimum(sizes, window) == n)
            if n:
                count = sizes[own] - n + 1
                item = np.repeat(own, count)
                self.windows.append((n, np.repeat(ends[own] - sizes[own], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count), item))


class Segment:
    """A segment of the index, opened for a block of items: the items' terms in it and their lists."""

    def __init__(self, q: Queries, bounds: np.ndarray, terms: np.ndarray, starts: np.ndarray, places: np.ndarray):
        self.q, self.bounds, self.starts, self.places = q, bounds, starts, places
        self.at = np.minimum(np.searchsorted(terms, q.terms), max(0, len(terms) - 1))
        there = terms[self.at] == q.terms if len(terms) else np.zeros(len(q.terms), bool)
        self.count = np.where(there, starts[self.at + 1].astype(np.int64) - starts[self.at], 0) if len(terms) else np.zeros(len(q.terms), np.int64)
        self.margin = max([n for n, _, _ in q.windows], default=0)
        # The lists of all terms once more, by place: is place p in the list of term t? (-1: in none of them)
        self.term_of = np.full(int(bounds[-1]) + 1 + 2 * self.margin, -1, np.int32)
        some = np.flatnonzero(self.count)
        self.term_of[self._lists(some) + self.margin] = np.repeat(some, self.count[some])

    def _lists(self, terms: np.ndarray) -> np.ndarray:
        """The lists of ``terms``, one after the other."""
        n = self.count[terms]
        return self.places[np.repeat(self.starts[self.at[terms]].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64)

    def exact(self, pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Exact matches as (items, places, length). About ``pairs`` places, or one list, are followed at a time."""
        q = self.q
        for n, first, item in q.windows:
            offsets = np.arange(n)
            for a in range(0, len(first), 65536):
                word = q.word[first[a : a + 65536, None] + offsets]
                df = self.count[word]
                left = np.flatnonzero(df.min(1) > 0)  # a window with a term that the segment lacks is out
                order = np.argsort(df[left], 1, kind="stable")
                word, of, rarest = word[left], item[a + left], np.take_along_axis(df[left], order[:, :1], 1)[:, 0]
                ends = np.cumsum(rarest)
                i = 0
                while i < len(left):
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + pairs, "right")))
                    w = np.repeat(np.arange(i, j), rarest[i:j])
                    start = self._lists(word[np.arange(i, j), order[i:j, 0]]) - order[w, 0]
                    for k in range(1, n):  # from the rarest list to the most frequent
                        o = order[w, k]
                        ok = self.term_of[start + o + self.margin] == word[w, o]
                        w, start = w[ok], start[ok]
                    if len(w):
                        yield of[w], start, n
                    i = j

    def near(self, slop: int, pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Proximity matches as (items, documents), some more than once. About ``pairs`` places, or one list, are followed at a time."""
        q, span = self.q, int(self.bounds[-1]) + 1
        some = np.flatnonzero(self.count)
        keys = np.append(np.repeat(some, self.count[some]) * span + self._lists(some), np.iinfo(np.int64).max)  # by term and place
        for n, first, item in q.windows:
            offsets = np.arange(n)
            for a in range(0, len(first), 65536):
                word = q.word[first[a : a + 65536, None] + offsets]
                df = self.count[word]
                left = np.flatnonzero(df.min(1) > 0)
                order = np.argsort(df[left], 1, kind="stable")
                word, df = np.take_along_axis(word[left], order, 1), np.take_along_axis(df[left], order, 1)  # from the rarest to the most frequent
                of = item[a + left]

                def close(row: np.ndarray, w: np.ndarray, place: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
                    """Rows and documents of those places that have all terms of their row's window within ``reach`` in their document.
                    w: windows of rows."""
                    doc = np.searchsorted(self.bounds, place, "right") - 1
                    low, high = np.maximum(place - reach, self.bounds[doc]), np.minimum(place + reach, self.bounds[doc + 1] - 1)
                    for k in range(n):
                        term = word[w[row], k] * span  # noqa: B023
                        ok = keys[np.searchsorted(keys, term + low)] <= term + high
                        row, doc, low, high = row[ok], doc[ok], low[ok], high[ok]
                    return row, doc

                # Of the rarest term's documents those that may match; then around each term, so that it does not
                # matter which term is the rarest in this segment.
                for i, j in _runs(df[:, 0], pairs):
                    w, doc = close(np.repeat(np.arange(i, j), df[i:j, 0]), np.arange(len(left)), self._lists(word[i:j, 0]), 2 * slop)
                    w, doc = np.divmod(np.unique(w * len(self.bounds) + doc), len(self.bounds))
                    matched = np.zeros(len(w), bool)
                    for k in range(n):
                        row = np.flatnonzero(~matched & (word[w, k, None] != word[w, :k]).all(1))  # a term once
                        low = np.searchsorted(keys, word[w[row], k] * span + self.bounds[doc[row]])
                        many = np.searchsorted(keys, word[w[row], k] * span + self.bounds[doc[row] + 1]) - low
                        for x, y in _runs(many, pairs):
                            at = np.repeat(low[x:y] - (np.cumsum(many[x:y]) - many[x:y]), many[x:y]) + np.arange(int(many[x:y].sum()))
                            matched[close(np.repeat(row[x:y], many[x:y]), w, keys[at] % span, slop)[0]] = True
                    if matched.any():
                        yield of[w[matched]], doc[matched]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about ``most`` in all, or one row."""
    ends, i = np.cumsum(sizes), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


class Found:
    """What all blocks found in a segment."""

    def __init__(self, bounds: np.ndarray):
        n = len(bounds) - 1
        self.bounds, self.edge = bounds, np.zeros(int(bounds[-1]) + 2, np.int32)
        self.exact: list[set] = [set() for _ in range(n)]
        self.near: list[set] = [set() for _ in range(n)]

    def add(self, segment: Segment, slop: int) -> None:
        ids = segment.q.ids
        for item, at, n in segment.exact():
            np.add.at(self.edge, at, 1)
            np.add.at(self.edge, at + n, -1)
            for d, i in np.unique(np.stack([np.searchsorted(self.bounds, at, "right") - 1, item]), axis=1).T.tolist():
                if ids[i] is not None:
                    self.exact[d].add(ids[i])
        for item, doc in segment.near(slop) if slop else ():
            for d, i in np.unique(np.stack([doc, item]), axis=1).T.tolist():
                if ids[i] is not None:
                    self.near[d].add(ids[i])

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """Is a place hit? And the number of hits of each document."""
        hit = np.cumsum(self.edge)[: int(self.bounds[-1]) + 1] > 0
        run = np.concatenate([[0], np.cumsum(hit)])
        return hit, run[self.bounds[1:]] - run[self.bounds[:-1]]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcast blocks of (ids as strings, texts)."""
    sc = benchmark.sparkSession.sparkContext
    blocks, ids, texts, size = [], [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") + 16
        if size >= block_bytes:
            blocks.append(sc.broadcast((ids, texts)))
            ids, texts, size = [], [], 0
    if ids:
        blocks.append(sc.broadcast((ids, texts)))
    return blocks


def _opener(blocks: list, window: int):
    """A function that goes through the blocks as queries. One block is made once a task; of more, one is held at a time."""
    kept: list[Queries] = []

    def run() -> Iterator[Queries]:
        for block in blocks:
            if kept:
                yield kept[0]
                continue
            q = Queries(*block.value, window)
            if len(blocks) == 1:
                kept.append(q)
            yield q

    return run


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of the index: (doc_id, n_words, n_hit, items, near_items, spans).

    benchmark: (item_id, text). items: distinct ids of items with an exact window, sorted as strings; near_items: ids
    of items with a proximity match and no exact window in the document (all terms of a window within ``slop`` places
    of one of them; 0: not looked for). spans: first and last word of each run of hit words, from 0.

    The benchmark is read in blocks of about ``block_bytes``; each is sent to the tasks as a file of that size, and
    the tasks take one after the other to each segment.
    """
    blocks = _blocks(benchmark, block_bytes)
    kind = index.schema["doc_ids"].dataType.elementType
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near_items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _opener(blocks, window)
        for b in batches:
            for r in range(b.num_rows):
                names = b.column(0).slice(r, 1).flatten()
                bounds, *lists = (np.frombuffer(b.column(k)[r].as_buffer(), t) for k, t in ((1, "<i8"), (2, "<u8"), (3, "<u4"), (4, "<u4")))
                found = Found(bounds)
                for q in open_():
                    found.add(Segment(q, bounds, *lists), slop)
                hit, n_hit = found.hits()
                exact, near = found.exact, found.near
                flips = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
                spans: list[list] = [[] for _ in range(len(names))]
                of = np.searchsorted(bounds, flips[:, 0], "right") - 1
                for d, (x, y) in zip(of.tolist(), (flips - bounds[of][:, None]).tolist(), strict=True):
                    spans[d].append({"first": x, "last": y - 1})
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pa.array(np.diff(bounds) - 1),
                        pa.array(n_hit),
                        pa.array([sorted(x) for x in exact], pa.list_(pa.string())),
                        pa.array([sorted(y - x) for x, y in zip(exact, near, strict=True)], pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    ],
                    schema.names,
                )

    return index.mapInArrow(lean(run), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): contaminated if at least 1/share of the words are hit.

    slop: over 0, proximity matches are looked for too, and ``near_items`` (see ``search``) is a further column.
    """
    found = search(build_index(docs), benchmark, window, slop)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *(["near_items"] if slop else []),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, segment_tokens: int = SEGMENT_TOKENS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated (see ``contamination``).

    Each row is judged by its own text, whatever its id: segments are built as for ``build_index``, searched and
    dropped, since the rows stand beside them.
    """
    blocks = _blocks(benchmark, block_bytes)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _opener(blocks, window)
        for rows, words, counts in _segments(batches, place, segment_tokens):
            bounds, *lists = _index_of(words, counts)
            found = Found(bounds)
            for q in open_():
                found.add(Segment(q, bounds, *lists), 0)
            n_hit = found.hits()[1]
            clean, at = (n_hit == 0) | (share * n_hit < counts), 0
            for r in rows:
                yield r.filter(pa.array(clean[at : at + r.num_rows]))
                at += r.num_rows

    return docs.mapInArrow(lean(run), docs.schema)

"""Language-model scores of whole documents: a gated recurrent network with a class-factored output.

Words are runs between white space with A-Z folded, each document ends with an end token. The most frequent ``HEAD``
words of the training part, counted over the whole corpus, are *head* words; all others fall into ``TAIL`` classes by
their last letters. The network reads a word (or its tail class) a step. Its output is factored: first a class, then,
for a head class, a word by a softmax of that class; for a tail class, a word by its share of the class's training
count (add 0.1, one share for all unseen words). So every word of a text has a probability.

Counts cover all training documents; each chunk of documents gets the totals of its own words (``_totals``). The network
is fitted on all training documents too, in rounds: the tasks of a round start from the same parameters, go through their
chunks by truncated backpropagation in numpy, and the mean of what they end with, weighted by tokens, is where the next
round starts. A pass takes each chunk in one of its rounds; a corpus of less than ``PASS_TOKENS`` is passed up to six
times. Only parameters reach the driver. Scoring carries the state from window to window to a document's end, many
documents side by side.

Null and empty texts are the end token alone. Rows are scored one by one, repeated rows too; a null doc_id is training.
With no training document at all, N = V = 0 and the network is a constant. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _totals
from ._io import lean, save, slices
from ._words import KINDS, WORD_HASH, steps, text_bytes, word_spans

HEAD, GROUP, TAIL = 1024, 64, 64
HIDDEN = 32
#: Rounds of training at least; tokens that are read at least, by passes over a small corpus; sums sent to the driver.
ROUNDS, PASS_TOKENS, SUMS = 4, 2_000_000, 16
#: Tokens of a chunk of documents, apart from what its last document has beyond.
CHUNK_TOKENS = 2 << 20
SPAN = 32
#: Lanes of documents scored side by side; rows of a softmax.
LANES, ROWS = 512, 1024
END = np.uint64(1)
LOG10 = float(np.log(10.0))


def _tail_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A class for each word by its last two letters and whether punctuation follows them."""
    fold = np.arange(256, dtype=np.int64)
    fold[0x41:0x5B] += 32
    last = ends - 1
    mark = ~KINDS["alnum"][data[last]]
    last = np.maximum(last - mark, starts)
    a, b = fold[data[last]], fold[data[np.maximum(last - 1, starts)]]
    return ((a * 31 + b * 17) % (TAIL // 2) * 2 + mark).astype(np.uint8)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, the texts' bounds, and each token's tail class."""
    data, bounds = text_bytes(column)
    words, sizes, shapes = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.uint8)]
    for i, j in steps(bounds):
        part = data[bounds[i] : bounds[j]]
        starts, ends, at = word_spans(part, bounds[i : j + 1] - bounds[i], "spaced")
        words.append(np.insert(WORD_HASH.spans(part, starts, ends), at[1:], END))
        shapes.append(np.insert(_tail_class(part, starts, ends) if len(starts) else np.zeros(0, np.uint8), at[1:], 0))
        sizes.append(np.diff(at) + 1)
    return np.concatenate(words), np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64), np.concatenate(shapes)


# --- the network ---------------------------------------------------------------------------------------------------


class Network:
    """Parameters: ``x`` input rows (word or tail class or start) for the state proposed and the two gates; ``u`` recurrent,
    for the two gates and the state proposed; ``c``, ``cb`` class softmax; ``w``, ``wb`` word softmax of each head class."""

    def __init__(self, head: int, seed: int = 3):
        self.head = head
        self.groups = -(-head // GROUP)
        self.start = self.groups * GROUP + TAIL
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        apart = lambda v: np.ascontiguousarray(v.reshape(len(v), 3, -1).transpose(1, 0, 2))  # noqa: E731  by gates
        h = HIDDEN
        self.p = {"x": np.roll(apart(draw(self.start + 1, 3 * h)), 1, 0), "u": apart(draw(h, 3 * h)), "c": draw(h, self.groups + TAIL) * 0, "cb": np.zeros(self.groups + TAIL, np.float32), "w": draw(self.groups, h, GROUP) * 0, "wb": np.full((self.groups, GROUP), -20.0, np.float32)}

    def for_steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Input rows, one kind's after the other's, and recurrent weights, with what ``step`` wants before an
        exponential: 1 / (1 + exp(-v)) for the gates, 1 - 2 / (1 + exp(2 v)) for the state proposed."""
        by = np.array([2, -1, -1], self.p["u"].dtype)[:, None, None]
        return (self.p["x"] * by).reshape(-1, HIDDEN), self.p["u"] * by[::-1]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Rows of the input table, of each kind."""
        return x + (np.arange(3) * (self.start + 1)).reshape(3, *[1] * x.ndim)

    @staticmethod
    def step(given: np.ndarray, u: np.ndarray, h: np.ndarray, gates: np.ndarray, c: np.ndarray, new: np.ndarray) -> None:
        """given: input rows by kind. Filled in: the two gates and twice the proposal's recurrent part, the proposal, the new state."""
        np.matmul(h, u, out=gates)
        both = gates[:2]
        both += given[1:]
        np.exp(both, out=both)
        both += 1
        np.reciprocal(both, out=both)
        np.multiply(both[1], gates[2], out=c)
        c += given[0]
        np.exp(c, out=c)
        c += 1
        np.divide(-2, c, out=c)
        c += 1
        np.subtract(h, c, out=new)
        new *= both[0]
        new += c

    def classes(self, y: np.ndarray) -> np.ndarray:
        """Classes of targets: head word i is i, tail class k is groups * GROUP + k."""
        return np.where(y < self.groups * GROUP, y // GROUP, y - self.groups * (GROUP - 1))

    def log_probability(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log of the class's and, for a head class, the word's probability. grads: gradients are added; gets ``h``."""
        p, cls, n = self.p, self.classes(y), HIDDEN
        safe = max(float(np.abs(p[m]).sum(-2).max(initial=0) + np.abs(p[b]).max(initial=0)) for m, b in (("c", "cb"), ("w", "wb"))) < 80  # states lie in -1..1
        c, w = np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["w"], p["wb"][:, None]], 1)
        order = np.argsort(cls.astype(np.int16), kind="stable")  # head classes come first, side by side
        cls, y = cls[order], y[order]
        edge = np.searchsorted(cls, np.arange(self.groups + 1)).tolist()
        states = np.ones((len(h), n + 1), h.dtype)  # a one for the bias
        states[:, :n] = np.take(h, order, 0)
        out, got = np.empty(len(h), h.dtype), np.empty(edge[-1], h.dtype)
        back, more = (np.empty((k, n) if grads is not None else 0, h.dtype) for k in (len(h), edge[-1]))

        def softmax(at: np.ndarray, low: int, high: int, m: np.ndarray, out: np.ndarray, back: np.ndarray, g: tuple[np.ndarray, np.ndarray] | None) -> None:
            """Logarithms at the columns ``at`` of states low to high, ROWS at a time; and, if gradients are wanted, what the states' and m's are."""
            ones = np.ones(m.shape[1], m.dtype)
            for i in range(low, high, ROWS):
                some = slice(i, min(high, i + ROWS))
                e = states[some] @ m
                if not safe:
                    e -= e.max(1, keepdims=True)
                flat, target = e.reshape(-1), at[some] + np.arange(0, e.size, e.shape[1])
                picked = flat[target]
                np.exp(e, out=e)
                total = e @ ones
                np.subtract(picked, np.log(total), out=out[some])
                if g is not None:  # the logits' gradients
                    e *= (1 / total)[:, None]
                    flat[target] -= 1
                    np.matmul(e, m[:n].T, out=back[some])
                    d = e.T @ states[some]
                    g[0][...] += d[:, :n].T
                    g[1][...] += d[:, n]

        softmax(cls, 0, len(cls), c, out, back, (grads["c"], grads["cb"]) if grads is not None else None)
        words = y % GROUP
        for k in range(self.groups):
            if edge[k] < edge[k + 1]:
                softmax(words, edge[k], edge[k + 1], w[k], got, more, (grads["w"][k], grads["wb"][k]) if grads is not None else None)
        out[: edge[-1]] += got
        if grads is not None:
            back[: edge[-1]] += more
            grads["h"] = np.empty_like(back)
            grads["h"][order] = back
        unsorted = np.empty_like(out)
        unsorted[order] = out
        return unsorted


def passes_for(size: int) -> int:
    return min(6, max(1, PASS_TOKENS // max(1, size)))


def biases(net: Network, counts: np.ndarray) -> None:
    """Start from the counts of head words and tail classes in the whole training part."""
    p = net.p
    smooth = counts.astype(np.float64) + 0.5
    by_class = np.concatenate([smooth[: net.groups * GROUP].reshape(net.groups, GROUP).sum(1), smooth[net.groups * GROUP :]])
    p["cb"][:] = np.log(by_class / by_class.sum())
    word = smooth[: net.groups * GROUP].reshape(net.groups, GROUP)
    p["wb"][:] = np.log(word / word.sum(1, keepdims=True))
    p["wb"].reshape(-1)[net.head :] = -20.0


def fit(net: Network, texts: list[np.ndarray], counts: np.ndarray | None, passes: int | None = None, lanes: int = 32, span: int = 16, rate: float = 6e-3, decay: bool = True, moments: dict | None = None) -> Network:
    """texts: model ids of documents. counts: see ``biases``; None: the parameters are gone on with.

    All texts in one shuffled row are cut into lanes of the same length, side by side. decay: the rate falls to a tenth.
    moments: of the gradients, from call to call."""
    p = net.p
    if counts is not None:
        biases(net, counts)
    if not texts:
        return net
    moments = {} if moments is None else moments
    if not moments:
        moments.update({k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}, turn=0)
    rng, done, n = np.random.default_rng(5), 0, HIDDEN
    size = sum(map(len, texts))
    passes = passes or passes_for(size)
    width = -(-size // lanes)
    planned = passes * -(-width // span)
    for _ in range(passes):
        order = rng.permutation(len(texts))
        row = np.full(lanes * width, -1, np.int16)
        row[:size] = np.concatenate([texts[i] for i in order])
        begins = np.zeros(lanes * width, bool)
        begins[np.cumsum([0, *(len(texts[i]) for i in order[:-1])])] = True
        previous = np.concatenate([np.array([net.start], np.int16), row[:-1]])
        previous[begins | (previous < 0)] = net.start
        y, x, fresh = (v.reshape(lanes, width) for v in (row, previous, begins))
        h, start = (np.zeros((lanes, n), p["u"].dtype) for _ in range(2))
        kept = lambda *k: np.empty((*k, lanes, n), p["u"].dtype)
        first, c, states, gates, d = kept(span), kept(span), kept(span), kept(3, span), kept(3, span)
        given, d_un, rest, side = kept(3), kept(), kept(), np.empty((lanes, 3, n), p["u"].dtype)  # of one step, so that they stay in the cache
        pairs = np.result_type(d.dtype, np.complex64)  # two numbers are added at a time where rows go to the table's
        places = np.arange((net.start + 1) * (n // 2)).reshape(-1, n // 2)
        for t0 in range(0, width, span):
            grads = {k: np.zeros_like(v) for k, v in p.items() if k not in "xu"}
            read, new = net.rows(x[:, t0 : t0 + span].T.astype(np.int64)), fresh[:, t0 : t0 + span].T
            times, begun = len(new), new.any(1).tolist()
            table, u = net.for_steps()
            np.copyto(start, h)  # the states' places are filled again
            h, before = start, []
            with np.errstate(over="ignore"):
                for k in range(times):
                    if begun[k]:
                        np.copyto(first[k], h)
                        h = first[k]
                        h[new[k]] = 0
                    before.append(h)
                    h = states[k]
                    np.take(table, read[:, k], 0, given, "clip")
                    net.step(given, u, before[k], gates[:, k], c[k], h)
            target = y[:, t0 : t0 + span].T.reshape(-1).astype(np.int64)
            real = np.flatnonzero(target >= 0)
            flat = states[:times].reshape(-1, n)
            if len(real) == len(target):
                net.log_probability(flat, target, grads)
                dh_out = grads.pop("h")
            else:
                net.log_probability(flat[real], target[real], grads)
                dh_out = np.zeros_like(flat)
                dh_out[real] = grads.pop("h")
            dh_out = dh_out.reshape(times, lanes, n)
            dh, one = np.zeros((lanes, n), np.float32), np.float32(1)
            # d: of the proposal, of the gates; d_un: of the proposal's recurrent part. The second gate's is twice what it should be.
            halves = np.array([1, 0.5, 1], d.dtype)[:, None, None]
            back, dx = (p["u"] * halves).transpose(0, 2, 1).reshape(-1, n), np.zeros((3, places.size), pairs)
            du = np.zeros_like(back)
            for k in range(times - 1, -1, -1):
                z, r, un = gates[:, k]
                dh += dh_out[k]
                np.subtract(one, z, out=rest)
                rest *= dh
                d_c, d_z, d_r = d[:, k]
                np.multiply(c[k], c[k], out=d_c)
                np.subtract(one, d_c, out=d_c)
                d_c *= rest
                np.subtract(states[k], c[k], out=d_z)
                d_z *= rest
                np.multiply(d_c, r, out=d_un)
                np.subtract(one, r, out=d_r)
                d_r *= un
                d_r *= d_un
                dh *= z
                for j, part in enumerate((d_z, d_r, d_un)):
                    side[:, j] = part
                dh += side.reshape(lanes, -1) @ back
                if begun[k]:
                    dh[new[k]] = 0
                du += side.reshape(lanes, -1).T @ before[k]
            to = np.take(places, read[0].reshape(-1), 0).reshape(-1)
            for whole, part in zip(dx, d[:, :times].reshape(3, -1).view(pairs), strict=True):
                np.add.at(whole, to, part)
            grads["u"] = np.ascontiguousarray(du.reshape(3, n, n).transpose(0, 2, 1)) * halves
            grads["x"] = dx.view(d.dtype).reshape(p["x"].shape)
            grads["x"][2] *= np.float32(0.5)
            moments["turn"] += 1
            turn, done = moments["turn"], done + 1
            scale = 64 / max(1, len(real))
            now = rate * max(0.1, 1 - done / planned) if decay else rate
            now, most, tenth = (np.float32(k) for k in (now * np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn), 1 / scale, scale / 10))
            for name, g in grads.items():
                whole = [v.reshape(-1) for v in (p[name], g, *moments[name])]
                for i in range(0, g.size, 1 << 14):  # what stays in the cache
                    value, g, m, v = (w[i : i + (1 << 14)] for w in whole)
                    np.minimum(g, most, out=g)
                    np.maximum(g, -most, out=g)
                    g *= tenth
                    m *= np.float32(0.9)
                    m += g
                    g *= g
                    v *= np.float32(0.99)
                    v += g
                    np.sqrt(v, out=g)
                    g += np.float32(1e-6)
                    np.divide(m, g, out=g)
                    g *= now
                    value -= g
    return net


def log_likelihoods(net: Network, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each document's classes and head words; the state goes on to a document's end.

    Documents, the longest first, are dealt to the lane that is the shortest so far, and stand there one after the other."""
    n = np.diff(at)
    if not len(n):
        return np.zeros(0)
    lanes = [(0, k) for k in range(min(LANES, len(n)))]
    order, whose = np.argsort(-n, kind="stable"), []
    for size in n[order].tolist():
        length, k = lanes[0]
        whose.append(k)
        heapq.heapreplace(lanes, (length + size, k))
    rank = np.empty(len(lanes), np.int64)  # the longest lane first
    rank[[k for _, k in sorted(lanes, reverse=True)]] = np.arange(len(lanes))
    lane = rank[whose]
    order, lane = order[by_lane := np.argsort(lane, kind="stable")], lane[by_lane]
    size = n[order]
    begin = np.cumsum(size) - size
    y = ids[np.arange(len(ids)) + np.repeat(at[:-1][order] - at[0] - begin, size)].astype(np.int16)
    x = np.concatenate([y[:1], y[:-1]])
    x[begin] = net.start
    fresh = np.zeros(len(y), bool)
    fresh[begin] = True
    first = begin[np.flatnonzero(np.diff(lane, prepend=-1))]
    end = np.append(first[1:], len(y))
    length = end - first
    out = np.zeros(len(y))
    table, u = net.for_steps()
    gates, c, states, before = (np.empty((k, len(first), HIDDEN), u.dtype) for k in (3, 1, SPAN, 1))
    h, t0 = before[0], 0
    with np.errstate(over="ignore"):
        while t0 < length[0]:
            active = int(np.searchsorted(-length, -t0, "left"))  # lanes with more than t0 tokens; the fewer, the more steps at once
            place = first[:active] + np.arange(t0, min(t0 + SPAN * (len(first) // active), int(length[0])))[:, None]
            t0 += len(place)
            inside = place < end[:active]
            if not inside.all():
                place = np.minimum(place, len(y) - 1)
            read, new = net.rows(x[place].astype(np.int64)), fresh[place] & inside
            begun, made = new.any(1).tolist(), states.reshape(-1, HIDDEN)[: place.size].reshape(*place.shape, HIDDEN)
            for k in range(len(place)):
                h = h[:active]
                if begun[k]:
                    before[0, :active] = h
                    h = before[0, :active]
                    h[new[k]] = 0
                net.step(np.take(table, read[:, k], 0), u, h, gates[:, :active], c[0, :active], made[k])
                h = made[k]
            before[0, :active] = h  # the states' places are filled again
            h = before[0]
            if inside.all():
                out[place] = net.log_probability(made.reshape(-1, HIDDEN), y[place].reshape(-1).astype(np.int64)).reshape(place.shape)
            else:
                place = place[inside]
                out[place] = net.log_probability(made[inside], y[place].astype(np.int64))
    back = np.empty(len(n))
    back[order] = np.add.reduceat(out, begin)
    return back


# --- the jobs ------------------------------------------------------------------------------------------------------


def chunked(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """A written table with a row for each chunk of ``docs`` (doc_id, text, held)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, size = TaskContext.get().partitionId(), 0, 0
        names, held, words, sizes, shapes = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            w, n, h = np.concatenate(words), np.concatenate(sizes), np.concatenate(held)
            coded = pa.array(w).dictionary_encode()
            vocab, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            order = np.argsort(vocab)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            vocab, index = vocab[order], rank[index]
            shape = np.zeros(len(vocab), np.uint8)
            shape[index] = np.concatenate(shapes)
            counts = np.bincount(index[~np.repeat(h, n)], minlength=len(vocab))
            ids = pa.concat_arrays(names)
            blobs = (h.astype(np.uint8), np.concatenate([[0], np.cumsum(n)]).astype("<i8"), index.astype("<u4"), vocab.astype("<u8"), counts.astype("<u4"), shape)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], schema.names)

        for b in slices(batches):
            w, at, s = tokens(b.column(1))
            flags = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            i = 0
            while i < b.num_rows:
                j = min(b.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + chunk_tokens - size))))
                names.append(b.column(0).slice(i, j - i))
                held.append(flags[i:j])
                words.append(w[at[i] : at[j]])
                shapes.append(s[at[i] : at[j]])
                sizes.append(np.diff(at[i : j + 1]))
                size += int(at[j] - at[i])
                i = j
                if size >= chunk_tokens:
                    yield flush()
                    names, held, words, sizes, shapes = [], [], [], [], []
                    size, k = 0, k + 1
        if names:
            yield flush()

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind))] + [T.StructField(c, T.BinaryType()) for c in ("held", "at", "index", "keys", "counts", "more")])
    return save(docs.mapInArrow(lean(run), schema), "chunks")


def _train(net: Network, table: DataFrame, model_ids, size: int) -> None:
    """Fit ``net`` on the training documents of all chunks of ``table``. size: their tokens."""
    passes = passes_for(size)
    parts = -(-ROUNDS // passes)
    lanes = int(np.clip(size >> 17, 32, 256))  # a small corpus needs more steps
    names, shapes = list(net.p), [v.shape for v in net.p.values()]
    edges = np.cumsum([0, *(v.size for v in net.p.values())])
    schema = "task long, tokens long, parameters binary"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of tokens and of parameters."""
        tokens_, total = 0, np.zeros(int(edges[-1]))
        for b in batches:
            tokens_ += sum(b.column(1).to_pylist())
            for x in b.column(2):
                total += np.frombuffer(x.as_buffer(), "<f8")
        if tokens_:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([tokens_]), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["task", "tokens", "parameters"])

    def round_of(rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, moments, n = Network(net.head), {}, 0
            own.p = {k: v.copy() for k, v in net.p.items()}
            for b in batches:
                for r in range(b.num_rows):
                    held, at, index, keys, shape = (np.frombuffer(b.column(k)[r].as_buffer(), t) for k, t in enumerate((np.uint8, "<i8", "<u4", "<u8", np.uint8)))
                    ids = model_ids(keys, shape).astype(np.int16)
                    texts = [ids[index[at[i] : at[i + 1]]] for i in np.flatnonzero(held == 0).tolist()]
                    count = sum(map(len, texts))
                    fit(own, texts, None, 1, int(np.clip(count // 1024, 8, lanes)), rate=rate, decay=False, moments=moments)
                    n += count
            if n:
                flat = np.concatenate([v.reshape(-1) for v in own.p.values()]).astype("<f8") * n
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([flat.tobytes()], pa.binary())], ["task", "tokens", "parameters"])

        return run

    for k in range(passes * parts):
        some = table.filter(F.expr(f"pmod(xxhash64(chunk), {parts}) = {k % parts}")) if parts > 1 else table
        rate = 6e-3 * max(0.1, 1 - k / (passes * parts))
        sums = some.select("held", "at", "index", "keys", "more").mapInArrow(lean(round_of(rate)), schema).repartition(SUMS, "task").mapInArrow(lean(add_up), schema).collect()
        n = sum(r["tokens"] for r in sums)
        if n:
            mean = (sum(np.frombuffer(r["parameters"], "<f8") for r in sums) / n).astype(np.float32)
            net.p = {x: mean[i:j].reshape(shape) for x, i, j, shape in zip(names, edges[:-1], edges[1:], shapes, strict=True)}


def score(docs: DataFrame, held: str = "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    held: SQL condition; documents that meet it are not learned from.
    """
    docs = docs.select("doc_id", "text").withColumn("held", F.coalesce(F.expr(held), F.lit(False)))
    table = chunked(docs, chunk_tokens)
    n_keys = table.agg(F.sum(F.expr("length(keys) div 8"))).first()[0] or 0

    def summary(keys: np.ndarray, total: np.ndarray, shape: np.ndarray) -> bytes:
        """Sums by tail class of the bucket's words seen in training: words, tokens; then its most frequent words."""
        seen = total > 0
        words, count = np.bincount(shape[seen], minlength=TAIL), np.bincount(shape, total, TAIL)
        top = np.argsort(-total, kind="stable")[:HEAD]
        top = top[total[top] > 0]
        return np.concatenate([words.astype(np.int64), count.astype(np.int64), np.stack([keys[top].view(np.int64), total[top], shape[top].astype(np.int64)], 1).reshape(-1)]).astype("<i8").tobytes()

    found = save(_totals.totals(table, _totals.buckets_for(n_keys), lambda t: t.astype("<i8"), summary), "totals")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL)), pa.array(v[:TAIL]), pa.array(v[TAIL : 2 * TAIL]), pa.nulls(TAIL, pa.int64())], ["shape", "words", "count", "key"])
                k, c, s = v[2 * TAIL :].reshape(-1, 3).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.nulls(len(k), pa.int64()), pa.array(c), pa.array(k)], ["shape", "words", "count", "key"])

    facts = save(found.filter("stats is not null").select("stats").mapInArrow(lean(sums), "shape long, words long, count long, key long"), "facts")
    words, mass = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in facts.filter("key is null").groupBy("shape").agg(F.sum("words").alias("words"), F.sum("count").alias("count")).collect():
        words[r["shape"]], mass[r["shape"]] = r["words"], r["count"]
    n_train, v_train = int(mass.sum()), int(words.sum())
    head = facts.filter("key is not null").orderBy(F.desc("count"), "key").limit(HEAD).collect()
    head_count = np.array([r["count"] for r in head], np.int64)
    for r in head:
        words[r["shape"]] -= 1
        mass[r["shape"]] -= r["count"]
    head_keys = np.array([r["key"] for r in head], np.int64).view(np.uint64)
    by_key = np.argsort(head_keys)
    net = Network(len(head_keys))
    tail_at = net.groups * GROUP

    def model_ids(keys: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = tail_at + shape.astype(np.int64)
        if len(head_keys):
            at = np.minimum(np.searchsorted(head_keys[by_key], keys), len(head_keys) - 1)
            out = np.where(head_keys[by_key][at] == keys, by_key[at], out)
        return out

    counts = np.zeros(tail_at + TAIL, np.int64)
    counts[: len(head_keys)], counts[tail_at:] = head_count, mass
    biases(net, counts)
    _train(net, table, model_ids, n_train)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                names = b.column(0).slice(r, 1).flatten()
                flags, at, index, keys, shape = (np.frombuffer(b.column(k)[r].as_buffer(), t) for k, t in ((1, np.uint8), (2, "<i8"), (3, "<u4"), (4, "<u8"), (5, np.uint8)))
                count = np.frombuffer(b"".join(b.column(6)[r].as_py()), "<i8")
                ids = model_ids(keys, shape)
                base = np.log10((count + 0.1) / (n_train + 0.1 * (v_train + 1)))
                within = np.where(ids >= tail_at, np.log10((count + 0.1) / (mass + 0.1 * (words + 1))[shape]), 0.0)
                add = lambda v: np.add.reduceat(v[index], at[:-1])  # noqa: B023, E731  every document has an end token
                ll = log_likelihoods(net, ids[index], at) / LOG10
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(flags.astype(bool)), pa.array(np.diff(at)), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(names), n_train, np.int64)), pa.array(add(base)), pa.array(ll + add(within))],
                    schema.names,
                )

    return table.select("chunk", "ids", "held", "at", "index", "keys", "more").join(_totals.by_chunk(found), "chunk").drop("chunk").mapInArrow(lean(run), schema)

"""Decontamination, licenses, quality, language model and near-duplicates against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, licenses, lm, neardup, quality

from .conftest import EDGES, THUE, prose

WORD, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, rule=WORD):
    return rule.findall((text or "").translate(LOW))


def brute_contamination(docs, bench):
    out = []
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            n = min(13, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        items |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


BENCH = [(1, prose(40, 50)), (2, "two three four"), (3, None), (4, ""), (None, "no id here"), (10, "one"), (10, prose(20, 51)), (5, prose(13, 52)), (11, THUE[0]), (12, THUE[1] + " and " + THUE[0])]


def test_contamination_equals_brute_force(spark, edges):
    planted = [(20, prose(30, 1) + " " + BENCH[0][1] + ". " + prose(30, 2)), (21, " ".join(BENCH[0][1].split()[5:18])), (22, " ".join(BENCH[0][1].split()[5:17])), (23, prose(500, 3) + " " + BENCH[7][1]), (24, "one one one"), (25, THUE[1]), (26, THUE[1] + " and " + THUE[1])]
    docs = EDGES + planted
    frame = edges.select("doc_id", "text", F.lit(1).alias("terms"), F.lit("x").alias("items")).union(spark.createDataFrame([(*x, 1, "x") for x in planted], "doc_id long, text string, terms int, items string"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(frame, bench).collect()), key=str)
    assert got == brute_contamination(docs, BENCH)
    # Several blocks and segments give the same.
    index = decontaminate.build_index(frame, segment_tokens=50)
    blocks = decontaminate.search(index, bench, block_bytes=100)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in blocks.collect()) == sorted((str(x[0]), x[1], x[2]) for x in got)
    assert decontaminate.keep_clean(frame, bench).columns == frame.columns
    for size in (50, 1 << 19):
        kept = decontaminate.keep_clean(frame, bench, segment_tokens=size, block_bytes=100).collect()
        assert sorted(map(str, ((r.doc_id, len(words(r.text))) for r in kept))) == sorted(str((x[0], x[1])) for x in got if not x[5])
    spans = {r.doc_id: r.spans for r in blocks.collect()}
    assert [tuple(s) for s in spans[20]] == [(30, 69)]


def test_contamination_of_empty_tables(spark, edges, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, empty).count() == 0
    assert decontaminate.contamination(edges, empty).filter("contaminated or n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "z " * 40 + "beta gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (list(r["items"]), list(r.near_items)) for r in decontaminate.search(decontaminate.build_index(docs), bench, slop=6).collect()}
    assert got[3][0] == ["1"] and got[2] == ([], [])
    one = {r.doc_id: (list(r["items"]), list(r.near_items)) for r in decontaminate.search(decontaminate.build_index(docs.filter("doc_id = 1")), bench, slop=6).collect()}
    assert one[1] == ([], ["1"])


def test_proximity_beside_exact_matches(spark):
    """An exact match in one document leaves the proximity matches of the others in its segment."""
    texts = [(1, "alpha x beta y gamma"), (2, "alpha " + "z " * 40 + "beta gamma"), (3, "alpha beta gamma"), (4, "gamma q beta alpha"), (5, "alpha beta gamma " + "z " * 40 + "gamma beta alpha"), (6, "alpha beta"), (7, "alpha z z z z gamma z z z z beta"), (8, "gamma " * 9 + "alpha z z z z beta z z z z gamma")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")

    def near(text):
        w = words(text)
        return any(w[k : k + 3] == ["alpha", "beta", "gamma"] for k in range(len(w))), any(all(x in w[max(0, k - 6) : k + 7] for x in ("alpha", "beta", "gamma")) for k in range(len(w)) if w[k] in ("alpha", "beta", "gamma"))

    want = {i: ["1"] if near(t) == (False, True) else [] for i, t in texts}
    assert want[1] == want[4] == ["1"]
    rows = decontaminate.contamination(docs, bench, slop=6).collect()
    assert {r.doc_id: list(r.near_items) for r in rows} == want and {r.doc_id: r.n_items for r in rows} == {i: int(i in (3, 5)) for i, _ in texts}
    alone = decontaminate.search(decontaminate.build_index(docs, segment_tokens=1), bench, slop=6).collect()
    assert {r.doc_id: list(r.near_items) for r in alone} == want
    assert "near_items" not in decontaminate.contamination(docs, bench).columns


def test_proximity_of_many_windows():
    """All windows of a block side by side: equal to a look around each word, also in small parts, and soon done."""
    rng = np.random.default_rng(3)
    word = lambda n, most: " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), most))
    texts, items = [word(int(n), 30) for n in rng.integers(0, 60, 60)], [word(int(n), 30) for n in rng.integers(0, 9, 40)]

    def opened(texts, items, window):
        q = decontaminate.Queries(list(range(len(items))), items, window)
        ((_, w, n),) = decontaminate._segments(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), 0, 1 << 30)
        return decontaminate.Segment(q, *decontaminate._index_of(w, n))

    def around(d, i):
        w, v = words(texts[d]), words(items[i])
        windows = [set(v[k : k + min(4, len(v))]) for k in range(len(v) - min(4, len(v)) + 1)] if v else []
        return any(w[k] in own and own <= set(w[max(0, k - 5) : k + 6]) for own in windows for k in range(len(w)))

    want = {(d, i) for d in range(len(texts)) for i in range(len(items)) if around(d, i)}
    assert want
    for pairs in (1, 50, 1 << 20):
        assert {x for i, d in opened(texts, items, 4).near(5, pairs) for x in zip(d.tolist(), i.tolist(), strict=True)} == want
    segment = opened([word(200, 500) for _ in range(500)], [word(40, 500) for _ in range(300)], 13)
    began = time.process_time()
    assert sum(len(i) for i, _ in segment.near(13)) >= 0
    assert time.process_time() - began < 12  # 35 seconds where each window was looked for by itself


def test_licenses(spark, edges):
    texts = [(30, "Licensed under CC BY-NC 4.0. All rights reserved"), (31, "GENERAL public license; general Public License"), (32, "released under the terms of the MIT license"), (33, "released under terms of the MIT license"), (34, "Copyright (c) 2020 Jane Roe. All rights reserved."), (35, "all rights")]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (rows[30].n_base, rows[30].first_word, rows[30].last_word, rows[30].base_labels, rows[30].labels) == (2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc,reserved")
    assert (rows[31].n_base, rows[31].first_word, rows[31].last_word, rows[31].base_labels, rows[31].score) == (2, 0, 3, "gpl", 0.5)
    assert rows[32].labels == "mit" and rows[32].score == 1.0 and [tuple(s) for s in rows[32].spans] == [("mit", 0, 7)]
    assert rows[33].labels == "" and rows[34].labels == "copyright-notice,reserved"
    assert rows[35].n_base == 0 and rows[35].first_word is None
    apart = licenses.scan(edges, {THUE[0]: "x"}, [("y", THUE[1] + " z")]).collect()
    assert {r.doc_id: (r.n_base, r.labels) for r in apart if r.n_base} == {11: (1, "x")}
    some = licenses.scan(edges).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in some) == sorted((str(i), len(words(t))) for i, t in EDGES)


def test_license_texts(spark):
    """Every template accepts its own wording in full with its regions filled or left out, and no text with a word changed."""
    def filled(template, optional):
        out, depth = [], 0
        for part in licenses.parts(template):
            if part in "[]":
                depth += 1 if part == "[" else -1
            elif optional or not depth:
                out += ["holder"] * int(part[2:].split("..")[0]) if part[0] == "<" else [part]
        return out

    rows, want = [], {}
    for k, (label, template) in enumerate(licenses.TEMPLATES):
        for optional in (0, 1):
            w = filled(template, optional)
            rows += [(10 * k + optional, f"Intro, {'; '.join(w).upper()}\n(end)")]
            # One mandatory word changed: near the middle, and near the end.
            mandatory = [i for i, x in enumerate(w) if x != "holder" and (not optional or w.count(x) == filled(template, 0).count(x))]
            for o, i in ((2, mandatory[len(mandatory) // 2]), (4, mandatory[-1])):
                rows += [(10 * k + o + optional, " ".join(w[:i] + ["changed"] + w[i + 1 :]))]
            want[10 * k + optional] = label
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sizes = {i: len(words(t)) for i, t in rows}
    for i, label in want.items():
        assert (label, 1, sizes[i] - 2) in got[i], (i, label)
    full = [k for k, (_, t) in enumerate(licenses.TEMPLATES) if len(licenses.parts(t)) > 40]
    assert len(full) > 10 and all(licenses.TEMPLATES[k][0] not in {x[0] for x in got[10 * k + o] if x[2] - x[1] > 30} for k in full for o in (2, 3, 4, 5))


def test_license_automaton():
    a = licenses.Automaton("a [b c] d <<1..2>> e")
    code = lambda s: [int(x) for x in licenses.WORD_HASH.words(s.split())]
    assert a.accepts(code("a b c d x e"), 0) == 6 and a.accepts(code("a d x y e"), 0) == 5
    for bad in ("a b d x e", "a d e", "a d x y z e", "a d x"):
        assert a.accepts(code(bad), 0) == -1
    with pytest.raises(ValueError):
        licenses.Automaton("[a] b")


def test_quality_learns_on_bags(spark, edges, nothing):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        good = r.random() < 0.5
        # A bad text has one bad passage among good ones.
        parts = [prose(70, 1000 + i), prose(70, 2000 + i)] + ([] if good else [" ".join(["spam###"] * 70)])
        docs.append((i, " ".join(parts)))
        labels.append((i, int(good), 0))
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(frame, marks).collect()
    truth = {i: q for i, q, _ in labels}
    held = [x for x in rows if x.held_out]
    assert {x.doc_id for x in held} == {i for i, _ in docs if crc32(str(i).encode()) % 3 == 1}
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    model = quality.train(frame, marks.selectExpr("doc_id", "quality as label"))
    some = quality.score(edges, model).collect()
    assert len(some) == len(EDGES) and all(0 <= x.score <= 1 for x in some)
    assert set(quality.keep(edges, model).columns) == set(edges.columns)
    assert quality.classify(nothing, marks).count() == 0
    unlabelled = quality.classify(edges, marks.limit(0)).collect()
    assert all(abs(x.score - 0.5) < 1e-6 for x in unlabelled)


def test_quality_attention_and_gradients():
    """The forward pass against plain loops; the first step goes against the sign of the loss's differences."""
    rng = np.random.default_rng(6)
    x, edge, y = rng.standard_normal((11, 7)).astype(np.float32), np.array([0, 1, 5, 8, 11]), np.array([1, 0, 1, 0], np.float32)

    def plain(model):
        p, out = {k: v.astype(float) for k, v in model.p.items()}, []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            h = [np.tanh(((r - model.mean) / model.scale).clip(-6, 6) @ p["e"] + p["eb"]) for r in x[a:b].astype(float)]
            s = [float((np.tanh(v @ p["v"]) / (1 + np.exp(-(v @ p["u"])))) @ p["a"][:, 0]) for v in h]
            e = [math.exp(v) for v in s]
            bag = sum(v * w / sum(e) for v, w in zip(h, e, strict=True))
            out.append(1 / (1 + math.exp(-(float(bag @ p["o"][:, 0]) + float(p["ob"][0])))))
        return np.array(out)

    model = quality.Model(7)
    assert np.allclose(model.score(x, edge), plain(model), atol=1e-5)
    stepped = quality.Model(7).fit(x, edge, y, rounds=1, batch=4)
    model.mean, model.scale = stepped.mean, stepped.scale
    loss = lambda: -float(np.where(y == 1, np.log(plain(model)), np.log(1 - plain(model))).mean()) + sum(5e-5 * float((v.astype(float) ** 2).sum()) for v in model.p.values())
    for name, v in model.p.items():
        model.p[name] = v = v.astype(float)
        flat, moved = v.reshape(-1), (stepped.p[name] - v).reshape(-1)
        for i in rng.permutation(flat.size)[:12].tolist():
            keep, sides = flat[i], []
            for step in (1e-4, -1e-4):
                flat[i] = keep + step
                sides.append(loss())
            flat[i] = keep
            slope = (sides[0] - sides[1]) / 2e-4
            assert abs(slope) < 1e-4 or slope * moved[i] < 0, (name, i)


def test_language_model(spark, edges, nothing):
    more = [(100 + i, prose(60, i % 7)) for i in range(60)]
    docs = EDGES + more
    frame = edges.select("doc_id", "text", "held").union(spark.createDataFrame([(*x, True) for x in more], "doc_id long, text string, held boolean"))
    rows = lm.score(frame, chunk_tokens=500).collect()
    held = lambda i: i is not None and crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in docs if not held(i) for w in words(t, SPACED) + [None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(words(t, SPACED)) + 1, sum(c[w] > 0 for w in words(t, SPACED) + [None]), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t, SPACED) + [None]), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in rows)
    learned = [r for r in rows if r.doc_id and r.doc_id >= 100]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)
    assert lm.score(nothing).count() == 0


def test_language_model_learns_from_all_documents(spark):
    """Only the documents that a sample of 2,000 in the order of a hash would leave out show which word follows which."""
    ids = [r[0] for r in spark.range(2700).orderBy(F.xxhash64("id"), "id").collect()]
    r = random.Random(3)
    chain = lambda i: " ".join(f"s{(i + k) % 20}q" for k in range(40))
    docs = [(i, " ".join(f"s{r.randrange(20)}q" for _ in range(10)) if k < 2300 else chain(i)) for k, i in enumerate(ids)]
    last = set(ids[2300:])
    rows = [x for x in lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect() if x.doc_id in last and x.held_out]
    assert len(rows) > 20 and sum(x.score for x in rows) > 0.75 * sum(x.base_score for x in rows)


def test_language_model_without_training_documents(spark):
    rows = lm.score(spark.createDataFrame([(1, "a b c"), (2, None), (3, "b")], "doc_id long, text string"), held="true").collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in rows) == [(1, True, 4, 0, 0, 0.0), (2, True, 1, 0, 0, 0.0), (3, True, 2, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_network_gradients(monkeypatch):
    """The gradients of truncated backpropagation against differences of the loss itself, in every kind of parameter."""
    rng = np.random.default_rng(4)
    net = lm.Network(100)
    for v in net.p.values():
        v[...] = rng.standard_normal(v.shape) * 0.2
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, at = rng.integers(0, net.start, 14), np.array([0, 14])
    caught = {}

    class Moments(dict):
        def __getitem__(self, name):
            if name != "turn":
                caught.setdefault(name, 0)
            return super().__getitem__(name)

    # One lane, one span, no step: the first moment then holds a tenth of the clipped, scaled gradient.
    moments = Moments({k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, turn=0)
    before = {k: v.copy() for k, v in net.p.items()}
    lm.fit(net, [ids], None, passes=1, lanes=1, span=14, rate=0.0, decay=False, moments=moments)
    assert all((net.p[k] == before[k]).all() for k in before) and set(caught) == set(net.p)
    scale = 64 / len(ids)
    for name, v in net.p.items():
        flat, grad = v.reshape(-1), moments[name][0].reshape(-1) * 10
        for i in {*np.argsort(-abs(grad))[:8].tolist(), *rng.integers(0, flat.size, 4).tolist()}:
            if abs(grad[i]) > 0.99:
                continue  # clipped
            keep, sides = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = keep + step
                sides.append(-lm.log_likelihoods(net, ids, at)[0])
            flat[i] = keep
            assert abs((sides[0] - sides[1]) / 2e-5 * scale - grad[i]) < 1e-2 + 0.02 * abs(grad[i]), (name, i)


def test_network_windows():
    net = lm.Network(100)
    lm.fit(net, [np.random.default_rng(0).integers(0, 100, 300) for _ in range(5)], np.ones(net.groups * lm.GROUP + lm.TAIL), passes=1)
    ids = np.random.default_rng(1).integers(0, 100, 150)
    at = np.array([0, 1, 71, 150])
    together = lm.log_likelihoods(net, ids, at)
    alone = [lm.log_likelihoods(net, ids[a:b], np.array([0, b - a]))[0] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert np.allclose(together, alone, rtol=1e-4)
    # Probabilities of all next words sum to one (tail classes count once).
    h = np.zeros((1, lm.HIDDEN), np.float32)
    every = np.concatenate([np.arange(net.groups * lm.GROUP), net.groups * lm.GROUP + np.arange(lm.TAIL)])
    assert abs(np.exp(net.log_probability(np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-3


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, edges, nothing):
    r = random.Random(8)
    base = {g: prose(200, 100 + g).split() for g in range(8)}
    docs = []
    for g, w in base.items():
        docs.append((1000 * g + 1000, " ".join(w)))
        for k in range(1, 12):
            c = list(w)
            c[r.randrange(len(c))] = f"edit{g}x{k}"
            docs.append((1000 * g + 1000 + k, " ".join(c) if k % 3 else " ".join(w).upper()))
    docs += [(90_000 + k, prose(150, 5000 + k) + " " + " ".join(base[0][:25])) for k in range(60)]  # a shared passage only
    docs += [(80_000 + k, None) for k in range(2)] + [(80_010, ""), (80_011, " . "), (80_020, "a b"), (80_021, "A  b!"), (80_022, "a c"), (80_030, THUE[0]), (80_031, THUE[1])]
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), chunk_bytes=20_000).collect()
    cls = {x.doc_id: x.class_id for x in rows}
    assert len(rows) == len(docs)
    for g in range(8):
        assert {cls[1000 * g + 1000 + k] for k in range(12)} == {1000 * g + 1000}
    assert all(cls[i] == i for i in cls if i >= 90_000 or 80_000 <= i <= 80_020 or 80_022 <= i <= 80_031) and cls[80_021] == 80_020
    some = neardup.near_duplicates(edges).collect()
    assert len(some) == len(EDGES)
    got = {x.doc_id: x.class_id for x in some}
    assert got[10] == 9 and got[4] == 4 and got[1] == 1
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_equal_all_pairs(spark):
    """Classes of the table against components of all pairs by weighted Jaccard similarity, computed with plain dictionaries."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, " ".join(w for k, w in enumerate((t or "").split()) if k != 7)) for i, t in rows[:60]]  # near copies
    lists = [words(t) for _, t in rows]
    df = Counter(w for x in lists for w in set(x))
    n = len(rows)
    kept = {w: min(n, 2 ** (min(255, round(8 * math.log2(c))) / 8)) for w, c in df.items()}  # to an eighth of an octave
    idf = {w: 1 + math.log((1 + n) / (1 + c)) / math.log(2 + n) for w, c in kept.items()}
    bags = []
    for x in lists:
        size = min(5, len(x))
        grams = Counter(tuple(x[i : i + size]) for i in range(len(x) - size + 1)) if x else Counter()
        bags.append({g: c * sum(idf[w] for w in g) / size for g, c in grams.items()})
    total = [sum(b.values()) for b in bags]
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = 0
    for i in range(n):
        for j in range(i):
            if bags[i] and bags[j] and min(total[i], total[j]) >= 0.8 * max(total[i], total[j]):
                least = sum(min(v, bags[j][g]) for g, v in bags[i].items() if g in bags[j])
                if least >= 0.8 * (total[i] + total[j] - least) - 1e-9:
                    pairs += 1
                    label[max(root(i), root(j))] = min(root(i), root(j))
    want = {}
    for i, (doc, _) in enumerate(rows):
        want.setdefault(root(i), set()).add(doc)
    got = {}
    for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk_bytes=50_000).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert pairs > 50 and {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    w = rng.uniform(0.5, 3, 300)
    a, b = np.arange(0, 220), np.arange(60, 300)
    v = w.copy()
    v[100:150] *= 1.5
    both = np.concatenate([h[a], h[b]])
    s = neardup.samples(both, np.concatenate([w[a], v[b]]), np.array([0, len(a), len(both)]), 48)
    least = np.minimum(w[60:220], v[60:220]).sum()
    true = least / (w[a].sum() + v[b].sum() - least)
    assert abs((s[0] == s[1]).mean() - true) < 0.22


def test_hashes_of_long_texts_equal_those_of_their_words():
    import pyarrow as pa

    from quarry.llm._words import STEP, WORD_HASH, hashed_words

    text = prose(900_000, 77) + " " + "y" * (STEP + 5) + " end"
    (_, _, got, at), = hashed_words(pa.array([text]))
    assert len(text) > 3 * STEP and at.tolist() == [0, 900_002]
    assert (got == WORD_HASH.words(text.split())).all()


def test_network_blocks(monkeypatch):
    """Documents scored a few at a time, in softmaxes of few rows, score as all at once do."""
    net, rng = lm.Network(100), np.random.default_rng(1)
    at = np.cumsum([0, 1, 40, 3, 70, 2, 2, 33])
    ids = rng.integers(0, net.start, at[-1])
    want = lm.log_likelihoods(net, ids, at)
    monkeypatch.setattr(lm, "LANES", 2)
    monkeypatch.setattr(lm, "ROWS", 5)
    assert np.allclose(lm.log_likelihoods(net, ids, at), want, rtol=1e-5)


def test_network_lanes_stay_full(monkeypatch):
    """Scoring takes about as many steps as the tokens of all documents fill in all lanes, also with few long documents."""
    rng, taken = np.random.default_rng(2), []
    at = np.cumsum([0, 300, *[20] * 15, *[1] * 20, *[12] * 25])

    class Counted(lm.Network):
        @staticmethod
        def step(*a):
            taken.append(1)
            lm.Network.step(*a)

    net = Counted(100)
    ids = rng.integers(0, net.start, at[-1])
    monkeypatch.setattr(lm, "LANES", 4)
    got = lm.log_likelihoods(net, ids, at)
    assert len(taken) <= max(300, -(-at[-1] // 4)) + lm.SPAN
    monkeypatch.undo()
    alone = [lm.log_likelihoods(net, ids[a:b], np.array([0, b - a]))[0] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert np.allclose(got, alone, rtol=1e-4)

"""Merkle manifest, periodic runs, exact top-k: against plain versions."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from quarry.llm import merkle, periods, topk
from quarry.llm.queries import queries

from .conftest import prose


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def of_row(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves, reach):
    """The last node, and for each leaf the steps (left, right) up to it, after ``reach`` is called with the leaf's place."""
    steps, nodes, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            above.append(digest(*run))
            held.append(sum(members[a : a + 3], []))
            for k in range(len(run)):
                for i in members[a + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes, members = above, held
    return nodes[0], steps


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, of_row(*r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]], None)
    root, upper = tree([trees[s][0] for s in order], None)
    out = []
    for k, s in enumerate(order):
        for (r, leaf), steps in zip(groups[s], trees[s][1], strict=True):
            path = steps + upper[k]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = of_row(*r[:4], r[4].replace("\n", "")) if bad else leaf
            for left, right in path:
                folded = digest(left, folded, right)
            out.append((r[0], leaf, trees[s][0], root, digest(*(x for step in path for x in step)), folded, folded == root))
    return out


def manifest(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, [2]) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, path array<int>").repartition(3)
    return [tuple(r) for r in merkle.manifest(frame).collect()]


def test_manifest_equals_the_plain_one(spark):
    """A tree of several blocks, whose last is short; trees of one leaf, three and four; nulls, ties, repeated rows."""
    r = random.Random(2)
    n = 2 * merkle.BLOCK + 1
    rows = [(i, "big", "en", i, f"line {r.random()}\n" * (i % 3)) for i in range(n)]
    rows += [(5, "one", None, None, None), (1, None, "fr", 3, "a\nb"), (None, None, "fr", 3, "a\nb"), (2, None, "fr", 3, "")]
    rows += [(k, "", None, 0, prose(5, k) + "\n") for k in (7, 7, 8, 9)] + [(7, "", None, 0, prose(5, 7) + "\n"), (-3, "é", "é", -1, "日本\n語"), (4, "z", "en", 1, prose(20_000, 4) + "\nx")]
    r.shuffle(rows)
    got, want = manifest(spark, rows), plain_manifest(rows)
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {x[6] for x in got} == {True, False} and len({x[3] for x in got}) == 1


def test_manifest_of_one_row_and_of_none(spark):
    row = (3, "s", "en", 1, "t")
    assert manifest(spark, [row]) == [(3, leaf := of_row(*row), leaf, leaf, digest(""), leaf, True)]
    frame = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(frame).collect() == [] and merkle.manifest(frame).dtypes == [tuple(c.split()[:2]) for c in merkle.RESULT.replace("long", "bigint").split(", ")]


def test_siblings_by_index_are_those_of_the_runs():
    for n in (1, 2, 3, 4, 9, 10, 26, 28, 100):
        leaves = [digest(str(i)) for i in range(n)]
        m = merkle.levels(merkle._hex(leaves), None)
        root, steps = tree(leaves, None)
        assert m[-1].tobytes().decode() == root
        found, there = merkle.siblings(m)
        for i in range(n):
            assert found[i][there[i]].tobytes().decode() == "".join(x for step in steps[i] for x in step)
        assert {x.tobytes().decode() for x in merkle.fold(m[0], found, there)} == {root}


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            a = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            n = i - a + q
            if i > a and n >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(a, a + n - d)) for d in range(1, q)):
                out.append((a, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(seed):
    r = random.Random(seed)
    words = [b"%d" % r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(60))]
    for _ in range(r.randrange(3)):
        a, p = r.randrange(len(words) + 1), r.randrange(1, 9)
        words[a:a] = (words[a : a + p] * 40)[: r.randrange(60)]
    return words


@pytest.mark.parametrize("lying", [False, True])
def test_runs_equal_brute_force(lying, monkeypatch):
    """Also when every hash says that words agree."""
    if lying:
        monkeypatch.setattr(periods.Words, "_same", lambda *a: True)
    texts = [repetitive(k) for k in range(600)]
    got = periods.runs(texts)
    assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == [brute_runs(t) for t in texts]
    assert sum(map(len, got)) > 300


def test_long_repeats_take_linear_time():
    for words in ([b"a"] * 100_000, [b"a", b"b", b"c"] * 40_000, [b"%d" % (k % 1000) for k in range(100_000)]):
        (found,) = periods.runs([words])
        assert found == [(0, len(words), len(set(words)))]


def judged(doc_id, text, plant=True):
    words = (text or "").encode().translate(bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")).split(b" ")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words) if len(words) < 2000 else []
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = (None,) * 4
    for s, k, q in found:
        if best[0] is None or k * best[2] > best[1] * q:
            best = (s, k, q, 1000 * k // q)
    return (doc_id, len(found), *best, digest(*(f"{s},{k},{q}\n" for s, k, q in found)), sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_periodic_runs_of_odd_rows(spark, edges):
    rows = [(i, " ".join(w.decode() for w in repetitive(i))) for i in range(100, 300)]
    rows += [(None, "a b " * 9), (3, "x y x y " * 5), (4, "a\tb\n" * 6 + "\r\x0b"), (5, "z " * 8), (5, "z " * 8)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, start int, period string").repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    assert sorted([tuple(r) for r in periods.judge(frame).collect()], key=key) == sorted([judged(*r) for r in rows], key=key)
    from .conftest import EDGES

    assert sorted([tuple(r) for r in periods.judge(edges, plant=False).collect()], key=key) == sorted([judged(*r, plant=False) for r in EDGES], key=key)
    assert periods.judge(edges.limit(0)).count() == 0


def test_periodic_runs_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: tuple(r) for r in queries()["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts)
    short = {i: t for i, t in texts.items() if len((t or "").split()) < 600}
    assert len(short) > 100 and all(rows[i] == judged(i, t) for i, t in short.items()) and any(r[1] for r in rows.values())


def brute_top(rows, k=5):
    import math

    ok = [(i, [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    out = []
    for q in {i for i, _ in ok if i % 50 == 0}:
        own = min(v for i, v in rows if i == q and v is not None)
        own = [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in own]
        clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
        best = sorted((-clip(sum(a * b for a, b in zip(own, v, strict=True))), i) for i, v in ok if i != q and len(v) == len(own))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def top(spark, rows, kind="array<double>"):
    frame = spark.createDataFrame([(*r, 1, [0.5]) for r in rows], f"vec_id long, embedding {kind}, block long, v array<double>").repartition(5)
    return sorted(tuple(r) for r in topk.search(frame, frame.filter("vec_id % 50 = 0")).collect())


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(6) * 0.2)]) for i in range(700)]
    rows += [(1000 + i, [0.25] * 6) for i in range(300)] + rows[:30]  # ties, repeated rows
    rows += [(2000, None), (2050, []), (2051, []), (2100, [0.0] * 6), (2150, [0.1, None] * 3), (2200, [float("nan")] * 6), (2250, [float("-inf")] * 6), (2300, [1.0] * 5), (2301, [-2.0] * 5), (None, [1.0] * 6), (-50, [1.0] * 6)]
    assert top(spark, rows, "array<float>") == brute_top(rows)


@pytest.mark.parametrize("scale", [1e3, 1e6, 1e9, 1e15, 1e306])
def test_scores_are_exact_at_every_size(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(4) * scale]) for i in range(240)]
    assert top(spark, rows) == brute_top(rows)


def test_top_k_over_groups_of_shards(spark, monkeypatch):
    """Small shards and groups, so that there are several rounds."""
    for name, value in (("SHARD_ROWS", 64), ("GROUP", 2), ("QUERIES", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in centres[rng.integers(20)] + 0.2 * rng.standard_normal(16)]) for i in range(2500)]
    assert top(spark, rows) == brute_top(rows)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).count() == 0


def test_a_tree_leaves_out_what_cannot_be_among_the_best():
    """Vectors in groups: the later shards make under a quarter of the products; every answer is exact."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((16, 24))
    v = topk.whole(centres[rng.integers(0, 16, 8192)] + 0.1 * rng.standard_normal((8192, 24)))
    ids = np.arange(8192)
    q, asked = v[::50], ids[::50]
    best, made = topk.Best(asked, 5, np.full(len(q), -np.inf)), []
    for a in (0, 4096):
        made.append(topk.look(topk.Tree(ids[a : a + 4096], v[a : a + 4096]), q, best))
    exact = q @ v.T
    exact[np.arange(len(q)), asked] = -np.inf
    assert np.array_equal(best.score.reshape(-1, 5), -np.sort(-exact, 1)[:, :5])
    assert made[1] < len(q) * 4096 / 4

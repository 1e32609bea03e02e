"""Neighbours, URL rules, chat collapse and the pipeline."""

import itertools
import re

import numpy as np

import corpus_pipeline
from quarry.llm import ann, chat, urlrules
from quarry.llm.queries import oracle_sql, queries

from .conftest import prose

SF = "/root/testdata/sf0.001"


def brute(vectors, k=20):
    ok = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            out[i] = [x for _, x in sorted({(-float(np.einsum("i,i", q, v)), j) for j, v in ok if j != i and len(v) == len(q)})][:k]
    return out


def found(frame, queries):
    got = {}
    for r in ann.search(frame, queries, sample_rows=140).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def recall(got, want):
    return sum(len({x for _, x, _ in got[q]} & set(want[q])) for q in want) / sum(map(len, want.values()))


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(40) * (1 + i % 3))]) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 40) for i in range(100)]  # ties
    rows += [(5000, None), (5020, []), (5040, [0.0] * 40), (5060, [1.0, None] + [0.0] * 38), (5080, [float("nan")] * 40), (5100, [float("inf")] * 40), (5120, [1.0] * 5), (5140, [2.0] * 5), (None, [1.0] * 40)]
    rows += rows[:3]
    frame = spark.createDataFrame([(*r, 1, [1.0], "x", 0.5) for r in rows], "vec_id long, embedding array<float>, query_id long, v array<double>, list string, kth double").repartition(3)
    got, want = found(frame, frame.filter("vec_id % 20 = 0")), brute(rows)
    assert set(got) == set(want)
    assert all([x[0] for x in got[q]] == list(range(1, len(want[q]) + 1)) for q in want)
    assert recall(got, want) >= 0.9
    assert [x for _, x, _ in got[2000]] == want[2000] and [x for _, x, _ in got[5120]] == [5140]


def test_neighbours_of_long_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(2500).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(frame, frame.filter("vec_id % 20 = 0")), brute(rows)
    assert {q: [x for _, x, _ in v] for q, v in got.items()} == want


def test_a_query_among_copies_of_one_vector_still_finds_k(spark):
    rng = np.random.default_rng(2)
    rows = [(7, [1.0, 0.0, 0.0])] * 3000 + [(i, rng.standard_normal(3).tolist()) for i in range(100, 140)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(frame, frame.filter("vec_id % 20 = 0")), brute(rows)
    assert all(len(got[q]) == 20 for q in want) and recall(got, want) >= 0.9


def test_few_neighbours(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    rows = ann.search(frame, frame.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in rows] == [(1, 3, 0.5), (2, 7, 0.5)]
    assert ann.search(frame.limit(0), frame).count() == 0


def clustered(n, centres=250, dim=48):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((centres, dim))[rng.integers(0, centres, n)] + 0.6 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_few_lists_are_probed_and_few_components_read():
    """A sample of a tenth of the rows; vectors in groups, as texts' embeddings are. The bounds are the README's."""
    x, k = clustered(12_000), 20
    sample = x[np.random.default_rng(1).choice(len(x), 1200, replace=False)]
    index = ann.Index(sample, len(x), 1.0)
    index.calibrate(sample, len(x), k)
    own = index.lists(x)
    index.sizes = np.bincount(own, minlength=len(index.sizes))
    assert index.probes < len(index.sizes) / 3
    q = x[::20]
    exact = q @ x.T
    exact[np.arange(len(q)), np.arange(0, len(x), 20)] = -np.inf
    best = np.argsort(-exact, 1)[:, :k]
    order, enough = index.probed(q, 4 * (k + 1))
    rank = np.take_along_axis(np.argsort(order, 1), own[best], 1)
    assert (rank < np.maximum(enough, index.probes)[:, None]).mean() >= 0.9
    # The scan with the true limit: it keeps nearly all of the best and leaves most components unread.
    turned, candidates = index.rotated(q, True), index.rotated(x)
    limit = 2 - 2 * np.sort(exact, 1)[:, -k]
    qi, xi, looked = ann.scan(turned, limit, [candidates[:, a : a + ann.COLUMNS] for a in range(0, index.dim, ann.COLUMNS)])
    kept = set(zip(qi.tolist(), xi.tolist(), strict=True))
    assert np.mean([(i, j) in kept for i, row in enumerate(best.tolist()) for j in row]) >= 0.97
    assert looked < 0.7 * len(q) * len(x) * index.dim


def test_neighbours_recall_with_a_small_sample(spark):
    x = clustered(3000)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert recall(found(frame, frame.filter("vec_id % 20 = 0")), brute(rows)) >= 0.9


def test_neighbours_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = found(frame, frame.filter("vec_id % 20 = 0")), brute(rows)
    assert recall(got, want) >= 0.9
    by_id = {i: np.array(v, float) for i, v in rows}
    assert all(abs(s - float(by_id[q] @ by_id[i])) < 1e-12 for q, v in got.items() for _, i, s in v)


URLS = [
    ("http://WWW.Example.org/es/x?q", "www.example.org", "/es/x", "example.org/es/"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"), ("https://example.org/en/2", "example.org", "/en/2", "org/"),
    ("http://a.com/fr/", "a.com", "/fr/", "com/fr/"), ("http://a.com/de/#x", "a.com", "/de/", "com/de/"), ("http://acom/fr/", "acom", "/fr/", None), ("http://x.org", "x.org", "", None), ("http://x.org?y=/z", "x.org", "", None),
    ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("http://notexample.org/es/", "notexample.org", "/es/", "org/"), ("http://x.org/É?#", "x.org", "/É", "org/"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, label string")
    rows = {r.page_id: r for r in urlrules.judge(pages, labels).collect()}
    verdicts = {r: v for v, r in urlrules.RULES}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), URLS[i]
        assert rows[i].verdict == verdicts.get(rule, "allow")
    assert urlrules.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_equal_brute_force(spark):
    """The whole rule set, and which rule decides."""
    hosts = ["bad.shop", "good.shop", "bad.news"]
    pages = [(i, f"http://{hosts[i % 3]}.net/{'p' if i % 2 else 'q'}/{i}.html") for i in range(120)]
    pages += [(200 + i, f"http://tie.org/{'ab'[i % 2]}/x?u=1&v=2") for i in range(24)] + [(900, None), (901, "http://bad.shop.net/p/never/seen.html"), (902, "http://tie.org/a/x?u=1")]
    pages += [(903, "http://long.org/" + "/".join(f"f{'abcdefgh'[k % 8] * (1 + k // 8)}" for k in range(3000)))] + pages[:5]  # a very long one, repeated rows
    label = lambda i: ("block" if i % 3 == 0 or i % 3 == 2 and i % 2 else "allow") if i < 200 else "block" if i % 4 < 2 else "allow"
    frame = spark.createDataFrame([(*x, "h", "t", "k") for x in pages], "page_id long, url string, tokens string, mined string, key string").repartition(3)
    marked = {i: label(i) for i, _ in pages if i < 300} | {903: "allow"}
    marks = spark.createDataFrame([*marked.items(), (None, "block"), (3, None)], "page_id long, label string")
    support, confidence = 0.05, 0.6
    rows = urlrules.judge(frame, marks, [], support, confidence).collect()
    known = {r.page_id: frozenset(r.tokens) for r in urlrules.parsed(frame).withColumn("tokens", urlrules.tokens()).collect()}
    learned = [(known[i], marked[i]) for i, _ in pages if i in marked]  # repeated rows count
    n = len(learned)
    base = {v: sum(x == v for _, x in learned) / n for v in ("allow", "block")}
    of_token = {t: frozenset(k for k, (s, _) in enumerate(learned) if t in s) for t in set().union(*(s for s, _ in learned))}
    groups = {}
    for t, where in of_token.items():
        if len(where) >= support * n:
            groups.setdefault(where, set()).add(t)
    items = [frozenset(g) for g in groups.values()]
    want = {}
    for size in range(1, len(items) + 1):
        for some in itertools.combinations(items, size):
            tokens = frozenset().union(*some)
            fit = [v for s, v in learned if tokens <= s]
            for v in ("allow", "block"):
                k = sum(x == v for x in fit)
                if k >= support * n and k / len(fit) >= confidence and k / len(fit) / base[v] >= urlrules.MIN_LIFT:
                    want[tokens, v] = (k / len(fit), k / n)
    labelled = urlrules.save(urlrules.parsed(frame).withColumn("tokens", urlrules.tokens()).join(marks.filter("page_id is not null and label is not null"), "page_id").selectExpr("monotonically_increasing_id() as id", "tokens", "label"), "labelled")
    mined = urlrules.mine(labelled, support, confidence).collect()
    assert len(want) > 5 and {(frozenset(r.antecedent), r.verdict) for r in mined} == set(want)
    for r in mined:
        assert np.allclose((r.confidence, r.support), want[frozenset(r.antecedent), r.verdict])
        assert len(of_token[r.key]) == min(len(of_token[t]) for t in r.antecedent)
    for r in rows:
        fit = [(*facts, v) for (tokens, v), facts in want.items() if tokens <= known[r.page_id]]
        assert r.mined == (max(fit)[2] if fit else None) and r.verdict == (r.mined or "allow"), r.page_id
    assert len(rows) == len(pages)


def test_chat(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", None)]
    convs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "no")], 6: [(None, "x")], None: [("user", "")]}
    rows = [(c, t, r, x, 9) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rows += [(7, 0, "user", "hi", 9), (7, 0, "user", "hi", 9)]  # a repeated row is a turn of its own
    rows += [(8, 0, "user", "\u0000", 9), (9, 0, "user", None, 9), (9, 1, "user", "on", 9)]  # a null is no NUL
    rows += [(10, t, "user", prose(20, t), 9) for t in range(3000)] + [(11, t, "user", prose(20, t), 9) for t in range(2999)]  # long ones
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long").repartition(4)
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.collapse(frame).collect()}
    assert set(got) == {3, 5, 6, 7, 8, 9, 10, None}
    assert got[10] == (3000, "".join(f"<|im_start|>user\n{prose(20, t)}<|im_end|>\n" for t in range(3000)))
    assert got[3] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    assert chat.collapse(frame.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = corpus_pipeline.save(docs, re.sub(" ", "_", name))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept < seen
        seen = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == seen


def test_queries_are_registered():
    names = list(queries())
    assert [int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)] == list(range(1, 14)) and set(oracle_sql()) <= set(names)


def test_pipeline_on_odd_rows(spark, edges, nothing):
    kept = corpus_pipeline.near_dedup(spark, edges, SF)
    assert kept.columns == edges.columns and kept.schema == edges.schema
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert sorted(x for x in ids if x is not None and x not in (9, 10)) == [1, 2, 3, 4, 5, 6, 7, 8, 11, 12] and ids.count(None) == 2 and len({9, 10} & set(ids)) == 1
    clean = corpus_pipeline.decontamination(spark, edges, SF)
    assert clean.count() == edges.count() and clean.columns == edges.columns
    assert corpus_pipeline.pack(spark, edges, SF).agg({"length": "sum"}).first()[0] > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name


def test_pipeline_decides_by_row(spark, tmp_path):
    """Rows that share an id, or have none, are judged by their own texts."""
    bad, copied, clean = prose(40, 1), prose(200, 2), [prose(120, k) for k in range(10, 16)]
    rows = [(None, clean[0]), (None, bad), (None, copied), (None, copied + " more"), (7, clean[1]), (7, "x " + bad), (7, copied), (3, clean[2]), (8, clean[3]), (8, clean[4])]
    docs = spark.createDataFrame([(*r, "a", k) for k, r in enumerate(rows)], "doc_id long, text string, key string, row int").repartition(3)
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.row for r in left.collect()) == [0, 2, 3, 4, 6, 7, 8, 9]
    kept = sorted(r.row for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
    assert [x for x in kept if x not in (1, 5, 2, 3, 6)] == [0, 4, 7, 8, 9] and len({2, 3, 6} & set(kept)) == 1 and {1, 5} & set(kept)
    classes = corpus_pipeline.neardup.near_duplicates(docs).collect()
    assert sorted(str(r.class_id) for r in classes if r.doc_id == 8) == ["8", "8"] and {r.class_id for r in classes if r.doc_id == 3} == {3}

"""Packing and admission by ranges, against plain folds."""

import random

import pytest

from quarry.operators import shards


def plain_pack(files, budget):
    """files: (path, tokens) in byte order."""
    runs = []
    for path, n in files:
        d = path.rpartition("/")[0]
        if not runs or runs[-1][0] != d:
            runs.append((d, []))
        runs[-1][1].append((path, n))
    units = []
    for _, own in runs:
        units += [[x] for x in own] if sum(n for _, n in own) > budget else [own]
    out, shard, used = {}, 0, 0
    for u in units:
        n = sum(x for _, x in u)
        if used and used + n > budget:
            shard, used = shard + 1, 0
        used += n
        out |= dict.fromkeys([p for p, _ in u], shard)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_packing_equals_a_plain_fold(spark, seed):
    r = random.Random(seed)
    budget = [60, 200, 1000, 10**6, 40][seed]
    files = [(f"d{r.randrange(30):02}/{'s/' * r.randrange(2)}f{k:04}.py", r.choice([0, 3, 40, r.randrange(900), budget * 4])) for k in range([900, 900, 900, 50, 0][seed])]
    frame = spark.createDataFrame(files, "relative_path string, size_bytes long").repartition(3)
    tokens = sorted(((p, max(1, (n + len(p.encode()) + len(str(n // 30)) + 12) // 4)) for p, n in files), key=lambda x: x[0].encode())
    assert {x.relative_path: x.shard_id for x in shards.pack_shards(frame, budget).collect()} == plain_pack(tokens, budget)


def test_steps_of_a_range_are_those_of_the_fold():
    r = random.Random(1)
    for _ in range(400):
        budget, tokens = r.randrange(1, 40), [r.randrange(1, 30) for _ in range(r.randrange(1, 25))]
        import numpy as np

        until, amount, begun = shards._steps(np.array(tokens), budget)
        for used in range(1, budget + 35):
            shard, u = 0, used
            for n in tokens:
                if u + n > budget:
                    shard, u = shard + 1, 0
                u += n
            i = shards.bisect_right(until, budget - used)
            assert (u, shard) == ((amount[i], begun[i]) if i < len(until) else (used + sum(tokens), 0)), (budget, tokens, used)


def plain_admission(rows, most, most_bytes):
    n, used, out = 0, 0, []
    for k, s in rows:
        if n < most and used + s <= most_bytes:
            n, used = n + 1, used + s
            out.append(k)
    return out


@pytest.mark.parametrize(("sizes", "most", "most_bytes"), [(lambda r, k: r.randrange(1, 100), 10**9, 3000), (lambda r, k: r.randrange(100), 37, 10**9), (lambda r, k: 2000 - k if k % 2 else 1, 10**9, 2100), (lambda r, k: 500, 10**9, 499), (lambda r, k: 1, 5000, 5000), (lambda r, k: 10_000 if k < 1000 else 1, 10**9, 300)])
def test_admission_equals_a_plain_fold(spark, sizes, most, most_bytes):
    r = random.Random(3)
    rows = [(k, sizes(r, k), "x") for k in range(2000)]
    frame = spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "k int, size int, part_of string").repartition(3)
    got = shards.admit_each(frame, ["k"], "size", most, most_bytes)
    assert got.columns == frame.columns and sorted(x.k for x in got.collect()) == plain_admission([x[:2] for x in rows], most, most_bytes)
    assert shards.admit_each(frame.limit(0), ["k"], "size", most, most_bytes).count() == 0


def test_admitted_rows_come_in_order(spark):
    """Also where a range that is gone through row by row lies before one that comes in as a whole."""
    rows = [(k, 10_000 if k == 0 else 1, "x") for k in range(400)]
    frame = spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "k int, size int, part_of string").repartition(3)
    assert [x.k for x in shards.admit_each(frame, ["k"], "size", 10**9, 5000).collect()] == list(range(1, 400))


def test_submissions_come_in_whole(spark):
    r = random.Random(5)
    rows = [(s, r.randrange(1, 50)) for s in range(300) for _ in range(r.randrange(1, 6))]
    n, used, want = 0, 0, set()
    for s in range(300):
        own = [x for k, x in rows if k == s]
        if n + len(own) <= 400 and used + sum(own) <= 9000:
            n, used = n + len(own), used + sum(own)
            want.add(s)
    got = shards.admit_submissions(spark.createDataFrame(rows, "submission int, size int"), "size", 400, 9000).collect()
    assert {x.submission for x in got} == want and len(got) == n and 0 < len(want) < 300

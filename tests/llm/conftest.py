import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def _parity(flip):
    return "".join("ab"[bin(i).count("1") + flip & 1] for i in range(1024))


#: Two words whose polynomial hashes modulo a power of two are equal for every base.
THUE = [_parity(0), _parity(1)]

#: Nulls, empty and blank texts, ties, repeated rows, a long text, text beyond ASCII; other columns with awkward names.
EDGES = [
    (1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (5, "One, TWO three four five six"), (None, "no id here at all"),
    (None, None), (6, prose(30_000, 6)), (7, "日本語 テキスト Ünï cödé ñandú 'tis it's\r\n\x1c x"), (8, "!!! ??? ..."), (9, prose(300, 9)), (10, prose(300, 9)),
    (11, THUE[0] + " and " + THUE[1]), (12, "ends here<|endoftext|>goes on <|endoftext|> on"),
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, "k", 1, [2], True) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, label int, bands array<int>, held boolean").repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)

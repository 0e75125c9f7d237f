import random

import pytest

from trackloom.llm import common


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "cycle"])
def test_components(spark, kind):
    rng = random.Random(kind)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "chain": [(i, i + 1) for i in rng.sample(range(200), 190)],
        "star": [(500, i) for i in range(300)],
        "cycle": [(i, (i * 7 + 1) % 90) for i in range(90)],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 4), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in common.components(df).collect()}
    assert got == plain([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50) if rng.random() < 0.9 else None, i) for i in range(500)]
    df, n = common.numbered(spark.createDataFrame(rows, "a long, b long"), "a", "b")
    got = [(r.a, r.b) for r in sorted(df.collect(), key=lambda r: r.no)]
    assert n == 500 and got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r.no for r in df.collect()) == list(range(500))

import math

import numpy as np
import pytest

from trackloom.llm import vectors
from trackloom.llm.vectors import Settings

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.95):
    """n_links and component of each row by all pairs."""
    def unit(e):
        if not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            return None
        a = np.array(e, np.float32).astype(np.float64)
        return a / np.linalg.norm(a)

    u = [unit(r[1]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: (links[i], least[find(i)]) for i, r in enumerate(rows)}


def corpus(seed, n=900, dim=32):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist(), 0) for i in range(n)]
    for i in range(0, n, 9):
        near = np.array(rows[i][1]) + rng.normal(size=dim) * 0.12
        rows[(i * 7 + 3) % n] = ((i * 7 + 3) % n, near.astype(np.float32).tolist(), 0)
    hub = rng.normal(size=dim)
    for i in range(n, n + 150):
        rows.append((i, (hub + rng.normal(size=dim) * 0.1).astype(np.float32).tolist(), 1))
    rows += [(5000 + i, rows[n][1], 2) for i in range(60)]
    rows += [(6000, None, 0), (6001, [], 0), (6002, [0.0] * dim, 0), (6003, [float("nan")] + [1.0] * (dim - 1), 0), (6004, [float("inf")] * dim, 0), (6005, [None] + [1.0] * (dim - 1), 0), (6006, [1.0, 2.0], 0), (6007, [2.0, 4.0], 0)]
    return rows


@pytest.mark.parametrize("settings", [Settings(), Settings(shard=150, max_shard=200)])
def test_links_and_components(spark, settings):
    rows = corpus(3)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=settings).collect()}
    want = plain(rows)
    assert sorted(got) == sorted(want)
    total = sum(n for n, _ in want.values())
    assert total > 20_000
    assert all(got[k].n_links <= n for k, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * total
    assert sum(got[k].component_id == c for k, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    for k in range(6000, 6006):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[6006].n_links == 1 and got[6007].component_id == 6006


def test_audit_measures_the_true_recall(spark):
    rows = corpus(4, 300)
    _, nodes = vectors.nodes_of(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    counts, _ = vectors.link(nodes, Settings())
    assert vectors.audit(nodes, counts, Settings(audit=2000)) >= 0.99
    from pyspark.sql import functions as F

    assert vectors.audit(nodes, counts.withColumn("links", F.lit(0).cast("long")), Settings(audit=2000)) == 0


def test_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 2)], SCHEMA)
    out = vectors.near_duplicates(df.withColumnRenamed("label", "n_links")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in out) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    doubles = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    assert sorted(r.n_links for r in vectors.near_duplicates(doubles).collect()) == [1, 1]


def test_dense_groups_by_the_graph_alone(spark):
    """10 groups of 250 in 32 dimensions: the first try's recall, before the audit widens or ends it."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    base = rng.normal(size=(10, 32))
    x = np.repeat(base, 250, axis=0) + rng.normal(size=(2500, 32)) * 0.22
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for s in (Settings(), Settings(shard=300, max_shard=200)):
        _, nodes = vectors.nodes_of(df, "vec_id", "embedding")
        counts, _ = vectors.link(nodes, s)
        got = counts.agg(F.sum("links")).first()[0]
        u = x / np.linalg.norm(x, axis=1)[:, None]
        true = int((u @ u.T >= s.threshold).sum()) - 2500
        assert true > 50_000 and got <= true and got / true >= 0.97, (got, true)

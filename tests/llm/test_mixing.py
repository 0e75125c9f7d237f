import math
import os
import random

import pytest

from trackloom.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), times=3):
    """Targets by sharing again and again; sizes in order of sources."""
    total, left = sum(sizes), set(range(len(sizes)))
    w = [weights[i % 3] for i in range(len(sizes))]
    target, fixed = [0.0] * len(sizes), 0.0
    while left:
        share = {i: (total - fixed) * w[i] / sum(w[j] for j in left) for i in left}
        over = {i for i in left if share[i] > times * sizes[i]}
        if not over:
            for i in left:
                target[i] = share[i]
            break
        for i in over:
            target[i] = times * sizes[i]
            fixed += target[i]
        left -= over
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows, names = [], ["a", "b", None, "Z", "é", "tiny", "\U0001f600", "￮"]
    for i in range(1500):
        s = names[min(7, int(rng.expovariate(0.6)))] if i % 3 else "a"
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(0.9) * 20 % 3000)) if i % 50 else None, s))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken(spark, corpus):
    out = mixing.mix(corpus).collect()
    assert len(out) == corpus.count()
    sizes = {}
    for r in out:
        assert r["size"] == len((r.text or "").split())
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_targets([sizes[s] for s in order]), strict=True))
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r["size"] * r.copies and r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        smallest = min(r["size"] for r in out if r.source == s and r["size"])
        assert abs(taken[s] - want[s]) <= max(smallest, 0.02 * want[s]) + 1
    again = {r.doc_id: r.taken for r in mixing.mix(corpus).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_one_source_is_taken_whole(spark):
    docs = spark.createDataFrame([(i, "x " * (i + 1), "s") for i in range(20)], "doc_id long, text string, source string")
    assert all(r.copies == 1 for r in mixing.mix(docs).collect())


def test_odd_documents(spark, odd_docs):
    out = mixing.mix(odd_docs.withColumnsRenamed({"lang": "size", "n_chars": "copies"})).collect()
    assert len(out) == odd_docs.count()
    assert {r.doc_id: r["size"] for r in out}[1] == 0
    rows = mixing.mixed(odd_docs.withColumnsRenamed({"lang": "size", "n_chars": "copies"}))
    assert rows.columns == ["doc_id", "text", "size", "source", "copies"]
    assert rows.count() == sum(r.copies for r in out)
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    assert mixing.mixed(odd_docs.limit(0)).count() == 0


def test_documents_without_words(spark):
    docs = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0.0, 0), (0.0, 0)]


def test_sample_is_the_prefix_of_a_plain_sort(spark, corpus):
    """Pareto ranks sorted source by source: the longest prefix within the words due, then prefixes of what still fits."""
    out = mixing.mix(corpus).withColumn("u", mixing._uniform("doc_id", mixing.SEED)).collect()
    rules = {(r.source, r["class"]): r for r in mixing.plan(corpus).collect()}
    by_source = {}
    for r in out:
        if r["size"]:
            by_source.setdefault(r.source, []).append(r)
    sampled = 0
    for source, rows in by_source.items():
        rule = {r.doc_id: rules[source, int(math.floor(math.log2(r["size"]) * 2))] for r in rows}
        due = math.floor(rows[0].target - sum(rule[r.doc_id].whole * r["size"] for r in rows) + 0.5)
        rank = {}
        for r in rows:
            p = rule[r.doc_id].p
            if p > 0:
                q = (r.u / (1 - r.u)) / (p / (1 - p))
                rank[r.doc_id] = q / (1 + q)
        # Odds are expected to fill what is due.
        assert sum(rule[r.doc_id].p * r["size"] for r in rows) == pytest.approx(max(due, 0), abs=1 + 1e-6 * rows[0].target)
        taken = set()
        for _ in range(1 + mixing.FILLS):
            left = sorted((rank[r.doc_id], r["size"], r.doc_id) for r in rows if r.doc_id in rank and r.doc_id not in taken and r["size"] <= due)
            total = 0
            for _, size, doc in left:
                if total + size > due:
                    break
                total += size
                taken.add(doc)
            due -= total
        assert {r.doc_id: r.copies for r in rows} == {r.doc_id: rule[r.doc_id].whole + (r.doc_id in taken) for r in rows}
        sampled += len(taken)
    assert sampled > 50


def test_sizes_and_targets_are_those_of_sql(spark):
    """Sizes, source sizes and targets of the test table, in SQL; no source there reaches its limit twice."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    sql = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM '{folder}/documents.parquet'),
    s AS (SELECT source, SUM(size) AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w FROM d GROUP BY source),
    a AS (SELECT *, least(3 * source_size, w * (SELECT SUM(source_size) FROM s) / (SELECT SUM(w) FROM s)) AS t1, w * (SELECT SUM(source_size) FROM s) / (SELECT SUM(w) FROM s) >= 3 * source_size AS full1 FROM s),
    t AS (SELECT *, CASE WHEN full1 THEN 3.0 * source_size ELSE w * ((SELECT SUM(source_size) FROM s) - coalesce((SELECT SUM(3 * source_size) FROM a WHERE full1), 0)) / (SELECT SUM(w) FROM a WHERE NOT full1) END AS target FROM a)
    SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["size"], r.source_size) == want[r.doc_id][:2] and r.target == pytest.approx(float(want[r.doc_id][2]))

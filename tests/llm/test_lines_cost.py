"""What a line's keys cost: no lambda over all keys in each slice, no join for signatures, no count of the whole sample."""

import random

from pyspark.sql import functions as F

from test_lines import DOCS, links_of_all_pairs
from trackloom.llm import lines


def _docs(n, words):
    rng = random.Random(words)
    rows = []
    for i in range(n):
        base = [f"w{rng.randrange(60)}" for _ in range(words)]
        near = list(base)
        for j in rng.sample(range(words), words // 5 + i % 2):
            near[j] = f"x{i}y{j}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    return rows


def test_members_need_no_join_and_no_lambda(spark, monkeypatch):
    every, _ = lines.occurrences(spark.createDataFrame(_docs(10, 100), DOCS), "doc_id", "text")
    nodes = lines.cut(every.withColumn("lid", F.monotonically_increasing_id()))
    plans, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    out = [r for i in range(3) for r in lines._members(nodes, [], 3, i).collect()]
    assert len(plans) == 3 and not any("Join" in p or "lambda" in p for p in plans)
    keys = nodes.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert len(out) == keys > 100


def test_long_lines_are_linked_by_what_travels_with_keys(spark, monkeypatch):
    """Pairs just within and just beyond the similarity, where one, both or none of a pair's lines are long."""
    docs = [r for n in (40, 95, 100, 200) for r in ((i + 1000 * n, t) for i, t in _docs(4, n))]
    found = {r.doc_id: r.text_kept for r in lines.dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert found == links_of_all_pairs(docs)
    assert sorted(i % 1000 for i, t in found.items() if t == "") == [1] * 4 + [5] * 4


def test_the_sample_is_thinned_before_its_keys_are_counted(spark, monkeypatch):
    monkeypatch.setattr(lines, "THINNED", 10)
    monkeypatch.setattr(lines, "SAMPLE", 1)
    counted, counts = [], lines._counts

    def watched(values, bins):
        counted.append((bins, values.count()))
        return counts(values, bins)

    monkeypatch.setattr(lines, "_counts", watched)
    docs = _docs(100, 20)
    out = {r.doc_id: r.text_kept for r in lines.dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert out == links_of_all_pairs(docs)
    assert [n < 200 * 10 / 2 for bins, n in counted if bins == lines.KEY_BINS] == [True]

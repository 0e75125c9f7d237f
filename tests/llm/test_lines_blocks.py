"""Large blocks give the same groups as small ones, and meetings end before they are dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from test_lines import DOCS, corpus, links_of_all_pairs
from trackloom.llm import lines


@pytest.mark.parametrize("small", [1, 3])
def test_large_blocks_are_like_small_ones(spark, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    docs = corpus(4, 40)
    out = lines.dedup(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: r.text_kept for r in out} == links_of_all_pairs(docs)


def test_a_common_pair_does_not_pair_all_lines(spark, monkeypatch):
    """400 unlike lines with one pair of words, and 400 near copies of a line that holds it, too."""
    met, closer = [], lines._closer

    def watched(pairs, *more):
        met.append(pairs.count())
        return closer(pairs, *more)

    monkeypatch.setattr(lines, "_closer", watched)
    copy = "a b c " + " ".join(f"k{j}" for j in range(17))
    rows = [(i, f"a b c x{i} y{i}") for i in range(400)] + [(400 + i, f"{copy} z{i}") for i in range(400)]
    out = {r.doc_id: r.n_removed for r in lines.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {i: int(i > 400) for i in range(800)}
    assert sum(met) < 800 * 799 / 2 / 10


def test_frequent_pairs_come_last(spark):
    """A pair that many lines share is no key of theirs, though its words are rarer than the others, whose pairs are not frequent."""
    rng = random.Random(5)
    rows = [(i, " ".join([*(f"w{rng.randrange(10)}" for _ in range(16)), "p", "q"])) for i in range(1200)]
    every, _ = lines.occurrences(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    blocks = every.select(F.explode("keys").alias("key")).groupBy("key").count()
    assert blocks.agg(F.max("count")).first()[0] < 300

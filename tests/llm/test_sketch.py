import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trackloom.llm import sketch


def shingles(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_likeness(spark, odd_docs):
    rng = random.Random(4)
    rows = [(100 + i, " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 400)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = {r.doc_id: r for r in sketch.with_edits(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for i, d in enumerate(order):
        t, n = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[d]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - share(shingles(t), shingles(edited))) < 0.2
        assert abs(r.near_next - share(shingles(t), shingles(n))) < 0.2
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[5].fingerprint == got[6].fingerprint
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint == ""


def test_small_sketches_are_exact_and_merge(spark):
    texts = [("a b c d e f g h", "c d e f g h i j"), ("", ""), ("x", ""), ("one two", "one two")]
    df = spark.createDataFrame(texts, "s string, t string")
    a, b = sketch.sketch(F.col("s")), sketch.sketch(F.col("t"))
    out = df.select(sketch.resemblance(a, b).alias("r"), sketch.containment(a, b).alias("c"), sketch.distinct_count(a).alias("n"), (sketch.from_text(sketch.to_text(a)) == a).alias("same"))
    assert [(r.r, round(r.c, 9), r.n, r.same) for r in out.collect()] == [(2 / 6, 0.5, 4, True), (1, 1, 0, True), (0, 0, 1, True), (1, 1, 1, True)]


def test_estimates_and_merging_of_parts(spark):
    words = [f"w{i}" for i in range(6000)]
    df = spark.createDataFrame([(0, " ".join(words[:4000])), (0, " ".join(words[2000:])), (1, "a b"), (2, "")], "g int, t string")
    parts = df.select("g", sketch.sketch(F.col("t")).alias("sketch"))
    merged = {r.g: r for r in sketch.merge_all(parts, ["g"]).withColumn("n", sketch.distinct_count(F.col("sketch"))).collect()}
    whole = df.where("g = 0").agg(F.collect_list("t").alias("t")).select(sketch.merge(sketch.sketch(F.col("t")[0]), sketch.sketch(F.col("t")[1])).alias("s")).first().s
    assert merged[0].sketch == whole
    assert merged[0].n == pytest.approx(5996, rel=0.35)
    assert merged[1].n == 1 and merged[2].n == 0


def test_repeats_ties_and_extremes(spark, odd_docs):
    docs = spark.createDataFrame([(1, "x y"), (1, "p q"), (1, "x y"), (None, "z")], "doc_id long, text string")
    out = sketch.with_edits(docs).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in out) == [(False, 3), (False, 3), (False, 3), (True, 1)]
    one = sketch.with_edits(docs.where("doc_id is null")).collect()
    assert one[0].near_next == 1.0
    assert sketch.with_edits(odd_docs.limit(0)).count() == 0


def test_every_copy_of_a_row_has_a_row(spark):
    docs = spark.range(2500).selectExpr("1L as doc_id", "'a b c d e f' as text").union(spark.createDataFrame([(2, "g h i")], "doc_id long, text string"))
    out = sketch.with_edits(docs).groupBy("doc_id", "edited_sha256", "fingerprint").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in out) == [(1, 2500), (2, 1)]


def test_a_hash_that_all_share_is_one_row_of_its_group(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.array(F.lit(-5).cast("long"), F.col("id")).alias("sketch"))
    out = {r.g: r.sketch for r in sketch.merge_all(rows, ["g"], k=4).collect()}
    assert out == {0: [-5, 0, 2, 4], 1: [-5, 1, 3, 5]}

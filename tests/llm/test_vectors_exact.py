"""The last try is audited too, and what stays under the bound is searched exactly."""

from test_vectors import SCHEMA, corpus, plain

from pyspark.sql import functions as F
from trackloom.llm import vectors
from trackloom.llm.vectors import Settings


def test_links_under_the_bound_are_found_exactly(spark, monkeypatch):
    rows = corpus(3, 300)
    lost = vectors.link
    monkeypatch.setattr(vectors, "link", lambda nodes, s: tuple(d.where("false") for d in lost(nodes, s)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: r for r in vectors.near_duplicates(df, settings=Settings(tries=1, max_shard=100)).collect()}
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == {k: tuple(v) for k, v in plain(rows).items()}


def test_audit_is_a_mean_over_linked_nodes(spark):
    """A hub whose links are all found does not hide pairs that are all lost."""
    rows = corpus(4, 600)
    _, nodes = vectors.nodes_of(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    counts, _ = vectors.link(nodes, Settings())
    hub_only = counts.withColumn("links", F.when(F.col("links") < 10, 0).otherwise(F.col("links")))
    assert vectors.audit(nodes, hub_only, Settings(audit=2000)) < 0.9

"""The queries of the text operators: one opN_<name> each, and pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from trackloom.llm.common import table


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import sketch

    return sketch.with_edits(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import tokenfile
    from trackloom.llm.common import scratch_dir

    out = scratch_dir(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), out)
    return tokenfile.digests(tokenfile.read(spark, out))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import lines

    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text_kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import vectors

    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import bpe

    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import secrets

    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_fingerprints": op3_fingerprints,
        "op4_token_files": op4_token_files,
        "op5_line_dedup": op5_line_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_vector_dedup": op7_vector_dedup,
        "op8_bpe": op8_bpe,
        "op9_secrets": op9_secrets,
        "op10_language": op10_language,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force in tests/llm."""
    return {}

"""A training corpus from `documents`: five stages, each an operator of trackloom.llm.

toxicity    documents that the classifier chain finds toxic go
line_dedup  of equal and nearly equal lines one occurrence stays; a document
            that loses its last line goes
near_dedup  of documents with near SimHash fingerprints one stays
mix         documents are taken as often as their source's target weight asks
bpe         texts become token ids, and text again
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, lines, mixing, simhash, toxicity
from trackloom.llm.common import cut, drop_scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text. Only what the stage itself has emptied goes."""
    out = lines.dedup(docs, new="text").withColumn("n_chars", F.length("text").cast("long"))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) == "")
    return out.where(~emptied).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("mix", mix_sources),
    ("bpe", to_tokens),
]

#: Classifiers, near-duplicate groups and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)

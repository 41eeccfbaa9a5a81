"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next.

Language identification drops documents that it rejects, near-duplicate detection
all but the smallest doc_id of a group, substring deduplication the repeated
passages inside texts, decontamination documents that leak a benchmark item; what
stays is packed.

Defined results: documents whose text is null or has no letter are rejected by the
first stage, and with no labelled language all are; rows with a null doc_id pass,
as nothing tells them from others; of rows that share a doc_id all stay or go
together; where every document goes, and for an empty table, nothing is packed.
Very long texts go through every stage whole.  A stage's own columns never meet those
of documents: each takes what it needs and joins back by doc_id, so that extra
columns of any name stay as they are until packing, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontaminate, language_id, near_dedup, packing, substring_dedup, tables


#: Whether documents that hold an item of fewer than `decontaminate.MIN_BYTES` bytes of words are dropped.
DROP_SHORT = False


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    return language_id.accepted(docs, language_id.model_of(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    others = tables.written(near_dedup.groups(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id"), "copies")
    return docs.join(tables.checked(others), "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document before them has."""
    out = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; an item of a few short words, which clean texts hold too, drops none (`DROP_SHORT`)."""
    found = decontaminate.leaks(docs.select("doc_id", "text"), tables.read(spark, sf_dir, "benchmark").select("item_id", "text"))
    found = found if DROP_SHORT else found.where(~F.col("short"))
    return docs.join(tables.checked(tables.written(found.select("doc_id").distinct(), "leaks")), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of fixed length."""
    return packing.pack(docs.select("doc_id", "source", "text"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontaminate", without_leaks),
    ("packing", packed),
]

#: SQL has no tokenizer and no learned model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over `documents`."""
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

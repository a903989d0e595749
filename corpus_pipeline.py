"""Cleaning of the documents table in five stages; each reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ndcollect.llm import decontam, exact_dedup, jaccard, langid, sentencepiece_bridge
from ndcollect.llm.common import discard, materialize, scratch, table
from ndcollect.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages that the labelled documents teach."""
    return langid.keep_identified(docs, langid.fit(docs, ~langid.held_out(5)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of smallest id stays."""
    return jaccard.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, round_trip, parity of every document that is left."""
    return sentencepiece_bridge.encode(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

#: Language models, sketches and tokenizers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:  # a stage's own tables go once its output is written
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs)
        if hasattr(before, "written_to"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

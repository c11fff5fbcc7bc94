"""A cleaning pipeline over `documents`: five stages, each written as a table and read again as the next one's input.

toxicity         documents that are predicted toxic go
near_duplicates  of each group linked by word shingles the document of smallest doc_id stays
decontaminate    documents that hold a benchmark item go
pii              personal data and disclosing terms are masked
pieces           every text becomes a sampled segmentation, checked by decoding it

Every stage takes any columns beside doc_id and text, whatever their names, and all but the last return them as they were.
Null and empty texts get the score of an empty text, link with nothing, hold no item and no personal data, and have no
pieces: they stay, as null or empty. Rows without a doc_id are judged by their text and never go as duplicates. Repeated
rows share their fate: of rows with the smallest doc_id of a group all stay. Texts of any length are judged whole. An
empty table stays empty in every stage. Without labels nothing is toxic, without a benchmark nothing is leaked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontam, ngramjoin, piecesampling, pii, toxicity
from tokenloom.llm.common import drop, settled, table
from tokenloom.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it is fitted on the labelled ones."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return ngramjoin.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; n_chars follows the text."""
    masked = pii.sanitise(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: piece ids, their number and checksum, and whether decoding gives the text back."""
    return piecesampling.training_rows(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", mask_pii),
    ("pieces", pieces),
]

#: Models and similarity joins are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage took on the way, and its input, is deleted once its output is written."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, f"pipeline-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

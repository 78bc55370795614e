"""A training corpus from raw documents: language, exact copies, near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs``.

Defined cases, for all stages: a null or empty text has no language and goes in the first stage, as do texts without letters; null ids
and null sources are values of their own; very long texts are taken whole; ties and repeated rows are settled by the smallest id, then
by the other columns; extra columns are carried, whatever their names; an empty table stays empty, and packs into no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import content_sort, golay_simhash, langid, mixing, packing
from corpusmill.workspace import Workspace

TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay; those without letters, or between languages, go."""
    return langid.keep_identified(docs, public_tokenizers.path(TOKENIZER))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents found alike, with a similarity of 0.8 or more in five-word shingles, the smallest id of each group stays; candidates come from fingerprints and bands of min-hashes, and README says how surely they are found."""
    return golay_simhash.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; a document cut by the end of its source's mix brings the words taken. Packing deals pieces anew, so the mix needs no order here."""
    return mixing.mixed_documents(docs, ordered=False).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, fingerprints and packing have no SQL form; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
        if last is not None:
            ws.drop(last)
        last = docs
    return docs

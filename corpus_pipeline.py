"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Every stage reads what the one before it kept and wrote, so an executor that is lost costs its own tasks only.
The first four return the columns of documents; the last returns (doc_id, token_ids, n_tokens, text) with the
text as decoded from the ids.

Defined results: documents with null or wordless texts have no language and go in the first stage; empty tables
pass through all stages; rows that repeat leave one row; null ids are kept; columns beyond those of documents are
carried through the first four stages whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lahja.llm import bpe, langid
from lahja.llm._spark import Scratch, spread
from lahja.llm.decontaminate import decontaminate
from lahja.llm.exact_dedup import exact_dedup
from lahja.llm.ngram_join import drop_near


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language is told with the usual margin."""
    return langid.accepted(docs, langid.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near documents."""
    return drop_near(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and the text that they decode to."""
    return bpe.decode(bpe.encode(docs))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", token_ids),
]

#: Language ID and BPE can't be said in SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    io = Scratch(spark, "pipeline")
    docs = spread(io, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for _, stage in STAGES[:-1]:
        after = spread(io, io.write(stage(spark, docs, sf_dir)))
        io.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

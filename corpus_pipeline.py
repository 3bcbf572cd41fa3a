"""A corpus pipeline of four operators of lociflow.llm.

STAGES are (name, function) pairs, in order: documents of low quality go, one document of each near-duplicate group
stays, sources are mixed to their target weights, and the rest is packed into token sequences. A function takes (spark,
docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared folder, and the next
stage reads them. All but the last return the columns of docs. Empty docs pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociflow.llm import mixing, packing, quality_qda, simhash_dedup
from lociflow.llm.common import materialise
from lociflow.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; its labels are the table beside the documents."""
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints link, that with the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row for each time that a document is taken, with the words taken."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("dedup", dedup), ("mix", mix), ("pack", pack)]

#: Stages of trained models, fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

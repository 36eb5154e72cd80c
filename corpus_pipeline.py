"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``documents``:

1. toxicity: documents predicted to be toxic go;
2. quality rules: documents that fail the base rules or leave their language's perplexity
   bands go;
3. MinHash near-dedup (five words, similarity 0.8): one document of each group stays;
4. mixing: the words that the mix takes, a row for each document and pass over its source;
5. SentencePiece encoding: ``doc_id``, ``ids`` and ``n_tokens`` of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import minhash, mixing, piece_viterbi, quality, toxicity
from quarry.llm.storage import cut
from quarry.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return piece_viterbi.encode_documents(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece_encoding", encode),
]

#: The stages learn models and draw from pseudorandom permutations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

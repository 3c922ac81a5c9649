"""A training-data pipeline over ``documents``: five stages, each one operator of ``tabreg.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``. Empty tables pass through as such.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabreg.llm import bwt, golay, language_id, packing, wumanber
from tabreg.llm.queries import TOKENIZER, table
from tabreg.session import ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the rest goes."""
    return language_id.keep_known(docs, language_id.fit(docs), host_col="source", declared_col="lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return golay.keep_one(docs, shingle=golay.SHINGLE, max_bits=golay.MAX_BITS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur elsewhere too; every document stays."""
    return bwt.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages."""
    return wumanber.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", identify_language), ("simhash_near_dedup", drop_near_duplicates),
          ("suffix_array_dedup", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]

#: The stages use hashes, models and tokenizers that SQL lacks; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

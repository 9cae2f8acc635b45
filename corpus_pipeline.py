"""A corpus pipeline in stages, each calling one operator of memspark.llm.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the
last return the columns of ``docs``. Null texts count as empty in every stage and repeated
rows are rows of their own, as the operators state; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.common import Scratch
from memspark.llm.exact_dedup import deduplicated
from memspark.llm.mixing import mixed_documents
from memspark.llm.packing import pack_documents
from memspark.llm.simhash import without_near_duplicates
from memspark.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest stays."""
    return deduplicated(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-duplicate links, the one with the smallest id stays."""
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a document that the mix takes twice is there twice."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece, with its token ids and its place."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SimHash and the toxicity model have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what each returns is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)

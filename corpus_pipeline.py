"""From raw documents to shards of a training mix: five stages, each an operator of lexiloom.llm.

Each stage works on all that its predecessor kept. Between the stages the documents are a Parquet table in the shared
folder, so a lost executor costs a stage's tasks and no more. A row stays or goes as a whole, with all its columns.

Null, empty or letterless texts: rejected by the first stage, as no language is found. Null doc_id: never a near copy,
else as any row. Null source: a source of its own. Repeated rows: the same result each, but near copies of another row go
with their doc_id. Ties: the least doc_id of near copies stays. Very long texts: read whole. Empty table: no rows. Columns
whose names clash with the operators' own are kept, but those called as the placement (region, rack, shard) give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import decontam, langid, mixing, sharding, simhash
from lexiloom.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show; others go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mix at the sources' target weights; a source that runs out leaves the mix."""
    return mixing.mixed(docs, WEIGHTS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its region, rack and shard."""
    return sharding.shard(docs)


#: parts of the mix by source; a source that isn't here has its own share beside them
WEIGHTS = mixing.WEIGHTS
STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]
ORACLE_SQL = None  # language vectors and SimHash can't be said in SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs)
    return docs

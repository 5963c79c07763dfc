"""A training corpus from raw documents: five stages, each one of the operators in tessera.llm.

1. toxicity: documents that the classifier rejects go;
2. n-gram Jaccard join: of each group of similar documents (five-word shingles, similarity 0.8) one stays;
3. benchmark decontamination: benchmark passages are cut out, documents that are mostly benchmark go;
4. mixing: each document is repeated or left out so that sources come to their target shares;
5. sharding: every row gets its shard and place.

Each function takes (spark, docs, sf_dir); all but the last return the columns of documents. ``run`` writes each stage's
result as Parquet into the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from tessera.llm.store import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 40


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs.select(COLUMNS), n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs.select(COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, SHARDS)


STAGES = [("toxicity", toxic), ("ngram_join", similar), ("decontamination", benchmark), ("mixing", mix), ("sharding", shard)]
#: The classifier and the balanced sample can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

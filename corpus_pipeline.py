"""The corpus pipeline: stages that take and return documents, each written and read again.

Each stage has the defined cases of its operator, so of the whole: a document whose text is null, empty or without a letter has
no language and goes in the first stage; of rows that repeat a doc_id the second keeps one, that with the greatest text; rows without a
doc_id (or with one that is no integer) pass all stages but the last, which samples by it and leaves them out. Of equal texts, and of near copies, the
smallest doc_id stays, and of passages the first by doc_id and position, whatever the order of the table. Other columns, of
any type and name, are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import decontaminate, jaccard_join, language_id, mixing, suffix_dedup
from lodegraph.llm._frames import shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_sample(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Suffix automata and model fits have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads it any more
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs

"""A corpus pipeline over ``documents``: each stage works on all that the one before kept.

    quality classifier     documents that it rejects go
    line dedup             lines that repeat an earlier line go, all documents stay
    near dedup             one document of each group of near copies stays
    decontamination        documents that hold benchmark passages go
    packing                what is left, as pieces of token sequences

All stages but the last return the columns of their input. ``run`` writes each stage's rows to the shared folder
and reads them again, so that a lost executor costs one stage at most. The classifier has no SQL form: the
pipeline is tested against its stages done by brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwell.llm import decontaminate, linededup, neardup, pack, quality
from pairwell.llm.tables import written

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.harmonic(docs, pack.tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="pairwell-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A side of a join is broadcast only if its counted rows times their bytes stay below this.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table with a broadcast hint if it is small; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df

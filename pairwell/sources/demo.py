"""A synthetic cohort with age-driven selection bias, of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def biased_cohort(spark: SparkSession, n: int = 400, seed: int = 42) -> DataFrame:
    """Older units are likelier to be treated, and the score rises with age."""
    age = F.least(F.greatest(F.randn(seed) * 12 + 50, F.lit(20.0)), F.lit(85.0))
    aged = spark.range(n).select(F.col("id").alias("patient_id"), age.alias("age"))
    chance = 1 / (1 + F.exp(-(F.lit(-4.0) + 0.08 * F.col("age"))))
    return aged.select(
        "patient_id",
        "age",
        (0.5 * F.col("age") + 8 * F.randn(seed + 1)).alias("clinical_score"),
        (1 + F.floor(F.rand(seed + 2) * 59)).cast("long").alias("followup_months"),
        (F.rand(seed + 3) < chance).cast("int").alias("treatment"),
    )

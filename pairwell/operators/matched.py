"""What a matching yields: the matched rows, the units left over, and diagnostics of the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import exact_quantiles, running_total
from ..functions.tools import attach, materialise, named
from .cohort import role_names


def number_pairs(cohort: DataFrame, pairs: DataFrame, id_col: str, by_query: bool = True) -> DataFrame:
    """Add ``pair_id``: the query's place in its stratum, shifted past the largest id of the strata before.

    Pairs of one query share an id. ``by_query=False`` counts matched queries only.
    """
    seats = cohort.where("role = 'query'").select("stratum", named(id_col).alias("query_id"))
    if not by_query:
        seats = seats.join(pairs.select("query_id").distinct(), "query_id", "left_semi")
    seats = running_total(seats, ["stratum"], ["query_id"], out="_seat").withColumn("_seat", F.col("_seat") - 1)
    placed = materialise(pairs.join(seats.select("query_id", "_seat"), "query_id"))
    spans = placed.groupBy("stratum").agg((F.max("_seat") + 1).alias("_span"))
    spans = running_total(spans, [], ["stratum"], "_span", "_end")
    shift = spans.select("stratum", (F.col("_end") - F.col("_span")).alias("_shift"))
    return attach(placed, shift, ["stratum"]).withColumn("pair_id", F.col("_seat") + F.col("_shift")).drop("_seat", "_shift")


def matched_dataset(
    cohort: DataFrame, pairs: DataFrame, id_col: str, direction: str = "treated_to_control", by_query: bool = True
) -> DataFrame:
    """Both members of every pair as rows of the cohort, with ``pair_id``, ``weights`` and ``__role__``."""
    numbered = materialise(number_pairs(cohort, pairs, id_col, by_query))
    members = []
    for side, name in zip(("query_id", "pool_id"), role_names(direction)):
        keys = numbered.select(named(side).alias(id_col), "pair_id", F.lit(1.0).alias("weights"), F.lit(name).alias("__role__"))
        members.append(cohort.drop("role").join(keys, id_col))
    return members[0].unionByName(members[1], allowMissingColumns=True)


def selected_dataset(cohort: DataFrame, selection: DataFrame, id_col: str) -> DataFrame:
    """The selected pool units as rows of the cohort; no pairs, so ``pair_id`` is NULL."""
    keys = selection.select(
        F.col("pool_id").alias(id_col), F.lit(None).cast("long").alias("pair_id"), F.col("weight").alias("weights"), F.lit("selected").alias("__role__")
    )
    return cohort.drop("role").join(keys, id_col)


def unmatched_queries(cohort: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    used = pairs.select(F.col("query_id").alias(id_col))
    return cohort.where("role = 'query'").join(used, id_col, "left_anti")


def pair_diagnostics(pairs: DataFrame) -> DataFrame:
    """Distribution of the pair distances and how many pool units serve more than one pair; zeros without pairs."""
    probs = {"median_distance": 0.5, "p25_distance": 0.25, "p75_distance": 0.75}
    quantiles = exact_quantiles(pairs.select("dist"), ["dist"], sorted(probs.values()))
    wide = quantiles.agg(
        *[F.coalesce(F.max(F.when(F.col("prob") == p, F.col("value"))), F.lit(0.0)).alias(n) for n, p in probs.items()]
    )
    zero = F.lit(0.0)
    basic = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(F.avg("dist"), zero).alias("mean_distance"),
        F.coalesce(F.min("dist"), zero).alias("min_distance"),
        F.coalesce(F.max("dist"), zero).alias("max_distance"),
    )
    reuse = pairs.groupBy("pool_id").count().agg(F.count_if(F.col("count") > 1).alias("n_pool_units_reused"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(basic).join(one(wide), "_one").join(one(reuse), "_one").drop("_one")


def population_diagnostics(cohort: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many query units found a partner."""
    sizes = cohort.agg(F.count_if(F.col("role") == "query").alias("n_query_total"), F.count_if(F.col("role") == "pool").alias("n_pool_total"))
    done = pairs.groupBy("query_id").agg(F.count(F.lit(1))).agg(F.count(F.lit(1)).alias("n_query_matched"))
    both = sizes.withColumn("_one", F.lit(1)).join(done.withColumn("_one", F.lit(1)), "_one").drop("_one")
    total, matched = F.col("n_query_total"), F.col("n_query_matched")
    return both.withColumn("n_query_unmatched", total - matched).withColumn(
        "match_rate", F.when(total > 0, matched / total).otherwise(0.0)
    )


__all__ = ["matched_dataset", "number_pairs", "pair_diagnostics", "population_diagnostics", "selected_dataset", "unmatched_queries"]

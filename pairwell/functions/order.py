"""Positions, running totals and exact quantiles of tables of any size.

A window over a whole group would sort that group in one task. Here the rows are
range-partitioned first; a group that spans many partitions is ranked inside each of
them and shifted by the total of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tools import BROADCAST_ROWS, attach, materialise, melt_numeric, named


def running_totals(df: DataFrame, group: list[str], order: list[str], amounts: dict[str, str | None]) -> DataFrame:
    """Add inclusive running totals per group: ``{new column: summed column, or None to count rows}``.

    ``order`` must make the rows of a group distinct. Group columns must not be NULL.
    """
    outs = list(amounts)
    steps = {o: F.lit(1).cast("long") if c is None else named(c) for o, c in amounts.items()}
    sliced = df.withColumns(steps).repartitionByRange(*[named(c) for c in [*group, *order]])
    sliced = materialise(sliced.withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*group, "_slice").agg(*[F.sum(o).alias(f"_sum_{o}") for o in outs])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        *group, "_slice", *[F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).alias(f"_shift_{o}") for o in outs]
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.withColumns({o: F.sum(o).over(inside) for o in outs})
    shifted = attach(ranked, shift, [*group, "_slice"])
    shifted = shifted.withColumns({o: named(o) + F.col(f"_shift_{o}") for o in outs})
    return shifted.drop("_slice", *[f"_shift_{o}" for o in outs])


def running_total(
    df: DataFrame, group: list[str], order: list[str], amount: str | None = None, out: str = "position"
) -> DataFrame:
    """One running total; the row's position (from 1) if no amount is named."""
    return running_totals(df, group, order, {out: amount})


def value_counts(long_df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return long_df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], group: list[str] = (), method: str = "linear"
) -> DataFrame:
    """Exact quantiles of many columns: rows ``(group…, variable, prob, value)``.

    ``linear`` interpolates between the two neighbouring order statistics, ``nearest``
    takes the one at position ``round((n-1)·prob)``.
    Equal values are counted before they are ordered, so a value that fills a third
    of the table is a single row by then.
    """
    group = list(group)
    keys = [*group, "variable"]
    counts = materialise(value_counts(melt_numeric(df, columns, group), keys))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    ranked = attach(running_total(counts, keys, ["value"], "n", "upto"), sizes, keys)

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("value")))

    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("_size") - 1) * F.lit(float(p))
        low = F.round(place, 0) if method == "nearest" else F.floor(place)
        high = low if method == "nearest" else F.ceil(place)
        aggs += [at(low).alias(f"lo__{i}"), at(high).alias(f"hi__{i}")]
    found = ranked.groupBy(*keys).agg(F.max("_size").alias("_size"), *aggs)
    cells = []
    for i, p in enumerate(probs):
        place = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.col(f"lo__{i}"), F.col(f"hi__{i}")
        value = low if method == "nearest" else low + (high - low) * (place - F.floor(place))
        cells.append(F.struct(F.lit(float(p)).alias("prob"), value.alias("value")))
    return found.select(*keys, F.explode(F.array(*cells)).alias("_q")).select(*keys, "_q.prob", "_q.value")


__all__ = ["BROADCAST_ROWS", "exact_quantiles", "running_total", "value_counts"]

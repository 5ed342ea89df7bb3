"""Profile of both groups before matching: six tables."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.tools import attach, complete_rows, few_values, is_numeric, melt_numeric, melt_text, named, wide_to_long
from .balance import yates_chi2

FEW_VALUES = 7  # fixed value: numeric covariates with fewer distinct values count as categories
GRID_POINTS = 200  # fixed value: points of a density curve

_GROUP = {1: "treated", 0: "control"}


def _group_name(treatment_col: str):
    return F.when(named(treatment_col) == 1, "treated").when(named(treatment_col) == 0, "control")


def _grouped(df: DataFrame, treatment_col: str, covariates: list[str]) -> DataFrame:
    absent = [c for c in covariates if c not in df.columns]
    if absent:
        raise ConfigError(f"covariates not in the table: {absent}")
    return df.where(named(treatment_col).isin(0, 1)).select(
        _group_name(treatment_col).alias("group"), *map(named, covariates)
    )


def routes(df: DataFrame, covariates: list[str]) -> tuple[list[str], list[str]]:
    """(continuous, category-like) covariates, by distinct count."""
    numeric = [c for c in covariates if is_numeric(df, c)]
    few = few_values(df, numeric, FEW_VALUES - 1)
    continuous = [c for c in numeric if few[c] is None]
    return continuous, [c for c in covariates if c not in continuous]


def descriptive_stats(df: DataFrame, treatment_col: str, covariates: list[str]) -> DataFrame:
    numeric = [c for c in covariates if is_numeric(df, c)]
    data = _grouped(df, treatment_col, numeric)
    aggs = []
    for i, c in enumerate(numeric):
        x = named(c).cast("double")
        aggs += [
            F.avg(x).alias(f"mean__{i}"),
            F.stddev_samp(x).alias(f"std__{i}"),
            F.min(x).alias(f"min__{i}"),
            F.max(x).alias(f"max__{i}"),
        ]
    if not numeric:
        return df.sparkSession.createDataFrame(
            [], "group string, variable string, mean double, std double, min double, max double"
        )
    return wide_to_long(data.groupBy("group").agg(*aggs), numeric, ["mean", "std", "min", "max"], ["group"])


def missingness(df: DataFrame, treatment_col: str, covariates: list[str]) -> DataFrame:
    """Share of NULLs per covariate in each group."""
    aggs = []
    for i, c in enumerate(covariates):
        for g, name in _GROUP.items():
            share = F.avg(F.when(named(treatment_col) == g, named(c).isNull().cast("double")))
            aggs.append(F.coalesce(share, F.lit(0.0)).alias(f"{name}_missing_pct__{i}"))
    return wide_to_long(df.agg(*aggs), covariates, [f"{n}_missing_pct" for n in _GROUP.values()])


def frequencies(df: DataFrame, treatment_col: str, covariates: list[str]) -> DataFrame:
    """Share of each value within each group, zero where a group lacks it."""
    data = _grouped(df, treatment_col, covariates)
    counts = melt_text(data, covariates, ["group"]).groupBy("variable", "value").agg(
        F.count_if(F.col("group") == "treated").alias("k1"), F.count_if(F.col("group") == "control").alias("k0")
    )
    totals = counts.groupBy("variable").agg(F.sum("k1").alias("n1"), F.sum("k0").alias("n0"))
    share = lambda k, n: F.when(named(n) > 0, named(k) / named(n)).otherwise(0.0)
    return attach(counts, totals, ["variable"], rows=len(covariates)).select(
        "variable",
        F.col("value").alias("category"),
        share("k1", "n1").alias("treated_frequency"),
        share("k0", "n0").alias("control_frequency"),
    )


def _kernel_sums(state: dict, covariates: list[str]):
    """Kernel sums of all rows of a task, per covariate, group and grid point: they add up over tasks."""

    def sums(batches):
        total = {key: np.zeros(GRID_POINTS) for key in state}
        for batch in batches:
            group = batch["group"].to_numpy()
            for (variable, name), (start, step, h) in state.items():
                x = batch[f"x{covariates.index(variable)}"].to_numpy(float)[group == name]
                x, n = np.unique(x[~np.isnan(x)], return_counts=True)
                grid = start + step * np.arange(GRID_POINTS)
                for i in range(0, len(x), 4096):
                    z = (grid[None, :] - x[i : i + 4096, None]) / h
                    total[(variable, name)] += n[i : i + 4096] @ np.exp(-0.5 * z * z)
        yield pd.DataFrame({"variable": [v for v, _ in total], "group": [g for _, g in total], "masses": [m.tolist() for m in total.values()]})

    return sums


def densities(df: DataFrame, treatment_col: str, covariates: list[str]) -> DataFrame:
    """Gaussian density curves (Scott bandwidth) of both groups on one 200-point grid per covariate."""
    spark = df.sparkSession
    if not covariates:
        return spark.createDataFrame([], "variable string, point int, x double, treated_density double, control_density double")
    data = _grouped(df, treatment_col, covariates)
    aggs = []
    for i, c in enumerate(covariates):
        x = named(c).cast("double")
        aggs += [F.count(x).alias(f"n__{i}"), F.min(x).alias(f"lo__{i}"), F.max(x).alias(f"hi__{i}"), F.stddev_samp(x).alias(f"s__{i}")]
    facts = wide_to_long(data.groupBy("group").agg(*aggs), covariates, ["n", "lo", "hi", "s"], ["group"]).collect()
    kernels, curves = {}, []
    for c in covariates:
        mine = [r for r in facts if r["variable"] == c and r["n"]]
        low, high = min((r["lo"] for r in mine), default=0.0), max((r["hi"] for r in mine), default=0.0)
        if low == high:
            continue
        pad = 0.05 * (high - low)
        start, step = low - pad, (high - low + 2 * pad) / (GRID_POINTS - 1)
        for name in _GROUP.values():
            r = next((r for r in mine if r["group"] == name), None)
            scale = 0.0
            if r is not None and r["n"] > 1 and r["hi"] > r["lo"]:
                h = r["s"] * r["n"] ** -0.2
                kernels[(c, name)] = (start, step, h)
                scale = 1.0 / (r["n"] * h * float(np.sqrt(2 * np.pi)))
            curves.append((c, name, start, step, scale))
    schema = "variable string, group string, start double, step double, scale double"
    points = spark.createDataFrame(curves, schema).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))))
    rows = data.select("group", *[named(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)])
    mass = (
        rows.mapInPandas(_kernel_sums(kernels, covariates), "variable string, group string, masses array<double>")
        .select("variable", "group", F.posexplode("masses").alias("point", "mass"))
        .groupBy("variable", "group", "point")
        .agg(F.sum("mass").alias("mass"))
    )
    both = points.join(mass, ["variable", "group", "point"], "left")
    density = F.coalesce("mass", F.lit(0.0)) * F.col("scale")
    at = lambda name: F.max(F.when(F.col("group") == name, density))
    return both.groupBy("variable", "point").agg(
        F.max(F.col("start") + F.col("step") * F.col("point")).alias("x"),
        at("treated").alias("treated_density"),
        at("control").alias("control_density"),
    )


def pearson_matrix(df: DataFrame, treatment_col: str, variables: list[str]) -> DataFrame:
    """Correlations per group over the rows that have every variable: ``(group, var_i, var_j, r)``."""
    schema = "group string, var_i string, var_j string, r double"
    spark = df.sparkSession
    if len(variables) < 2:
        return spark.createDataFrame([], schema)
    data = complete_rows(_grouped(df, treatment_col, variables), variables)
    pairs = list(combinations(range(len(variables)), 2))
    corr = [F.corr(named(variables[i]).cast("double"), named(variables[j]).cast("double")).alias(f"r__{k}") for k, (i, j) in enumerate(pairs)]
    spread = [F.stddev_pop(named(v)).alias(f"_s{i}") for i, v in enumerate(variables)]
    wide = data.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), *corr, *spread)
    groups = spark.createDataFrame([(g,) for g in _GROUP.values()], "group string")
    wide = groups.join(wide, "group", "left")
    cells = []
    for k, (i, j) in enumerate(pairs):
        r = F.coalesce(F.nanvl(F.col(f"r__{k}"), F.lit(0.0)), F.lit(0.0))
        for a, b in ((i, j), (j, i)):
            cells.append(F.struct(F.lit(variables[a]).alias("var_i"), F.lit(variables[b]).alias("var_j"), r.alias("r")))
    for i, v in enumerate(variables):
        own = F.when((F.coalesce("_n", F.lit(0)) >= 2) & (F.col(f"_s{i}") == 0), 0.0).otherwise(1.0)
        cells.append(F.struct(F.lit(v).alias("var_i"), F.lit(v).alias("var_j"), own.alias("r")))
    return wide.select("group", F.explode(F.array(*cells)).alias("_c")).select("group", "_c.*")


def cramers_v_matrix(df: DataFrame, treatment_col: str, variables: list[str]) -> DataFrame:
    """Association of category-like covariates per group, from contingency counts: ``(group, var_i, var_j, v)``."""
    schema = "group string, var_i string, var_j string, v double"
    spark = df.sparkSession
    if len(variables) < 2:
        return spark.createDataFrame([], schema)
    pairs = list(combinations(range(len(variables)), 2))
    data = _grouped(df, treatment_col, variables)
    texts = [named(v).cast("string") for v in variables]
    cells = [F.struct(F.lit(k).alias("pair"), texts[i].alias("a"), texts[j].alias("b")) for k, (i, j) in enumerate(pairs)]
    counts = (
        data.select("group", F.explode(F.array(*cells)).alias("_c"))
        .select("group", "_c.*")
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("group", "pair", "a", "b")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    keys = ["group", "pair"]
    rows = counts.groupBy(*keys, "a").agg(F.sum("k").alias("ra"))
    cols = counts.groupBy(*keys, "b").agg(F.sum("k").alias("cb"))
    fit = (
        counts.join(rows, [*keys, "a"])
        .join(cols, [*keys, "b"])
        .groupBy(*keys)
        .agg(
            F.sum("k").alias("n"),
            F.sum(F.col("k") / F.col("ra") * F.col("k") / F.col("cb")).alias("fit"),
            F.max(F.struct("a", "b", "k", "ra", "cb")).alias("top"),
        )
    )
    levels_a = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("la"))
    levels_b = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("lb"))
    facts = fit.join(levels_a, keys).join(levels_b, keys)
    n, top = F.col("n"), F.col("top")
    a = top["k"]
    corrected = yates_chi2(a, top["ra"] - a, top["cb"] - a, n - top["ra"] - top["cb"] + a)
    chi2 = F.when((F.col("la") == 2) & (F.col("lb") == 2), corrected).otherwise(n * (F.col("fit") - 1))
    smaller = F.least("la", "lb") - 1
    v = F.when(smaller > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (n * smaller))).otherwise(0.0)
    found = facts.select(*keys, F.least(v, F.lit(1.0)).alias("v"))
    frame = [(g, k, variables[i], variables[j]) for g in _GROUP.values() for k, (i, j) in enumerate(pairs)]
    frame = spark.createDataFrame(frame, "group string, pair int, var_i string, var_j string")
    upper = frame.join(found, keys, "left").select("group", "var_i", "var_j", F.coalesce("v", F.lit(0.0)).alias("v"))
    lower = upper.select("group", F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), "v")
    own = spark.createDataFrame([(g, v, v, 1.0) for g in _GROUP.values() for v in variables], schema)
    return upper.unionByName(lower).unionByName(own)


@dataclass(frozen=True)
class PopulationProfile:
    descriptive_stats: DataFrame
    densities: DataFrame
    frequencies: DataFrame
    missingness: DataFrame
    numerical_correlations: DataFrame
    categorical_correlations: DataFrame
    continuous: list[str]
    category_like: list[str]


def profile_population(df: DataFrame, treatment_col: str, covariates: list[str]) -> PopulationProfile:
    continuous, few = routes(df, covariates)
    return PopulationProfile(
        descriptive_stats(df, treatment_col, covariates),
        densities(df, treatment_col, continuous),
        frequencies(df, treatment_col, few),
        missingness(df, treatment_col, covariates),
        pearson_matrix(df, treatment_col, continuous),
        cramers_v_matrix(df, treatment_col, few),
        continuous,
        few,
    )




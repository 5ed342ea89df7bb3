"""Propensity scores: one penalised logistic model per stratum, all strata fitted together.

Every Newton step is one pass over the cohort: tasks add up the gradient and curvature of
the rows they hold per stratum, the sums are reduced by key, and each stratum's small
linear system is solved on its own row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MatchError
from ..functions.tools import attach, materialise, named, with_size
from .cohort import LOGIT, PS

CLIP = 1e-6  # fixed value: scores stay within [CLIP, 1 - CLIP]
FLUSH_STRATA = 2000  # partial sums of this many strata are handed on at once


@dataclass(frozen=True)
class PropensitySpec:
    degree: int = 3
    C: float = 0.5
    max_iter: int = 5000
    tolerance: float = 1e-9


@dataclass
class PropensityModel:
    """Fitted coefficients per stratum (intercept first) with the standardisation of every term."""

    covariates: list[str]
    spec: PropensitySpec
    state: DataFrame  # stratum, mu, sd, beta
    rows: int
    iterations: int


def monomials(covariates: list[str], degree: int) -> list[Column]:
    """All products of the covariates up to a degree, without the constant."""
    xs = {c: named(c).cast("double") for c in covariates}
    return [
        reduce(lambda a, b: a * b, [xs[c] for c in combo])
        for d in range(1, degree + 1)
        for combo in combinations_with_replacement(covariates, d)
    ]


def _unpack(size: int):
    upper = np.triu_indices(size)

    def split(flat):
        h = np.zeros((size, size))
        h[upper] = flat[: len(upper[0])]
        h = h + h.T - np.diag(np.diag(h))
        g = np.asarray(flat[len(upper[0]) : len(upper[0]) + size])
        return h, g, flat[-1]

    return upper, split


def _partial_sums(size: int):
    """Per task: curvature, gradient and loss of its rows, one line per stratum and entry."""
    upper, _ = _unpack(size)

    def lines(sums):
        for key, flat in sums.items():
            yield pd.DataFrame({"stratum": key, "i": np.arange(len(flat), dtype=np.int32), "v": flat})

    def run(batches):
        sums = {}
        for batch in batches:
            for key, part in batch.groupby("stratum", sort=False):
                z = np.column_stack([np.ones(len(part)), np.stack(part["z"].to_numpy())])
                y = part["y"].to_numpy(float)
                eta = z @ np.asarray(part["beta"].iloc[0])
                p = np.where(eta >= 0, 1 / (1 + np.exp(-np.abs(eta))), np.exp(-np.abs(eta)) / (1 + np.exp(-np.abs(eta))))
                h = (z * (p * (1 - p))[:, None]).T @ z
                loss = np.sum(np.logaddexp(0, eta) - y * eta)
                flat = np.concatenate([h[upper], z.T @ (p - y), [loss]])
                sums[key] = sums[key] + flat if key in sums else flat
            if len(sums) > FLUSH_STRATA:
                yield from lines(sums)
                sums = {}
        yield from lines(sums)

    return run


def _newton_step(size: int, c: float):
    _, split = _unpack(size)

    @F.pandas_udf("beta array<double>, base array<double>, objective double, moved double")
    def step(flat: pd.Series, beta: pd.Series, base: pd.Series, best: pd.Series) -> pd.DataFrame:
        out = []
        for f, b, b0, top in zip(flat, beta, base, best):
            h, g, loss = split(np.asarray(f))
            b, b0 = np.asarray(b), np.asarray(b0)
            penalty = np.ones(size)
            penalty[0] = 0.0
            objective = c * loss + 0.5 * np.sum(penalty * b * b)
            if objective > top + 1e-9 * abs(top):
                new = (b + b0) / 2  # overshoot: go half the way back
                out.append((new, b0, top, float(np.abs(new - b).max())))
                continue
            move = np.linalg.solve(c * h + np.diag(penalty + 1e-12), c * g + penalty * b)
            out.append((b - move, b, objective, float(np.abs(move).max())))
        return pd.DataFrame(out, columns=["beta", "base", "objective", "moved"])

    return step


def fit_propensity(
    df: DataFrame, treatment_col: str, covariates: list[str], spec: PropensitySpec = PropensitySpec()
) -> PropensityModel:
    """Fit P(treated) per ``stratum`` on standardised polynomial terms. Strata with one group are left out."""
    terms = monomials(covariates, spec.degree)
    size = len(terms) + 1
    base = df.where(reduce(lambda a, b: a & b, [named(c).isNotNull() for c in covariates]))
    base = base.select("stratum", (named(treatment_col) == 1).cast("double").alias("y"), *[t.alias(f"m{i}") for i, t in enumerate(terms)])
    ms = [f"m{i}" for i in range(len(terms))]
    stats = base.groupBy("stratum").agg(
        F.sum("y").alias("_n1"),
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.avg(m) for m in ms]).alias("mu"),
        F.array(*[F.stddev_pop(m) for m in ms]).alias("sd"),
    )
    stats = stats.where((F.col("_n1") > 0) & (F.col("_n1") < F.col("_n"))).select(
        "stratum", "mu", F.transform("sd", lambda s: F.when(s > 0, s).otherwise(1.0)).alias("sd")
    )
    stats, rows = with_size(stats)
    if not rows:
        raise MatchError("no stratum has both groups, so no propensity model can be fitted")
    scaled = attach(base, stats, ["stratum"], rows=rows).select(
        "stratum", "y", F.array(*[(named(m) - F.col("mu")[i]) / F.col("sd")[i] for i, m in enumerate(ms)]).alias("z")
    )
    scaled = materialise(scaled)
    start = F.array_repeat(F.lit(0.0), size)
    state = materialise(stats.select(
        "stratum", start.alias("beta"), start.alias("base"), F.lit(float("inf")).alias("objective"), F.lit(True).alias("open")
    ))
    step = _newton_step(size, spec.C)
    iterations = 0
    while iterations < spec.max_iter:
        iterations += 1
        active = state.where("open").select("stratum", "beta")
        sums = (
            attach(scaled, active, ["stratum"], rows=rows)
            .mapInPandas(_partial_sums(size), "stratum string, i int, v double")
            .groupBy("stratum", "i")
            .agg(F.sum("v").alias("v"))
            .groupBy("stratum")
            .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s"))
            .select("stratum", F.transform("_s", lambda s: s["v"]).alias("flat"))
        )
        # Overshoots are measured against the largest finite value while there is no earlier objective.
        best = F.least("objective", F.lit(1e300))
        running = (
            state.where("open")
            .join(sums, "stratum")
            .select("stratum", step("flat", "beta", "base", best).alias("_n"))
            .select("stratum", "_n.*")
        )
        running = running.withColumn("open", F.col("moved") > spec.tolerance).drop("moved")
        state = materialise(running.unionByName(state.where(~F.col("open"))))
        if not state.where("open").limit(1).count():
            break
    fitted = materialise(stats.join(state.select("stratum", "beta"), "stratum"))
    return PropensityModel(list(covariates), spec, fitted, rows, iterations)


def score(df: DataFrame, model: PropensityModel) -> DataFrame:
    """Add the clipped score and its logit; NULL where a covariate or the stratum's model is missing."""
    terms = monomials(model.covariates, model.spec.degree)
    joined = attach(df, model.state, ["stratum"], "left", model.rows)
    eta = reduce(
        lambda a, b: a + b,
        [(t - F.col("mu")[i]) / F.col("sd")[i] * F.col("beta")[i + 1] for i, t in enumerate(terms)],
        F.col("beta")[0],
    )
    p = F.least(F.greatest(1 / (1 + F.exp(-eta)), F.lit(CLIP)), F.lit(1 - CLIP))
    return (
        joined.withColumn(PS, F.when(eta.isNotNull(), p))
        .withColumn(LOGIT, F.log(F.col(PS) / (1 - F.col(PS))))
        .select(*map(named, df.columns), PS, LOGIT)
    )


def fit_score(
    df: DataFrame, treatment_col: str, covariates: list[str], spec: PropensitySpec = PropensitySpec()
) -> tuple[DataFrame, PropensityModel]:
    model = fit_propensity(df, treatment_col, covariates, spec)
    return score(df, model), model

"""Imputation: fitted state from aggregates, applied by projection or by a donor join."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TableConfig
from ..errors import ConfigError
from ..functions.order import exact_quantiles
from ..functions.tools import BROADCAST_ROWS, is_numeric, materialise, named
from .neighbours import Geometry, nearest

# Fixed values of the methods.
KNN_DONORS = 2
ROUNDS = 10
ROUND_TOLERANCE = 1e-3
RIDGE_ITERATIONS = 300
RIDGE_TOLERANCE = 1e-3
RIDGE_PRIOR = 1e-6
LOCAL_PATTERNS = 4096  # so many patterns of holes are summed on the driver, more by a job each step


@dataclass
class ImputeState:
    """What a fit learnt: fill values, KNN donors, and the regression steps of the iterative method."""

    methods: dict[str, str]
    context: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    donors: DataFrame | None = None
    steps: list[tuple[str, float, dict[str, float]]] = field(default_factory=list)

    def table(self, spark) -> DataFrame:
        rows = [(c, m, None if c not in self.fills else str(self.fills[c])) for c, m in self.methods.items()]
        return spark.createDataFrame(rows, "column string, method string, value string")


def _split(config: TableConfig) -> tuple[dict[str, str], dict[str, str]]:
    methods = {c: config[c].missing_data_management.imputer for c in config.imputed_columns()}
    joint = {c: m for c, m in methods.items() if m in ("knn", "iterative")}
    return {c: m for c, m in methods.items() if c not in joint}, joint


def _check(df: DataFrame, config: TableConfig) -> None:
    columns = config.imputed_columns()
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ConfigError(f"imputed columns missing from the table: {absent}")
    wrong = [
        c
        for c in columns
        if config[c].missing_data_management.imputer in ("mean", "median", "knn", "iterative") and not is_numeric(df, c)
    ]
    if wrong:
        raise ConfigError(f"{wrong} are not numeric; use 'most_frequent' or 'zero'")


def fit_impute(df: DataFrame, config: TableConfig, id_col: str | None = None) -> ImputeState:
    """Learn fill values; ``id_col`` is needed for KNN (ties and donors are told apart by it)."""
    _check(df, config)
    single, joint = _split(config)
    state = ImputeState({**single, **joint})
    state.fills = _single_fills(df, single)
    if not joint:
        return state
    state.context = config.numerical_columns()
    absent = [c for c in state.context if c not in df.columns]
    if absent:
        raise ConfigError(f"numerical columns missing from the table: {absent}")
    base = _fill(df, state.fills, single)
    row = base.agg(*[F.avg(named(c)).alias(c) for c in state.context]).first()
    void = [c for c in state.context if row[c] is None]
    if void:
        raise ConfigError(f"columns without any value cannot be imputed: {void}")
    state.means = {c: float(row[c]) for c in state.context}
    if "knn" in joint.values():
        if id_col is None:
            raise ConfigError("KNN imputation needs id_col")
        state.donors = materialise(base.select(named(id_col).alias("_donor"), *[named(c).cast("double") for c in state.context]))
    if "iterative" in joint.values():
        state.steps = _fit_steps(base, state.context, state.means)
    return state


def impute(df: DataFrame, config: TableConfig, state: ImputeState, id_col: str | None = None) -> DataFrame:
    """Fill missing values of this or another table from fitted state."""
    unfitted = sorted(c for c in config.imputed_columns() if c not in state.methods)
    if unfitted:
        raise ConfigError(f"no fitted imputer for {unfitted}")
    absent = [c for c in config.imputed_columns() if c not in df.columns]
    if absent:
        raise ConfigError(f"imputed columns missing from the table: {absent}")
    single, joint = _split(config)
    result = _fill(df, state.fills, single)
    by_knn = [c for c, m in joint.items() if m == "knn"]
    by_steps = [c for c, m in joint.items() if m == "iterative"]
    if by_knn:
        if id_col is None:
            raise ConfigError("KNN imputation needs id_col")
        result = _fill_from_donors(result, state, by_knn, id_col)
    if by_steps:
        result = _fill_by_steps(result, state, by_steps)
    return result.select(*[named(c) for c in df.columns])


# ---------------------------------------------------------------- one column at a time


def _single_fills(df: DataFrame, methods: dict[str, str]) -> dict[str, object]:
    fills: dict[str, object] = {c: 0 for c, m in methods.items() if m == "zero"}
    means = [c for c, m in methods.items() if m == "mean"]
    if means:
        fills.update(df.agg(*[F.avg(named(c)).alias(c) for c in means]).first().asDict())
    medians = [c for c, m in methods.items() if m == "median"]
    if medians:
        found = exact_quantiles(df, medians, [0.5]).collect()
        fills.update({c: None for c in medians}, **{r["variable"]: r["value"] for r in found})
    frequent = [c for c, m in methods.items() if m == "most_frequent"]
    if frequent:
        fills.update({c: None for c in frequent}, **_most_frequent(df, frequent))
    void = sorted(c for c, v in fills.items() if v is None)
    if void:
        raise ConfigError(f"columns without any value cannot be imputed: {void}")
    return fills


def _most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, ties to the smallest; values are counted before they are compared."""
    cells = [
        F.struct(
            F.lit(c).alias("variable"),
            named(c).cast("string").alias("value"),
            (named(c).cast("double") if is_numeric(df, c) else F.lit(None).cast("double")).alias("number"),
        )
        for c in columns
    ]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("_cell"))
        .select("_cell.*")
        .where(F.col("value").isNotNull())
        .groupBy("variable", "value", "number")
        .count()
    )
    best = counts.groupBy("variable").agg(F.min_by("value", F.struct(-F.col("count"), "number", "value")).alias("value"))
    return {r["variable"]: r["value"] for r in best.collect()}


def _fill(df: DataFrame, fills: dict[str, object], methods: dict[str, str]) -> DataFrame:
    filled = {}
    for c, method in methods.items():
        dtype = T.DoubleType() if method in ("mean", "median") else df.schema[c].dataType
        filled[c] = F.coalesce(named(c).cast(dtype), F.lit(fills[c]).try_cast(dtype))
    return df.withColumns(filled) if filled else df


# ---------------------------------------------------------------- nearest donors


def _mask(columns: list[str]):
    return F.concat(*[F.when(named(c).isNull(), "0").otherwise("1") for c in columns])


def _fill_from_donors(df: DataFrame, state: ImputeState, targets: list[str], id_col: str) -> DataFrame:
    """Mean of the two nearest donors, by the distance over the columns both rows have.

    Rows are grouped by which columns they have. Within one pair of such patterns the
    shared columns are fixed, so the search there is an ordinary Euclidean one.
    """
    context = state.context
    numbers = df.select(named(id_col).alias("q"), *[named(c).cast("double") for c in context])
    holes = reduce(lambda a, b: a | b, [named(c).isNull() for c in targets])
    asking = numbers.where(holes).withColumn("_have", _mask(context))
    donors = state.donors.withColumn("_have", _mask(context))
    asked_patterns = [r[0] for r in asking.select("_have").distinct().collect()]
    donor_patterns = [r[0] for r in donors.select("_have").distinct().collect()]
    plan = []
    for a in asked_patterns:
        for b in donor_patterns:
            shared = [i for i in range(len(context)) if a[i] == b[i] == "1"]
            for t in targets:
                i = context.index(t)
                if a[i] == "0" and b[i] == "1" and shared:
                    flags = [1.0 if j in shared else 0.0 for j in range(len(context))]
                    plan.append((f"{a}:{b}:{t}", a, b, t, float(np.sqrt(len(context) / len(shared))), flags))
    filled = {c: F.coalesce(named(c).cast("double"), F.lit(state.means[c])) for c in targets}
    if not plan:
        return df.withColumns(filled)
    short = len(plan) <= BROADCAST_ROWS
    plan = df.sparkSession.createDataFrame(
        plan, "blk string, _ask string, _give string, _target string, _factor double, _flags array<double>"
    )
    # One row per pair of observed patterns and target: its size depends on columns, not on rows.
    plan = F.broadcast(plan) if short else plan
    xs = [F.when(F.col("_flags")[i] == 1, named(c)).otherwise(0.0).alias(f"x{i}") for i, c in enumerate(context)]
    queries = asking.join(plan, F.col("_have") == F.col("_ask")).select("blk", "q", *xs)
    pool = donors.join(plan, F.col("_have") == F.col("_give")).select("blk", F.col("_donor").alias("p"), *xs)
    found = nearest(queries, pool, Geometry("euclidean", len(context)), KNN_DONORS)
    found = found.join(plan, "blk").withColumn("dist", F.col("dist") * F.col("_factor"))
    closest = Window.partitionBy("q", "_target").orderBy("dist", "p")
    found = found.withColumn("_r", F.row_number().over(closest)).where(F.col("_r") <= KNN_DONORS)
    values = donors.select(F.col("_donor").alias("p"), *[named(c).alias(f"_v_{c}") for c in targets])
    given = reduce(
        lambda a, c: a.when(F.col("_target") == c, F.col(f"_v_{c}")), targets[1:],
        F.when(F.col("_target") == targets[0], F.col(f"_v_{targets[0]}")),
    )
    guesses = found.join(values, "p").groupBy("q").agg(
        *[F.avg(F.when(F.col("_target") == c, given)).alias(f"_g_{c}") for c in targets]
    )
    joined = df.join(guesses.withColumnRenamed("q", id_col), id_col, "left")
    filled = {
        c: F.coalesce(named(c).cast("double"), F.col(f"_g_{c}"), F.lit(state.means[c])) for c in targets
    }
    return joined.withColumns(filled).drop(*[f"_g_{c}" for c in targets])


# ---------------------------------------------------------------- chained regressions


def _ridge(gram: np.ndarray, xy: np.ndarray, yy: float, n: int) -> np.ndarray:
    """Bayesian ridge coefficients from centered second moments (evidence maximisation)."""
    values, vectors = np.linalg.eigh(gram)
    values = np.clip(values, 0.0, None)
    noise = 1.0 / (yy / n + np.finfo(float).eps)
    shrink = 1.0
    projected = vectors.T @ xy

    def solve():
        w = vectors @ (projected / (values + shrink / noise))
        return w, max(yy - 2 * w @ xy + w @ gram @ w, 0.0)

    previous = None
    for _ in range(RIDGE_ITERATIONS):
        w, rss = solve()
        effective = np.sum(noise * values / (shrink + noise * values))
        shrink = (effective + 2 * RIDGE_PRIOR) / (w @ w + 2 * RIDGE_PRIOR)
        noise = (n - effective + 2 * RIDGE_PRIOR) / (rss + 2 * RIDGE_PRIOR)
        if previous is not None and np.abs(w - previous).sum() < RIDGE_TOLERANCE:
            break
        previous = w
    return solve()[0]


def _moments(df: DataFrame, context: list[str], means: dict[str, float]) -> DataFrame:
    """One row per pattern of holes: rows, sums and products of the columns about ``means``, holes counted as 0."""
    centred = [F.coalesce(named(c).cast("double") - F.lit(means[c]), F.lit(0.0)) for c in context]
    pairs = [(i, j) for i in range(len(context)) for j in range(i, len(context))]
    rows = df.select(_mask(context).alias("mask"), *[z.alias(f"z{i}") for i, z in enumerate(centred)])
    return rows.groupBy("mask").agg(
        F.array(F.count(F.lit(1)).cast("double"), *[F.sum(f"z{i}") for i in range(len(context))], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).alias("sums")
    )


class _Patterns:
    """The completed table as the steps so far leave it, known by its moments.

    Steps are linear, so in the rows of one pattern every column is one linear map of the values that
    pattern has; the moments of the completed columns follow from those of the given ones.
    """

    def __init__(self, masks: list[str], sums: np.ndarray, d: int):
        self.has = np.array([[m[i] == "1" for i in range(d)] for m in masks], bool).reshape(len(masks), d)
        raw = np.zeros((len(masks), d + 1, d + 1))
        at = np.triu_indices(d)
        raw[:, 0, 0], raw[:, 0, 1:] = sums[:, 0], sums[:, 1 : d + 1]
        raw[:, 1 + at[0], 1 + at[1]] = sums[:, d + 1 :]
        raw[:, 1 + at[1], 1 + at[0]] = sums[:, d + 1 :]
        raw[:, 1:, 0] = raw[:, 0, 1:]
        self.raw = raw
        self.maps = np.tile(np.eye(d + 1), (len(masks), 1, 1))

    def seen(self, target: int) -> np.ndarray:
        """Moments of all completed columns (and 1) over the rows that have ``target``."""
        own = self.has[:, target]
        return np.einsum("pij,pjk,plk->il", self.maps[own], self.raw[own], self.maps[own])

    def step(self, target: int, weights: np.ndarray):
        """``weights`` of 1 and all columns, 0 for the target."""
        hole = ~self.has[:, target]
        self.maps[hole, target + 1] = np.einsum("i,pij->pj", weights, self.maps[hole])


def _seen(parts: DataFrame | _Patterns, target: int, d: int, done: list[tuple[int, np.ndarray]]) -> np.ndarray:
    if isinstance(parts, _Patterns):
        return parts.seen(target)

    def add(batches):
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            if len(batch):
                own = _Patterns(batch["mask"].tolist(), np.stack(batch["sums"].to_numpy()), d)
                for t, w in done:
                    own.step(t, w)
                total += own.seen(target)
        yield pd.DataFrame({"total": [total.ravel().tolist()]})

    rows = parts.mapInPandas(add, "total array<double>")
    summed = rows.agg(F.array(*[F.sum(F.col("total")[i]) for i in range((d + 1) ** 2)])).first()[0]
    return np.array(summed).reshape(d + 1, d + 1)


def _regression(parts, target: int, d: int, done: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Weights of 1 and all columns for one column on the others, over the rows that have it."""
    seen = _seen(parts, target, d, done)
    n, means = seen[0, 0], seen[0, 1:] / seen[0, 0]
    spread = seen[1:, 1:] - n * np.outer(means, means)
    others = [i for i in range(d) if i != target]
    w = np.zeros(d + 1)
    w[1 + np.array(others, int)] = _ridge(spread[np.ix_(others, others)], spread[others, target], spread[target, target], int(n))
    w[0] = means[target] - w[1:] @ means
    return w


def _completer(context: list[str], means: dict[str, float], steps: list[tuple[str, float, dict[str, float]]]):
    """A function that fills the holes of a batch of rows by the steps, all rows of a step at once."""
    place = {c: i for i, c in enumerate(context)}
    start = np.array([means[c] for c in context])
    plan = [(place[t], b, np.array([w.get(c, 0.0) for c in context])) for t, b, w in steps]

    def complete(values: np.ndarray, upto: int | None = None) -> np.ndarray:
        holes = np.isnan(values)
        now = np.where(holes, start, values)
        for target, intercept, weights in plan[:upto]:
            at = holes[:, target]
            if at.any():
                now[at, target] = now[at] @ weights + intercept
        return now

    return complete


def _matrix(batch) -> np.ndarray:
    return np.array(batch.to_list(), float).reshape(len(batch), -1)


def _given(context: list[str]):
    """The columns of a row as one array, holes as NaN."""
    return F.array(*[F.coalesce(named(c).cast("double"), F.lit(float("nan"))) for c in context])


def _fit_steps(df: DataFrame, context: list[str], means: dict[str, float]):
    """Rounds of regressions, fewest holes first: one pass for the moments, and one each round to see how far it moved
    the values."""
    d = len(context)
    counts = df.agg(*[F.count_if(named(c).isNull()).alias(f"h{i}") for i, c in enumerate(context)], *[F.max(F.abs(named(c))).cast("double").alias(f"a{i}") for i, c in enumerate(context)]).first()
    holes = [counts[f"h{i}"] for i in range(d)]
    order = sorted(range(d), key=lambda i: holes[i])
    limit = ROUND_TOLERANCE * max(float(counts[f"a{i}"]) for i in range(d))
    steps: list[tuple[str, float, dict[str, float]]] = []
    if d < 2:
        return steps
    parts = materialise(_moments(df, context, means))
    if parts.count() <= LOCAL_PATTERNS:
        rows = parts.collect()
        parts = _Patterns([r.mask for r in rows], np.array([r.sums for r in rows]).reshape(len(rows), -1), d)
    done: list[tuple[int, np.ndarray]] = []
    for _ in range(ROUNDS):
        for t in order:
            w = _regression(parts, t, d, done)
            done.append((t, w))
            if isinstance(parts, _Patterns):
                parts.step(t, w)
            weights = {c: float(w[i + 1]) for i, c in enumerate(context) if i != t}
            intercept = float(w[0] + means[context[t]] - sum(weights[c] * means[c] for c in weights))
            steps.append((context[t], intercept, weights))
        complete, n = _completer(context, means, steps), len(steps)

        @F.pandas_udf("double")
        def moved(batch: pd.Series) -> pd.Series:
            values = _matrix(batch)
            return pd.Series(np.abs(complete(values, n) - complete(values, n - d)).max(axis=1, initial=0.0))

        if not any(holes) or (df.where(_mask(context).contains("0")).agg(F.max(moved(_given(context)))).first()[0] or 0.0) < limit:
            break
    return steps


def _fill_by_steps(df: DataFrame, state: ImputeState, targets: list[str]) -> DataFrame:
    context, complete = state.context, _completer(state.context, state.means, state.steps)

    @F.pandas_udf("array<double>")
    def filled(batch: pd.Series) -> pd.Series:
        return pd.Series(list(complete(_matrix(batch))))

    asks = F.concat(*[F.when(named(c).isNull(), "0").otherwise("1") for c in targets]).contains("0")
    work = df.withColumn("_filled", F.when(asks, filled(_given(context))))
    work = work.withColumns({c: F.coalesce(named(c).cast("double"), F.col("_filled")[context.index(c)]) for c in targets})
    return work.drop("_filled")

"""Scaling: fit one aggregate, transform by projection, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TableConfig
from ..errors import ConfigError
from ..functions.order import exact_quantiles
from ..functions.tools import is_numeric, named


@dataclass(frozen=True)
class ScaleState:
    """Per column the subtracted center and the divisor."""

    center: dict[str, float]
    width: dict[str, float]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(self.center[c]), float(self.width[c])) for c in self.center]
        return spark.createDataFrame(rows, "column string, center double, width double")

    @staticmethod
    def from_table(df: DataFrame) -> "ScaleState":
        rows = df.collect()
        return ScaleState({r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows})


def _check(df: DataFrame, columns: list[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ConfigError(f"scaled columns missing from the table: {absent}")
    wrong = [c for c in columns if not is_numeric(df, c)]
    if wrong:
        raise ConfigError(f"only numeric columns can be scaled, not {wrong}")


def fit_scaling(df: DataFrame, config: TableConfig) -> ScaleState:
    columns = config.scaled_columns()
    _check(df, columns)
    by_method: dict[str, list[str]] = {}
    for c in columns:
        by_method.setdefault(config[c].scaling.method, []).append(c)
    center, width = {}, {}
    aggs = []
    for c in by_method.get("standard", ()):
        aggs += [F.avg(named(c)).alias(f"a:{c}"), F.stddev_pop(named(c)).alias(f"b:{c}")]
    for c in by_method.get("minmax", ()):
        aggs += [F.min(named(c)).alias(f"a:{c}"), F.max(named(c)).alias(f"b:{c}")]
    if aggs:
        row = df.agg(*aggs).first()
        for c in by_method.get("standard", ()):
            center[c], width[c] = row[f"a:{c}"], row[f"b:{c}"]
        for c in by_method.get("minmax", ()):
            low, high = row[f"a:{c}"], row[f"b:{c}"]
            center[c], width[c] = low, None if low is None else high - low
    robust = by_method.get("robust", [])
    if robust:
        found = {(r["variable"], r["prob"]): r["value"] for r in exact_quantiles(df, robust, [0.25, 0.5, 0.75]).collect()}
        for c in robust:
            center[c] = found.get((c, 0.5))
            width[c] = None if center[c] is None else found[(c, 0.75)] - found[(c, 0.25)]
    void = [c for c in columns if center[c] is None]
    if void:
        raise ConfigError(f"columns without any value cannot be scaled: {void}")
    return ScaleState(
        {c: float(center[c]) for c in columns}, {c: float(width[c]) or 1.0 for c in columns}
    )


def _columns_of(df: DataFrame, config: TableConfig, state: ScaleState) -> list[str]:
    columns = config.scaled_columns()
    unfitted = sorted(c for c in columns if c not in state.center)
    if unfitted:
        raise ConfigError(f"no fitted scaling for {unfitted}")
    _check(df, columns)
    return columns


def scale(df: DataFrame, config: TableConfig, state: ScaleState) -> DataFrame:
    columns = _columns_of(df, config, state)
    return df.withColumns({c: (named(c) - state.center[c]) / state.width[c] for c in columns}) if columns else df


def unscale(df: DataFrame, config: TableConfig, state: ScaleState) -> DataFrame:
    columns = _columns_of(df, config, state)
    return df.withColumns({c: named(c) * state.width[c] + state.center[c] for c in columns}) if columns else df

"""Ordinal and one-hot encoding from fitted category tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TableConfig
from ..errors import ConfigError
from ..functions.order import running_total
from ..functions.tools import attach, named, with_size

INLINE_CODES = 500  # longer ordinal code lists are joined instead of written into the plan


@dataclass
class EncodeState:
    """Fitted categories: lists for one-hot and short ordinal columns, tables for long ordinal ones."""

    categories: dict[str, list] = field(default_factory=dict)
    tables: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    def fitted(self) -> set[str]:
        return set(self.categories) | set(self.tables)

    def table(self, df: DataFrame) -> DataFrame:
        """``(column, value, code)`` of every listed category."""
        rows = [
            (c, None if v is None else str(v), i) for c, values in self.categories.items() for i, v in enumerate(values)
        ]
        out = df.sparkSession.createDataFrame(rows, "column string, value string, code int")
        for c, (codes, _) in self.tables.items():
            part = codes.select(F.lit(c).alias("column"), named(c).cast("string").alias("value"), F.col("_code").cast("int").alias("code"))
            out = out.unionByName(part)
        return out


def _check(df: DataFrame, columns: list[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ConfigError(f"encoded columns missing from the table: {absent}")


# One column each: beyond so many values one-hot encoding is refused.
ONE_HOT_VALUES = 2_000


def fit_encoding(df: DataFrame, config: TableConfig) -> EncodeState:
    columns = config.encoded_columns()
    _check(df, columns)
    state = EncodeState()
    for c in columns:
        rule = config[c].encoding
        if rule.order is not None:
            state.categories[c] = list(rule.order)
            continue
        distinct, size = with_size(df.select(named(c)).distinct())
        if rule.method == "one_hot" and size > ONE_HOT_VALUES:
            raise ConfigError(f"'{c}' has {size} different values; one-hot encoding takes at most {ONE_HOT_VALUES}")
        if rule.method == "one_hot" or size <= INLINE_CODES:
            values = [r[0] for r in distinct.collect()]
            known = sorted(v for v in values if v is not None)
            has_null = len(known) < len(values)
            state.categories[c] = known + ([None] if has_null and rule.method == "one_hot" else [])
        else:
            codes = running_total(distinct.dropna(), [], [c], out="_code")
            state.tables[c] = with_size(codes.withColumn("_code", F.col("_code").cast("double") - 1))
    return state


def encode(df: DataFrame, config: TableConfig, state: EncodeState) -> DataFrame:
    columns = config.encoded_columns()
    unfitted = sorted(set(columns) - state.fitted())
    if unfitted:
        raise ConfigError(f"no fitted encoding for {unfitted}")
    _check(df, columns)
    result = df
    for c in columns:
        dtype = df.schema[c].dataType
        if config[c].encoding.method == "one_hot":
            flags = {
                f"{c}__{v}": F.when(named(c).isNull() if v is None else named(c) == F.lit(v), 1.0).otherwise(0.0)
                for v in state.categories[c]
            }
            result = result.withColumns(flags).drop(c)
        elif c in state.tables:
            codes, rows = state.tables[c]
            names = [n for n in result.columns]
            joined = attach(result, codes, [c], "left", rows)
            result = joined.drop(c).withColumnRenamed("_code", c).select(*map(named, names))
        else:
            pairs = chain.from_iterable(
                (F.lit(v).cast(dtype), F.lit(float(i))) for i, v in enumerate(state.categories[c])
            )
            table = F.create_map(*pairs)
            result = result.withColumn(c, F.when(named(c).isNotNull(), F.try_element_at(table, named(c))))
    return result


def expanded_names(config: TableConfig, state: EncodeState, column: str) -> list[str]:
    """Names under which a covariate appears after encoding."""
    if not config[column].encoding.enabled or config[column].encoding.method == "ordinal":
        return [column]
    return [f"{column}__{v}" for v in state.categories[column]]


def expand_covariates(config: TableConfig, state: EncodeState, columns: list[str]) -> list[str]:
    return [n for c in columns for n in (expanded_names(config, state, c) if c in config else [c])]

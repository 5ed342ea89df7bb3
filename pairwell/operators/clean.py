"""Declarative cleaning as one chain of projections and filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SPARK_TYPES, ColumnSpec, TableConfig
from ..errors import ConfigError
from ..functions.tools import complete_rows, named


def _literal(value, target: T.DataType) -> Column:
    return F.lit(value).try_cast(target)


def _fits(value, dtype: T.DataType) -> bool:
    """Whether a cast of the value to the type keeps it."""
    text = str(value).strip()
    try:
        if isinstance(dtype, T.IntegralType):
            int(text) if not isinstance(value, float) else int(value) / (int(value) == value)
        elif isinstance(dtype, T.NumericType):
            float(text)
        elif isinstance(dtype, T.BooleanType):
            return text.lower() in {"true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"}
        elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            datetime.fromisoformat(text)
    except (ValueError, ZeroDivisionError, OverflowError):
        return False
    return True


def mapped_type(mappings: Mapping, dtype: T.DataType) -> T.DataType:
    """The type of a recoded column: its own, or string if a new value does not fit it."""
    return dtype if all(_fits(new, dtype) for new in mappings.values() if new is not None) else T.StringType()


def map_values(column: Column, mappings: Mapping, dtype: T.DataType) -> Column:
    """Recode listed values; anything else passes through. Old values that the column's type cannot hold match nothing."""
    known = {old: new for old, new in mappings.items() if old is not None and _fits(old, dtype)}
    if not known:
        return column if mapped_type(mappings, dtype) == dtype else column.cast("string")
    target = mapped_type(mappings, dtype)
    pairs = chain.from_iterable((_literal(old, dtype), _literal(new, target)) for old, new in known.items())
    table = F.create_map(*pairs)
    return F.when(F.map_contains_key(table, column), table[column]).otherwise(column.cast(target))


def blank_tokens(column: Column, spec: ColumnSpec, dtype: T.DataType) -> Column:
    """Turn 'missing' spellings in a string column into NULL."""
    rule = spec.missing_data_management
    if rule.strategy == "maintain" or not rule.condition or not isinstance(dtype, T.StringType):
        return column
    tokens = [t for t in rule.condition if isinstance(t, str)]
    return F.when(column.isin(tokens), F.lit(None)).otherwise(column)


def select_active(df: DataFrame, config: TableConfig) -> DataFrame:
    """The active columns under their configured names."""
    active = config.active_columns()
    absent = sorted(s.source for s in active.values() if s.source not in df.columns)
    if absent:
        raise ConfigError(f"active columns missing from the table: {absent}")
    return df.select(*[named(s.source).alias(n) for n, s in active.items()])


def preprocess(df: DataFrame, config: TableConfig) -> DataFrame:
    """Select, recode, blank tokens, cast, multiply, drop rows, replace nulls: in that order."""
    active = config.active_columns()
    picked = select_active(df, config)
    cells = []
    for name, spec in active.items():
        dtype = picked.schema[name].dataType
        cell = map_values(named(name), spec.mappings, dtype)
        dtype = mapped_type(spec.mappings, dtype)
        cell = blank_tokens(cell, spec, dtype)
        if spec.type is not None:
            cell = cell.try_cast(SPARK_TYPES[spec.type])
        if spec.numerical and spec.multiplier != 1:
            cell = cell * F.lit(spec.multiplier)
        cells.append(cell.alias(name))
    cleaned = picked.select(*cells)
    rule = {n: s.missing_data_management for n, s in active.items()}
    must_have = [n for n, r in rule.items() if r.strategy == "drop"]
    if must_have:
        cleaned = complete_rows(cleaned, must_have)
    filled = {
        n: F.coalesce(named(n), _literal(r.value, cleaned.schema[n].dataType))
        for n, r in rule.items()
        if r.strategy == "replace"
    }
    return cleaned.withColumns(filled) if filled else cleaned


COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def row_filter(df: DataFrame, column: str, operator: str, value) -> Column:
    if column not in df.columns:
        raise ConfigError(f"filter column '{column}' not found")
    dtype = df.schema[column].dataType
    if operator in ("in", "not_in"):
        listed = [_literal(v, dtype) for v in (value if isinstance(value, (list, tuple)) else [value])]
        hit = named(column).isin(listed)
        return hit if operator == "in" else ~hit
    if operator not in COMPARE:
        raise ConfigError(f"unknown filter operator '{operator}'")
    return COMPARE[operator](named(column), _literal(value, dtype))


def filter_rows(df: DataFrame, conditions: Iterable[tuple]) -> DataFrame:
    """Keep rows that satisfy every ``(column, operator, value)``; a NULL comparison drops the row."""
    tests = [row_filter(df, *condition) for condition in conditions]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df

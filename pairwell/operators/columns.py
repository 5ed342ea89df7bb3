"""Role inference, config validation and live column statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ColumnSpec, TableConfig
from ..errors import ConfigError
from ..functions.tools import few_values, named

ID_NAME = r"(^id$|_id$|^id_|^uuid$)"  # fixed value: which names count as identifiers
LISTED_VALUES = 50  # fixed value: longest list of distinct values shown

_TYPE_NAMES = {
    T.ByteType: "int",
    T.ShortType: "int",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float32",
    T.DoubleType: "float64",
    T.StringType: "string",
    T.BooleanType: "bool",
    T.DateType: "date",
    T.TimestampType: "datetime",
    T.TimestampNTZType: "datetime",
}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_id_name(name: str, patterns: list[str] = ()) -> bool:
    return any(re.search(p, name, re.IGNORECASE) for p in [ID_NAME, *patterns])


def infer_config(
    df: DataFrame, id_columns: list[str] = (), infer_id: bool = True, patterns: list[str] = ()
) -> TableConfig:
    """Guess each column's role; all numeric columns are looked at in a single aggregate."""
    absent = [c for c in id_columns if c not in df.columns]
    if absent:
        raise ConfigError(f"id columns not in the table: {absent}")
    ids = {c for c in df.columns if c in id_columns or (infer_id and is_id_name(c, patterns))}
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in ids]
    facts = {}
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            col = named(c)
            aggs += [
                F.count(col).alias(f"n{i}"),
                F.bool_and((col == 0) | (col == 1)).alias(f"b{i}"),
                F.bool_or(col != F.floor(col)).alias(f"f{i}"),
            ]
        row = df.agg(*aggs).first()
        facts = {c: (row[f"n{i}"], row[f"b{i}"], row[f"f{i}"]) for i, c in enumerate(numeric)}

    columns = {}
    for f in df.schema:
        name, kind = f.name, type(f.dataType)
        base = {"new_name": name, "type": _TYPE_NAMES.get(kind)}
        if name in ids:
            base["id"] = True
        elif kind is T.BooleanType:
            base.update(categorical=True, semantic_roles={"binary"})
        elif name in facts:
            n, binary, fractional = facts[name]
            if n and binary:
                base.update(categorical=True, semantic_roles={"binary"})
            else:
                base["numerical"] = True
                if n:
                    smooth = kind not in _WHOLE and fractional
                    base["semantic_roles"] = {"continuous" if smooth else "discrete"}
        elif kind not in (T.DateType, T.TimestampType, T.TimestampNTZType):
            base["categorical"] = True
        columns[name] = ColumnSpec(**base)
    return TableConfig(columns)


def describe_config(df: DataFrame, config: TableConfig) -> DataFrame:
    """The configuration as a table: one row per column."""
    rows = [
        (n, s.type, s.id, s.categorical, s.numerical, ",".join(sorted(s.semantic_roles)))
        for n, s in config.columns.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "name string, type string, id boolean, categorical boolean, numerical boolean, roles string"
    )


@dataclass(frozen=True)
class ConfigCheck:
    is_valid: bool
    missing_in_dataset: list[str]
    unconfigured_in_dataset: list[str]
    errors: list[str]


def validate_config(df: DataFrame, config: TableConfig) -> ConfigCheck:
    present = set(df.columns)
    sources = {s.source for s in config.columns.values()}
    missing = sorted(s.source for s in config.active_columns().values() if s.source not in present)
    errors = [f"active column '{c}' is not in the table" for c in missing]
    return ConfigCheck(not missing, missing, sorted(present - sources), errors)


def column_stats(df: DataFrame, config: TableConfig) -> DataFrame:
    """Missing share and distinct count per configured column, with the values of short categoricals.

    Columns with at most 50 values are counted and listed in one pass without a shuffle; the others are counted one
    by one in their own type.
    """
    names = [n for n in config.columns if n in df.columns]
    spark = df.sparkSession
    nulls = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(named(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    few = few_values(df, names, LISTED_VALUES)
    distinct = {n: len(v) for n, v in few.items() if v is not None}
    for n in names:
        if n not in distinct:
            distinct[n] = df.agg(F.count_distinct(named(n))).first()[0]
    listed = [n for n in names if config[n].categorical and few[n] is not None]
    values = {}
    if listed:
        schema = T.StructType([T.StructField(f"v{i}", T.ArrayType(df.schema[n].dataType)) for i, n in enumerate(listed)])
        row = spark.createDataFrame([tuple(few[n] for n in listed)], schema).select(
            *[F.transform(f"v{i}", lambda v: v.cast("string")).alias(f"v{i}") for i in range(len(listed))]
        ).first()
        values = {n: row[f"v{i}"] for i, n in enumerate(listed)}
    height = nulls["rows"] or 1
    rows = [
        (n, (nulls["rows"] - nulls[f"n{i}"]) / height, distinct.get(n, 0), values.get(n))
        for i, n in enumerate(names)
    ]
    return spark.createDataFrame(
        rows, "name string, missing_pct double, n_distinct long, distinct_values array<string>"
    )

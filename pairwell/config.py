"""Declarative column descriptions. Plain data only; fitted state lives elsewhere."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import types as T

from .errors import ConfigError

# Names and defaults that configuration files rely on.
STRATEGIES = ("drop", "impute", "replace", "maintain")
IMPUTERS = ("zero", "mean", "median", "most_frequent", "knn", "iterative")
SCALERS = ("none", "standard", "minmax", "robust")
ENCODERS = ("none", "one_hot", "ordinal")
MISSING_TOKENS = ("NA", "na", "", " ", ".", "NaN", "nan", "/", "n/a", "N/A", "null", "NULL")
LEGACY_ROLE_FLAGS = ("gene", "cytogenetic", "clinical")
SPARK_TYPES = {
    "int": T.LongType(),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "float": T.DoubleType(),
    "float64": T.DoubleType(),
    "float32": T.FloatType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "category": T.StringType(),
}


def _one_of(value, allowed, what):
    if value not in allowed:
        raise ConfigError(f"{what} must be one of {', '.join(allowed)}; got {value!r}")


@dataclass(frozen=True)
class MissingRule:
    """What happens to missing values of a column."""

    strategy: str = "maintain"
    value: Any = None
    condition: tuple = MISSING_TOKENS
    imputer: str = "zero"

    def __post_init__(self):
        _one_of(self.strategy, STRATEGIES, "missing strategy")
        _one_of(self.imputer, IMPUTERS, "imputer")
        if self.strategy == "replace" and self.value is None:
            raise ConfigError("missing strategy 'replace' needs a value")
        object.__setattr__(self, "condition", tuple(self.condition))


def _check_switch(kind: str, enabled: bool, method: str):
    if enabled != (method != "none"):
        raise ConfigError(f"{kind}: 'enabled' and 'method' contradict each other ({enabled}, {method!r})")


@dataclass(frozen=True)
class ScalingRule:
    enabled: bool = False
    method: str = "none"

    def __post_init__(self):
        _one_of(self.method, SCALERS, "scaling method")
        _check_switch("scaling", self.enabled, self.method)


@dataclass(frozen=True)
class EncodingRule:
    enabled: bool = False
    method: str = "none"
    order: tuple | None = None

    def __post_init__(self):
        _one_of(self.method, ENCODERS, "encoding method")
        _check_switch("encoding", self.enabled, self.method)
        if self.order is not None:
            if self.method != "ordinal":
                raise ConfigError("encoding order applies to ordinal encoding only")
            object.__setattr__(self, "order", tuple(self.order))


@dataclass(frozen=True)
class ColumnSpec:
    """One column: its role and what cleaning, imputing, scaling and encoding do to it."""

    new_name: str
    source_name: str | None = None
    active: bool = True
    categorical: bool = False
    numerical: bool = False
    id: bool = False
    semantic_roles: frozenset = frozenset()
    multiplier: float = 1.0
    mappings: Mapping[str, Any] = field(default_factory=dict)
    missing_data_management: MissingRule = MissingRule()
    scaling: ScalingRule = ScalingRule()
    encoding: EncodingRule = EncodingRule()
    type: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "semantic_roles", frozenset(self.semantic_roles))
        if self.type is not None:
            _one_of(self.type, tuple(SPARK_TYPES), "type")
        problems = []
        if self.categorical and self.numerical:
            problems.append("is declared both categorical and numerical")
        if self.id and (self.categorical or self.numerical or self.scaling.enabled or self.encoding.enabled):
            problems.append("is an id, so it takes no role, scaling or encoding")
        if self.encoding.enabled and not self.categorical:
            problems.append("is encoded but not categorical")
        if self.scaling.enabled and self.categorical:
            problems.append("is categorical, so it cannot be scaled")
        if problems:
            raise ConfigError(f"column '{self.new_name}' " + "; ".join(problems))

    @property
    def source(self) -> str:
        return self.source_name or self.new_name


class TableConfig:
    """Ordered collection of column specs."""

    def __init__(self, columns: Mapping[str, ColumnSpec]):
        for key, spec in columns.items():
            if key != spec.new_name:
                raise ConfigError(f"key '{key}' differs from new_name '{spec.new_name}'")
        self.columns = dict(columns)

    def __getitem__(self, name: str) -> ColumnSpec:
        return self.columns[name]

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def __len__(self) -> int:
        return len(self.columns)

    def __eq__(self, other) -> bool:
        return isinstance(other, TableConfig) and self.columns == other.columns

    def names(self, wanted=lambda spec: True) -> list[str]:
        return [n for n, spec in self.columns.items() if wanted(spec)]

    def active_columns(self) -> dict[str, ColumnSpec]:
        return {n: s for n, s in self.columns.items() if s.active}

    def categorical_columns(self) -> list[str]:
        return self.names(lambda s: s.active and s.categorical)

    def numerical_columns(self) -> list[str]:
        return self.names(lambda s: s.active and s.numerical)

    def id_columns(self) -> list[str]:
        return self.names(lambda s: s.active and s.id)

    def columns_with_role(self, role: str) -> list[str]:
        return self.names(lambda s: s.active and role in s.semantic_roles)

    def scaled_columns(self) -> list[str]:
        return self.names(lambda s: s.active and s.scaling.enabled)

    def encoded_columns(self) -> list[str]:
        return self.names(lambda s: s.active and s.encoding.enabled)

    def imputed_columns(self) -> list[str]:
        return self.names(lambda s: s.active and s.missing_data_management.strategy == "impute")

    def replacing(self, name: str, **changes) -> "TableConfig":
        """A copy with one column changed."""
        return TableConfig({**self.columns, name: replace(self.columns[name], **changes)})


# ---------------------------------------------------------------- JSON


def _build(cls, raw: Mapping, where: str):
    if not isinstance(raw, Mapping):
        raise ConfigError(f"{where}: expected an object")
    known = {f.name for f in fields(cls)}
    unknown = sorted(set(raw) - known)
    if unknown:
        raise ConfigError(f"{where}: unknown field(s) {unknown}")
    return cls(**raw)


def column_from_dict(name: str, raw: Mapping) -> ColumnSpec:
    parts = dict(raw)
    parts.setdefault("new_name", name)
    for key, cls in (("missing_data_management", MissingRule), ("scaling", ScalingRule), ("encoding", EncodingRule)):
        if isinstance(parts.get(key), Mapping):
            parts[key] = _build(cls, parts[key], f"{name}.{key}")
    return _build(ColumnSpec, parts, name)


def config_from_dict(raw: Mapping) -> TableConfig:
    """Accepts ``{"columns": {...}}`` or the bare column mapping."""
    body = raw.get("columns", raw)
    return TableConfig({name: column_from_dict(name, spec) for name, spec in body.items()})


def config_from_json(text: str) -> TableConfig:
    try:
        raw = json.loads(text)
    except (TypeError, ValueError) as exc:
        raise ConfigError(f"invalid JSON: {exc}") from exc
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a JSON object")
    return config_from_dict(raw)


def _plain(value):
    if isinstance(value, (MissingRule, ScalingRule, EncodingRule, ColumnSpec)):
        return {f.name: _plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, (frozenset, set)):
        return sorted(value)
    if isinstance(value, tuple):
        return list(value)
    if isinstance(value, Mapping):
        return dict(value)
    return value


def config_to_dict(config: TableConfig) -> dict:
    return {"columns": {name: _plain(spec) for name, spec in config.columns.items()}}


def config_to_json(config: TableConfig, indent: int | None = 2) -> str:
    return json.dumps(config_to_dict(config), indent=indent)


def read_legacy_config(raw: Mapping) -> tuple[TableConfig, list[dict]]:
    """Import an older configuration: known boolean flags become semantic roles, the rest is reported."""
    body = raw.get("columns", raw)
    known = {f.name for f in fields(ColumnSpec)}
    columns, report = {}, []
    for name, old in body.items():
        kept = {k: v for k, v in old.items() if k in known}
        roles = set(old.get("semantic_roles", ()))
        for key in (k for k in old if k not in known):
            becomes_role = key in LEGACY_ROLE_FLAGS and old[key] is True
            if becomes_role:
                roles.add(key)
            report.append(
                {
                    "column": name,
                    "legacy_field": key,
                    "legacy_value": old[key],
                    "mapped_to": "semantic_roles" if becomes_role else "ignored",
                }
            )
        columns[name] = column_from_dict(name, {**kept, "semantic_roles": roles})
    return TableConfig(columns), report

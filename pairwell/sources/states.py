"""Fitted state in and out: what was learnt on one table, kept in versions and applied to others.

A folder holds one sub-folder per version and a table of the versions that are complete; a version
counts only once its row there is written, so a run that dies half way leaves nothing to read.
Everything is written and read by Spark, so any file system the cluster can reach will do.
"""

from __future__ import annotations

import datetime
import decimal
import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators.encode import EncodeState
from ..operators.impute import ImputeState
from ..operators.propensity import PropensityModel, PropensitySpec
from ..operators.scale import ScaleState

_INDEX = "version long, created_at string"
_KINDS = {
    "date": (datetime.date, datetime.date.isoformat, datetime.date.fromisoformat),
    "time": (datetime.datetime, datetime.datetime.isoformat, datetime.datetime.fromisoformat),
    "decimal": (decimal.Decimal, str, decimal.Decimal),
}


@dataclass
class FittedState:
    """Any of the states a preparation learns; what is None was not fitted."""

    impute: ImputeState | None = None
    scale: ScaleState | None = None
    encode: EncodeState | None = None
    propensity: PropensityModel | None = None
    version: int | None = None


def _plain(value):
    for kind, (cls, write, _) in _KINDS.items():
        if type(value) is cls:
            return {kind: write(value)}
    return value


def _value(plain):
    if isinstance(plain, dict):
        kind, text = next(iter(plain.items()))
        return _KINDS[kind][2](text)
    return plain


def _facts(state: FittedState) -> dict:
    """Everything that is bounded by the number of columns, strata's models and long code lists aside."""
    out: dict = {}
    if state.impute is not None:
        i = state.impute
        out["impute"] = {
            "methods": i.methods, "context": i.context, "fills": {c: _plain(v) for c, v in i.fills.items()}, "means": i.means,
            "steps": [list(s) for s in i.steps], "donors": i.donors is not None,
        }
    if state.scale is not None:
        out["scale"] = {"center": state.scale.center, "width": state.scale.width}
    if state.encode is not None:
        out["encode"] = {"categories": {c: [_plain(v) for v in vs] for c, vs in state.encode.categories.items()}, "tables": list(state.encode.tables)}
    if state.propensity is not None:
        p = state.propensity
        out["propensity"] = {"covariates": p.covariates, "spec": asdict(p.spec), "rows": p.rows, "iterations": p.iterations}
    return out


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, created_at) of the complete versions."""
    try:
        return spark.read.schema(_INDEX).parquet(f"{str(folder).rstrip('/')}/index")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _INDEX)


def save_state(spark: SparkSession, state: FittedState, folder: str) -> int:
    """Write the state as the next version of this folder; returns its number. Earlier versions stay."""
    folder = str(folder).rstrip("/")
    version = (versions(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    root = f"{folder}/version-{version}"
    facts = json.dumps(_facts(state))
    spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{root}/facts")
    if state.impute is not None and state.impute.donors is not None:
        state.impute.donors.write.mode("overwrite").parquet(f"{root}/donors")
    if state.encode is not None:
        for i, (codes, _) in enumerate(state.encode.tables.values()):
            codes.write.mode("overwrite").parquet(f"{root}/codes-{i}")
    if state.propensity is not None:
        state.propensity.state.write.mode("overwrite").parquet(f"{root}/propensity")
    created = datetime.datetime.now(datetime.timezone.utc).isoformat()
    spark.createDataFrame([(version, created)], _INDEX).coalesce(1).write.mode("append").parquet(f"{folder}/index")
    return version


def load_state(spark: SparkSession, folder: str, version: int | None = None) -> FittedState:
    """One version of the state, the last one if none is named."""
    folder = str(folder).rstrip("/")
    known = versions(spark, folder)
    version = known.agg(F.max("version")).first()[0] if version is None else version
    if version is None or known.where(F.col("version") == version).isEmpty():
        raise StoreError(f"no fitted state in '{folder}'" + ("" if version is None else f" with version {version}"))
    root = f"{folder}/version-{version}"
    facts = json.loads(spark.read.parquet(f"{root}/facts").first()[0])
    out = FittedState(version=version)
    if "impute" in facts:
        i = facts["impute"]
        out.impute = ImputeState(
            i["methods"], i["context"], {c: _value(v) for c, v in i["fills"].items()}, i["means"],
            spark.read.parquet(f"{root}/donors") if i["donors"] else None, [(t, b, w) for t, b, w in i["steps"]],
        )
    if "scale" in facts:
        out.scale = ScaleState(facts["scale"]["center"], facts["scale"]["width"])
    if "encode" in facts:
        out.encode = EncodeState({c: [_value(v) for v in vs] for c, vs in facts["encode"]["categories"].items()})
        for i, c in enumerate(facts["encode"]["tables"]):
            codes = spark.read.parquet(f"{root}/codes-{i}")
            out.encode.tables[c] = (codes, codes.count())
    if "propensity" in facts:
        p = facts["propensity"]
        out.propensity = PropensityModel(p["covariates"], PropensitySpec(**p["spec"]), spark.read.parquet(f"{root}/propensity"), p["rows"], p["iterations"])
    return out

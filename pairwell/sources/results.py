"""Saving, loading, comparing and reusing results. Every part is written by Spark, so any
file system the cluster can reach will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators.clean import filter_rows
from ..plans.run import RunResult

_PARTS = ("tables", "datasets", "artifacts")
_METRICS = "run_id string, created_at string, metric string, value double, text string"


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_result(spark: SparkSession, result: RunResult, folder: str, table_format: str = "parquet") -> dict:
    """Write every part below ``folder``; returns the manifest with relative paths."""
    folder = str(folder).rstrip("/")
    manifest = {part: {} for part in _PARTS}
    try:
        for part in _PARTS:
            for name, df in getattr(result, part).items():
                kind = table_format if part != "artifacts" else "parquet"
                path = f"{part}/{name}.{kind}"
                writer = df.write.mode("overwrite")
                writer.csv(f"{folder}/{path}", header=True) if kind == "csv" else writer.parquet(f"{folder}/{path}")
                manifest[part][name] = path
        summary = {
            "module": result.module, "run_id": result.run_id, "created_at": result.created_at, "success": result.success,
            "error": result.error, "metrics": result.metrics, "logs": result.logs, "runtime": result.runtime, "config": result.config,
        }
        spec = result.config.get("match_spec", {})
        labels = {
            "algorithm": spec.get("strategy", {}).get("matching_algorithm"),
            "distance": spec.get("distance", {}).get("distance_metric"),
            "direction": spec.get("population", {}).get("matching_direction"),
            "use_propensity_score": str(spec.get("representation", {}).get("use_propensity_score")),
        }
        rows = [(result.run_id, result.created_at, k, None if v is None else float(v), None) for k, v in result.metrics.items()]
        rows += [(result.run_id, result.created_at, k, None, v) for k, v in labels.items()]
        spark.createDataFrame(rows, _METRICS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/metrics.parquet")
        _write_text(spark, json.dumps(summary, default=str), f"{folder}/summary.json")
        _write_text(spark, json.dumps(manifest), f"{folder}/manifest.json")
    except Exception as exc:
        raise StoreError(f"could not save the result to '{folder}': {exc}") from exc
    return manifest


def load_result(spark: SparkSession, folder: str) -> RunResult:
    folder = str(folder).rstrip("/")
    try:
        manifest = _read_json(spark, f"{folder}/manifest.json")
        summary = _read_json(spark, f"{folder}/summary.json")
    except Exception as exc:
        raise StoreError(f"no saved result in '{folder}': {exc}") from exc
    result = RunResult(**summary)
    for part in _PARTS:
        for name, path in manifest.get(part, {}).items():
            full = f"{folder}/{path}"
            df = spark.read.csv(full, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(full)
            getattr(result, part)[name] = df
    return result


def compare_runs(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row per saved run, newest first."""
    if not folders:
        raise StoreError("no runs to compare")
    saved = spark.read.parquet(*[f"{str(f).rstrip('/')}/metrics.parquet" for f in folders])
    number = lambda m, name: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(name)
    label = lambda m: F.max(F.when(F.col("metric") == m, F.col("text"))).alias(m)
    return (
        saved.groupBy("run_id", "created_at")
        .agg(
            label("algorithm"), label("distance"), label("direction"), label("use_propensity_score"),
            number("match_rate", "match_rate"), number("pair_mean_distance", "mean_distance"),
            number("pair_n_pairs", "n_pairs"), number("max_abs_smd_after", "max_abs_smd_after"),
        )
        .orderBy(F.desc("created_at"))
    )


def promote(result: RunResult, name: str, row_filters: list[tuple] = ()) -> DataFrame:
    """A dataset of a successful result as a new input table, filtered; it must not come out empty."""
    if not result.success:
        raise StoreError("the source run did not succeed")
    if name not in result.datasets:
        raise StoreError(f"no dataset '{name}'; available: {sorted(result.datasets)}")
    table = filter_rows(result.datasets[name], row_filters)
    if table.isEmpty():
        raise StoreError("the filters leave no rows")
    return table

"""Reading tables by file extension."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..errors import LoadError

READERS = {
    ".csv": ("csv", {"header": True, "inferSchema": True}),
    ".json": ("json", {"multiLine": True}),  # one document: one task reads it; see .jsonl for large tables
    ".jsonl": ("json", {}),
    ".ndjson": ("json", {}),
    ".parquet": ("parquet", {}),
    ".tsv": ("csv", {"header": True, "inferSchema": True, "sep": "\t"}),
}


def supported_extensions() -> list[str]:
    return sorted(READERS)


def load(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Read one table; the extension picks the reader. Give ``schema`` to skip inference on large text."""
    path = str(path)
    extension = PurePosixPath(path).suffix.lower()
    if extension not in READERS:
        raise LoadError(
            f"unsupported extension '{extension}' for '{path}'; supported: {', '.join(supported_extensions())}"
        )
    source, defaults = READERS[extension]
    reader = spark.read.format(source).options(**{**defaults, **options})
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except Exception as exc:
        raise LoadError(f"could not load '{path}': {exc}") from exc


@dataclass
class LoadedTables:
    """Outcome of a batch: what was read (by file stem) and what was not."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    @property
    def has_failures(self) -> bool:
        return bool(self.failures)

    def raise_if_missing(self, required: list[str]) -> None:
        lost = [f"{p}: {self.failures[p]}" for p in map(str, required) if p in self.failures]
        if lost:
            raise LoadError("required tables failed to load: " + "; ".join(lost))


def load_many(spark: SparkSession, paths: list[str], **options) -> LoadedTables:
    """Try every path and keep going."""
    batch = LoadedTables()
    for path in map(str, paths):
        try:
            batch.tables[PurePosixPath(path).stem] = load(spark, path, **options)
        except LoadError as exc:
            batch.failures[path] = str(exc)
    return batch


@dataclass(frozen=True)
class TableDescription:
    n_rows: int
    n_columns: int
    columns: list[tuple[str, str]]
    preview: DataFrame


def describe_table(df: DataFrame, preview_rows: int = 5) -> TableDescription:
    return TableDescription(df.count(), len(df.columns), list(df.dtypes), df.limit(preview_rows))


def describe_columns(df: DataFrame) -> DataFrame:
    """The description as a table: one row per column, with the table's row and column counts."""
    n_rows, n_columns = df.count(), len(df.columns)
    rows = [(i, name, n_rows, n_columns) for i, name in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, n_rows long, n_columns int")

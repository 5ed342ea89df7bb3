"""Small helpers shared by the operators: lineage cuts, checked broadcasts, reshaping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A state table is broadcast only when its counted rows stay below this number, and rows times the width of
# its columns (an array counted as so many numbers as the caller says) below this many bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def named(column: str) -> Column:
    """The column of this very name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without a NULL or NaN in the named columns."""
    for c in columns:
        fractional = isinstance(df.schema[c].dataType, T.FractionalType) and not isinstance(df.schema[c].dataType, T.DecimalType)
        df = df.where(named(c).isNotNull() & ~F.isnan(named(c)) if fractional else named(c).isNotNull())
    return df


def row_bytes(df: DataFrame, array_length: int = 64) -> int:
    """An estimate of a row's width by its types."""
    kinds = [f.dataType for f in df.schema]
    return sum(8 * array_length if isinstance(k, (T.ArrayType, T.MapType)) else 32 if isinstance(k, T.StringType) else 8 for k in kinds)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor reaches; a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="pairwell-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _ready_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there (survives lost executors).

    They are read back as a Parquet table, so that Spark knows their size from the files. A checkpoint would hand on the size
    Spark estimated for the plan: the product of both sides of every join, a number whose digits multiply from round
    to round. Only types that Parquet cannot hold, and names that differ in case alone, take a checkpoint.
    """
    spark = df.sparkSession
    odd = any(kind in t for _, t in df.dtypes for kind in ("void", "interval"))
    if odd or not df.columns or len({c.lower() for c in df.columns}) < len(df.columns):
        _ready_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_size(df: DataFrame) -> tuple[DataFrame, int]:
    """Materialise a state table and count it, so that a later broadcast is a checked one."""
    df = materialise(df)
    return df, df.count()


def attach(
    df: DataFrame, state: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None, array_length: int = 64
) -> DataFrame:
    """Join a state table to a large table; broadcast only if the counted state is small in rows and bytes."""
    if rows is None:
        state, rows = with_size(state)
    if rows <= BROADCAST_ROWS and rows * row_bytes(state, array_length) <= BROADCAST_BYTES:
        state = F.broadcast(state)
    return df.join(state, keys, how)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def melt_numeric(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, column): ``variable`` and a double ``value``; NULLs are left out."""
    if not columns:
        return df.select(*keep, F.lit("").alias("variable"), F.lit(0.0).alias("value")).where(F.lit(False))
    cells = [
        F.struct(F.lit(c).alias("variable"), named(c).cast("double").alias("value")) for c in columns
    ]
    return (
        df.select(*keep, F.explode(F.array(*cells)).alias("_cell"))
        .select(*keep, "_cell.variable", "_cell.value")
        .where(F.col("value").isNotNull())
    )


def melt_text(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Like :func:`melt_numeric`, with the value in string form."""
    if not columns:
        return df.select(*keep, F.lit("").alias("variable"), F.lit("").alias("value")).where(F.lit(False))
    cells = [
        F.struct(F.lit(c).alias("variable"), named(c).cast("string").alias("value")) for c in columns
    ]
    return (
        df.select(*keep, F.explode(F.array(*cells)).alias("_cell"))
        .select(*keep, "_cell.variable", "_cell.value")
        .where(F.col("value").isNotNull())
    )


MERGE_TASKS = 32
_NAN = float("nan")


def few_values(df: DataFrame, columns: list[str], limit: int) -> dict[str, list | None]:
    """The different values, without NULL, of each column that has at most ``limit`` of them; None for the others.

    Every task keeps at most one value more than that of each column, in the column's own type, and a few tasks join what
    they kept, so the table is read once and never shuffled.
    """
    if not columns:
        return {}
    nested = (T.ArrayType, T.MapType, T.StructType)
    kinds = [T.StringType() if isinstance(df.schema[c].dataType, nested) else df.schema[c].dataType for c in columns]
    schema = T.StructType([T.StructField(f"v{i}", T.ArrayType(k)) for i, k in enumerate(kinds)])

    def keep(batches: Iterator[pa.RecordBatch], listed: bool) -> Iterator[pa.RecordBatch]:
        held: list = [None] * len(columns)
        for batch in batches:
            for i in range(len(columns)):
                if held[i] is None or len(held[i]) <= limit:
                    new = pc.unique(batch.column(i).flatten() if listed else batch.column(i)).drop_null()
                    held[i] = pc.unique(pa.concat_arrays([held[i], new])) if held[i] is not None else new
                    held[i] = held[i][: limit + 1]
        if held[0] is not None:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), h) for h in held]
            yield pa.RecordBatch.from_arrays(lists, names=schema.names)

    kept = df.select(*[named(c).cast(kinds[i]).alias(f"v{i}") for i, c in enumerate(columns)]).mapInArrow(lambda b: keep(b, False), schema)
    rows = kept.repartition(MERGE_TASKS).mapInArrow(lambda b: keep(b, True), schema).collect()
    out: dict[str, list | None] = {}
    for i, c in enumerate(columns):
        values = {v if v == v else _NAN for r in rows for v in r[i]}
        out[c] = sorted(values, key=lambda v: (v != v, v)) if len(values) <= limit else None
    return out


def value_counts_by_name(long_df: DataFrame) -> DataFrame:
    return long_df.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def wide_to_long(row_df: DataFrame, columns: list[str], fields: list[str], keep: list[str] = ()) -> DataFrame:
    """Turn the columns ``<field>__<i>`` of a one-pass aggregate into one row per column.

    ``i`` is the position in ``columns``; the output has ``variable`` and the fields.
    """
    cells = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{f}__{i}").alias(f) for f in fields])
        for i, c in enumerate(columns)
    ]
    return row_df.select(*keep, F.explode(F.array(*cells)).alias("_cell")).select(*keep, "_cell.*")

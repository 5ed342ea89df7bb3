"""Helpers on whole batches of texts inside a task: word bounds and 64-bit hashes, all vectorised.

A batch is cut into slices of about ``SLICE`` bytes (a longer text is a slice of its own), so that
the arrays of a task stay small whatever the batch holds. Texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _table(base: int, size: int) -> np.ndarray:
    """``base ** i mod 2**64`` for ``i < size``; kept, and made longer when a longer text comes."""
    if base not in _powers or len(_powers[base]) < size:
        steps = np.full(max(size, SLICE + SLICE // 2), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row, NULL as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together; a longer text is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def sliced(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, list[bytes]]]:
    """The slices of a column with their texts, so that only one slice at a time is there as Python objects."""
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, byte_texts(column[a:b])


def words(texts: list[bytes], gap: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, first and past-the-end byte of each word, and the first word of each text (plus the total)."""
    buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = gap[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edges[0::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return buffer, first, last, np.searchsorted(first, begins)


def span_hashes(buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``buffer[first:last]``: a polynomial from prefix sums, then mixed."""
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(buffer * _table(_BASE, len(buffer))[: len(buffer)], out=total[1:])
    raw = (total[last] - total[first]) * _table(_INVERSE, len(buffer))[first]
    return mix(raw + (last - first).astype(np.uint64))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def refuse_clash(df: DataFrame, added: list[str]) -> None:
    clash = {a.lower() for a in added} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")


def with_columns(df: DataFrame, added: str) -> T.StructType:
    """Schema of ``df`` with columns added, for mapInArrow."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def appended(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])


def prefix(name: str) -> str:
    return f"own_{name}"


def prefixed(df: DataFrame) -> DataFrame:
    """All columns renamed, so that an operator's own column names cannot clash with them."""
    return df.select(*[F.col(quoted(c)).alias(prefix(c)) for c in df.columns])


def unprefixed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(quoted(prefix(c))).alias(c) for c in like.columns])

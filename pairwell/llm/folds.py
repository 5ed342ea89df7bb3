"""Folds by the CRC of an id, and bounded samples by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 20


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def sampled(df: DataFrame, rows: int, salt: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the id over the whole table; all if there are fewer."""
    total = df.count()
    share = _PARTS if total <= rows else int(_PARTS * rows / total)
    return df.where(F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(_PARTS)) < share)

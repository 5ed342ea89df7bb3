"""Target-distribution importance resampling over hashed word features.

Features are runs of 1 to ``runs`` consecutive words (joined by one space, repeats counted); a word is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A feature's bucket is the unsigned CRC-32 of
its UTF-8 bytes modulo ``buckets``. Inside a task the distinct features of a slice of texts are grouped by their
length: each group is a two-dimensional uint8 array, all its CRCs are advanced column by column, and the buckets are
scattered back to where the features stand.

Two passes over the corpus: bucket counts (at most ``buckets`` rows a task, summed by a groupBy), then the weight of
each document. The gains are ``buckets`` numbers, whatever the size of the tables, and go to the tasks with the code.

Defined cases: a NULL, empty or word-free text has no feature and weight 0; a NULL doc_id draws its noise as the
empty string and comes first among equal scores; repeated rows are counted and drawn one by one; with an empty corpus
the result is empty; with an empty target all of it counts as 0. A very long text is held whole in one task (some 60
bytes per byte of text), a very long word costs one step per byte. Extra columns are not read by ``resampled``; clashing
names in ``weighted`` are refused.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import running_total
from .tables import written
from .text import LOWER, appended, byte_texts, quoted, refuse_clash, slices, with_columns, words

BUCKETS = 10_000
RUNS = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


_CRC = _crc_table()


def crcs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``flat``: one matrix per length, all its rows one byte further at a time."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    for n, rows in zip(sizes.tolist(), np.split(order, first[1:])):
        matrix = flat[starts[rows, None] + np.arange(n)]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix.T:
            crc = _CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _spans(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The spans as one Arrow array, copied next to each other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[at])])


def features(texts: list[bytes], buckets: int, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features in a row, where each text's begin (plus the total), and the texts' word counts."""
    buffer, first, last, begins = words([t.translate(LOWER) for t in texts], _GAP)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), np.int64)
    lengths = last - first
    # all words again with exactly one blank between them, so that a run of words is one span
    spaced = np.full(int((lengths + 1).sum()), 32, np.uint8)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    spaced[np.repeat(starts, lengths) + within] = buffer[np.repeat(first, lengths) + within]
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    found, owners = [], []
    for n in range(1, runs + 1):
        heads = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        if not len(heads):
            break
        sizes = starts[heads + n - 1] + lengths[heads + n - 1] - starts[heads]
        coded = _spans(spaced, starts[heads], sizes).dictionary_encode()
        flat = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)
        bounds = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1]
        distinct = crcs(flat, bounds[:-1], np.diff(bounds)).astype(np.int64) % buckets
        found.append(distinct[coded.indices.to_numpy()])
        owners.append(owner[heads])
    all_owners = np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    counts = np.bincount(all_owners, minlength=len(texts))
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(counts)]), np.diff(begins)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """How many features of the table fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw = byte_texts(batch.column(0))
            for a, b in slices([len(t) for t in raw]):
                total += np.bincount(features(raw[a:b], buckets, runs)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col(quoted(text)).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most one row per bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: thousandths of the log ratio of the two smoothed shares, rounded down."""
    k, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = [float(t + 1) * float(all_s + k) / (float(s + 1) * float(all_t + k)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths from a hash of the id, so that the highest sums are a draw by weight."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_features, weight (sum of gains) and score (weight and noise)."""
    refuse_clash(docs, ["n_words", "n_features", "weight", "score"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = byte_texts(batch.column(text))
            for a, b in slices([len(t) for t in raw]):
                at, begins, n_words = features(raw[a:b], len(gain), runs)
                upto = np.concatenate([[0], np.cumsum(gain[at])])
                weight = upto[begins[1:]] - upto[begins[:-1]]
                score = [w + noise(seed, i) for w, i in zip(weight.tolist(), batch.column(doc_id)[a:b].to_pylist())]
                yield appended(batch.slice(a, b - a), {
                    "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(np.diff(begins), pa.int64()),
                    "weight": pa.array(weight, pa.int64()), "score": pa.array(score, pa.int64()),
                })

    return docs.mapInArrow(weigh, with_columns(docs, "n_words long, n_features long, weight long, score long"))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
              buckets: int = BUCKETS, runs: int = RUNS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is NULL if it was not drawn.

    Of the N documents with at least ``least_words`` words the ``floor(percent * N / 100)`` with the highest scores are
    drawn, ties to the smaller id. Positions come from range-partitioned rows, so no task sorts them all.
    """
    own = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    gain = gains(bucket_counts(own, "text", buckets, runs), bucket_counts(target, target_text, buckets, runs))
    scored = weighted(own, gain, runs=runs, seed=seed).select("doc_id", "n_words", "n_features", "weight", "score")
    scored = written(scored.withColumns({"low": -F.col("score"), "row": F.monotonically_increasing_id()}))
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    placed = running_total(fit, [], ["low", "doc_id", "n_features", "row"], out="rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("low", "row")


def resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: documents drawn towards the benchmark's words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 byte by byte over the distinct words.
SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
occ AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY 1, 2),
feats AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM occ UNION SELECT f FROM b)),
coded AS (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)), lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1]), 4294967295), 4294967295) % 10000 AS k FROM feats, tab),
s AS (SELECT k, sum(n) AS s FROM occ JOIN coded USING (f) GROUP BY 1),
t AS (SELECT k, count(*) AS t FROM b JOIN coded USING (f) GROUP BY 1),
gain AS (SELECT k, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM s FULL JOIN t USING (k)),
w AS (SELECT r, sum(n * g) AS weight, sum(n) AS n FROM occ JOIN coded USING (f) JOIN gain USING (k) GROUP BY 1),
scored AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS p FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN p END AS rank FROM ranked
"""

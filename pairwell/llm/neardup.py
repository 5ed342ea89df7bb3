"""Near duplicates by one-permutation hashing with optimal densification.

1. A text becomes the set of 64-bit hashes of its word shingles. One hash function gives the whole
   signature: its top bits choose the bin, each bin keeps its minimum, an empty bin takes the value of a
   full bin found by hashing (bin, attempt).
2. Texts with equal sets (128-bit digest) are one class with one representative.
3. Bands of signature rows are bucket keys. Within a bucket the edges are stars: first from the one member
   that shares most bucket places, then from the best of each of ``STARS`` random parts, to the members of other
   components. Stars join nearly all of a group, and buckets with one component are dropped. In the few
   that are left, pairs of members of different components are compared, so that no link is lost while
   pairs inside a component are never formed.
   Each row carries an odd sketch (bit parities of its set): the bits in which two sketches differ are at most the
   hashes in which the sets differ, so pairs that cannot reach the threshold are dropped inside the join.
4. Each remaining edge is confirmed on the full sets. Components come from the confirmed edges.

A pair with similarity s is missed with probability (1 - s**rows)**bands. ``banding`` takes the longest bands for which
that stays below ``MISS`` at the threshold: 32 bands of 8 at 0.85 (op7; 0.00004), 42 bands of 6 at 0.8 (the pipeline; 0.000003).
Thresholds below 4 percent cannot be kept with 256 bins and are refused.

Defined cases: NULL, empty and word-free texts have an empty set, are linked with nothing and kept;
fewer words than a shingle: all of them are the one shingle; repeated rows (equal doc_id and text) and
copies share a component whose id is the smallest doc_id; a NULL doc_id is linked with nothing, kept,
and its component_id is NULL; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import small, written
from .text import LOWER, mix, prefix, prefixed, quoted, sliced, span_hashes, unprefixed, words

BINS = 256
MISS = 0.0001
_SHIFT = np.uint64(64 - 8)

SKETCH = 16  # longs
STARS = 16

_SALTS = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_ATTEMPTS = 512
# The bin that an empty bin asks in each attempt.
_DONORS = (mix(np.arange(_ATTEMPTS * BINS, dtype=np.uint64) + np.uint64(1 << 40)) >> _SHIFT).astype(np.int64).reshape(_ATTEMPTS, BINS)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buffer, first, last, begins = words([t.translate(LOWER) for t in texts])
    hashes = span_hashes(buffer, first, last)
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled += hashes[j : j + n] * _SALTS[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.atleast_1d((hashes[a:b] * _SALTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """One minimum per bin of a sorted, non-empty set; empty bins densified."""
    bins = (values >> _SHIFT).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    full = np.zeros(BINS, bool)
    full[bins[heads]] = True
    sig = np.zeros(BINS, np.uint64)
    sig[bins[heads]] = values[heads]
    if len(heads) < BINS:
        empty = np.flatnonzero(~full)
        asked = _DONORS[:, empty]
        good = full[asked]
        attempt = good.argmax(0)
        donor = asked[attempt, np.arange(len(empty))]
        lost = ~good[attempt, np.arange(len(empty))]
        donor[lost] = bins[heads[0]]  # after all attempts: the first full bin
        sig[empty] = sig[donor]
    return sig


_KEYS = mix(np.arange(BINS, dtype=np.uint64) + np.uint64(7 << 50)) | np.uint64(1)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows with a miss below ``MISS`` for pairs at the threshold."""
    for rows in range(BINS, 0, -1):
        bands = BINS // rows
        if (1 - (percent / 100) ** rows) ** bands < MISS:
            return bands, rows
    raise ValueError(f"links of {percent} percent cannot be found with {BINS} bins")


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    used = bands * rows
    return mix((sig[:used] * _KEYS[:used]).reshape(bands, rows).sum(1, dtype=np.uint64)).view(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity of how many hashes fall on each of the bits."""
    bits = np.bincount((values & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _signatures(width: int, percent: int):
    bands, rows = banding(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in sliced(batch.column(1)):
                sets = shingle_sets(texts, width)
                keys = [band_keys(signature(s), bands, rows) if len(s) else none for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids[a:b], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([mix(s).sum(dtype=np.uint64).astype(np.int64) for s in sets], pa.int64()),
                    pa.array([mix(s ^ _SALTS[0]).sum(dtype=np.uint64).astype(np.int64) for s in sets], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])

    return work


def _full_sets(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in sliced(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], names=["rep", "hashes"])

    return work


def _confirm(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ha"), batch.column("hb")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs: a merge
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(keep, pa.bool_())], names=["u", "v", "linked"])

    return work


def classes(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least ``percent``), kept."""
    texts = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    sigs = written(texts.mapInArrow(_signatures(width, percent), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"))
    same = ["n_shingles", "d1", "d2"]
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = written(full.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    found = _linked(texts, full.select("doc_id", "bands", "n_shingles", "sketch"), reps.select("rep"), width, percent)
    reps = reps.join(small(found, 16).withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    alone = sigs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = full.select("doc_id", *same).join(reps, same).select("doc_id", "n_shingles", "component_id")
    return grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _within_reach(percent: int) -> Column:
    """What two sets can share at most, by their sizes and sketches, is enough for a link."""
    odd = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("other_sketch")[k])) for k in range(1, SKETCH)), F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("other_sketch")[0])))
    both = F.col("n") + F.col("other_n")
    sizes = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
    return sizes & (odd * (100 + percent) <= both * (100 - percent))


def _linked(texts: DataFrame, full: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) over the confirmed links of the representatives."""
    # bucket places of the representatives, only of buckets with two members or more
    own = written(full.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").withColumnsRenamed({"doc_id": "rep", "n_shingles": "n"}))
    placed = own.select("rep", F.explode("bands").alias("key")).distinct()
    live = written(placed.join(placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"))
    degrees = live.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("degree"))
    wanted = small(written(live.select(F.col("rep").alias("doc_id")).distinct()), 8)
    sets = written(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(width), "rep long, hashes binary").distinct())
    live = live.join(own.join(degrees, "rep").select("rep", "n", "sketch", "degree"), "rep").select("key", "rep", "n", "sketch", "degree", F.col("rep").alias("component"))
    found, links = texts.sparkSession.createDataFrame([], "node long, component long"), None
    for parts in (1, STARS, None):
        live = written(live)
        spread = live.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        live = written(live.join(spread, "key", "left_semi"))
        if live.isEmpty():
            break
        if parts:
            best = live.groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(parts)).alias("part")).agg(F.max(F.struct("degree", "rep")).alias("best"))
            others = best.select("key", F.col("best.rep").alias("rep")).join(live, ["key", "rep"])
        else:
            others = live
        others = others.select("key", *[F.col(c).alias(f"other_{c}") for c in ("rep", "n", "sketch", "component")])
        pairs = live.join(others, (live["key"] == others["key"]) & (F.col("component") != F.col("other_component")) & _within_reach(percent) & (F.col("rep") < F.col("other_rep") if not parts else F.lit(True)))
        pairs = pairs.select(F.least("rep", "other_rep").alias("u"), F.greatest("rep", "other_rep").alias("v")).distinct()
        loaded = pairs.join(sets.withColumnsRenamed({"rep": "u", "hashes": "ha"}), "u").join(sets.withColumnsRenamed({"rep": "v", "hashes": "hb"}), "v")
        judged = written(loaded.select("u", "v", "ha", "hb").mapInArrow(_confirm(percent), "u long, v long, linked boolean")).where("linked").select("u", "v")
        links = judged if links is None else links.unionByName(judged)
        found = written(components(links))
        live = live.drop("component").join(small(found, 16).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return found


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: three-word shingles, links from 0.85."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline form: one document of each group stays, the one with the smallest doc_id."""
    own, key = prefixed(docs), prefix("doc_id")
    gone = classes(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    kept = own.join(small(written(gone), 8), key, "left_anti")
    # rows that repeat a doc_id are in one class, too: of equal texts one row stays
    twice = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if not twice.isEmpty():
        again = small(twice, 8)
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key, prefix("text")]))
    return unprefixed(kept, docs)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
c AS (SELECT u, min(v) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id
"""

"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased: runs of ASCII
letters and digits and of anything outside ASCII. A window is 13 consecutive words of an item; an
item of fewer words, but not none, is one window. Every text is scanned once; a hit is mapped back to
the word and the character of the original text where it stands.

Defined cases: a NULL or word-free text has no words, no hits, no spans; a NULL or word-free item
has no window; items with equal windows are all named; repeated rows each get their result. Extra
columns are left alone by ``mark`` (a clashing name is refused before any work starts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import appended, prefix, prefixed, refuse_clash, sliced, unprefixed, with_columns, words

WINDOW = 13
# The automaton is sent to every task. It takes some 300 bytes per word of the test items, so test sets above this
# many words are refused with an error (raise the parameter with the executors' memory); none is cut.
MOST_WORDS = 2_000_000

# Position-preserving: what is no word byte becomes a blank, A-Z becomes a-z.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_GAP = np.zeros(256, bool)
_GAP[[32, 10]] = True


class Automaton:
    """The test items as patterns of one scan. Bytes are read as Latin-1, one character each.

    Not every window is a pattern: items are cut into blocks of (window + 1) // 2 words, and any window holds a whole
    block. Where a block is found, the match is extended to both sides along the item; a run of at
    least a window's length is made of windows. Items shorter than a window are patterns themselves.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.block = window, (window + 1) // 2
        self.items = [i for i, _ in items]
        self.words = [(t or "").encode().translate(NORMAL).split() for _, t in items]
        owners: dict[bytes, list[tuple[int, int]]] = {}
        for place, own in enumerate(self.words):
            if 0 < len(own) < window:
                owners.setdefault(b" ".join(own), []).append((place, 0))
            for at in range(0, len(own) - self.block + 1, self.block) if len(own) >= window else ():
                owners.setdefault(b" ".join(own[at : at + self.block]), []).append((place, at))
        self.scan = ahocorasick.Automaton() if owners else None
        for pattern, places in owners.items():
            self.scan.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, places))
        if owners:
            self.scan.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, past-the-end word, place of the item) of every run of windows in a text."""
        if self.scan is None or not words:
            return []
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.scan.iter(line))
        if not found:
            return []
        blanks = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        runs, covered = [], {}
        for end, (n, places) in found:
            stop = int(blanks[end]) - 1
            start = stop - n
            for place, at in places:
                own = self.words[place]
                if len(own) < self.window:
                    if n == len(own):
                        runs.append((start, stop, place))
                    continue
                if covered.get((place, start - at), 0) > start:
                    continue  # inside a run along the same words
                a, i = start, at
                while a and i and words[a - 1] == own[i - 1]:
                    a, i = a - 1, i - 1
                b, j = stop, at + n
                while b < len(words) and j < len(own) and words[b] == own[j]:
                    b, j = b + 1, j + 1
                covered[place, start - at] = b
                if b - a >= self.window:
                    runs.append((a, b, place))
        return runs


def _char_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words (first word, past-the-end word)."""
    _, first, last, _ = words([raw.translate(NORMAL)], _GAP)
    lead = np.frombuffer(raw, np.uint8)
    chars = np.concatenate([[0], np.cumsum((lead & 0xC0) != 0x80)])  # characters before each byte
    return [(int(chars[first[a] - 1]), int(chars[last[b - 1] - 1])) for a, b in runs]  # the buffer has one byte before


def scan_text(raw: bytes, automaton: Automaton) -> dict:
    """What one text holds: counts, named items and the spans of hit words."""
    words = raw.translate(NORMAL).split()
    n, hits = len(words), automaton.hits(words)
    if not hits:
        return {"n_words": n, "n_hit": 0, "items": [], "spans": []}
    step = np.zeros(n + 1, np.int64)
    for a, b, _ in hits:
        step[a] += 1
        step[b] -= 1
    inside = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    runs = list(zip(edges[0::2].tolist(), edges[1::2].tolist()))
    items = sorted({automaton.items[p] for *_, p in hits}, key=str)
    return {"n_words": n, "n_hit": int(inside.sum()), "items": items, "spans": _char_spans(raw, runs)}


_SCAN = """n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean,
spans array<struct<start:int,end:int>>"""
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _items(benchmark: DataFrame, item_id: str, text: str) -> list[tuple]:
    """The test items, read through the driver once their size is known to be bounded."""
    rows = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    words = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if words // 2 > MOST_WORDS and (rows.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0) > MOST_WORDS:
        raise ValueError(f"the test items have more than {MOST_WORDS} words")
    return [(r.i, r.t) for r in rows.toLocalIterator()]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` plus counts, item names (as strings), their digest, the verdict and the spans.

    contaminated: ``n_hit > 0 and 20 * n_hit >= n_words``.
    """
    refuse_clash(docs, ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"])
    spark = docs.sparkSession
    items = spark.sparkContext.broadcast(_items(benchmark, item_id, item_text))
    built: list[Automaton] = []  # filled in the worker

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Automaton(items.value, window))
        for batch in batches:
            found = [scan_text(t, built[0]) for _, _, texts in sliced(batch.column(text)) for t in texts]
            names = [[str(i) for i in f["items"]] for f in found]
            yield appended(batch, {
                "n_words": pa.array([f["n_words"] for f in found], pa.int64()),
                "n_hit": pa.array([f["n_hit"] for f in found], pa.int64()),
                "n_items": pa.array([len(x) for x in names], pa.int64()),
                "items": pa.array(names, pa.list_(pa.string())),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                "contaminated": pa.array([f["n_hit"] > 0 and 20 * f["n_hit"] >= f["n_words"] for f in found], pa.bool_()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in f["spans"]] for f in found], _SPANS),
            })

    return docs.mapInArrow(scan, with_columns(docs, _SCAN))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query over the whole tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline form: the documents that are not contaminated, with their own columns."""
    marked = mark(prefixed(docs), benchmark, prefix("text"))
    return unprefixed(marked.where(~F.col("contaminated")), docs)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
occ AS (SELECT p.doc_id, i, p.k, item_id FROM places p JOIN win ON p.k = win.k AND array_to_string(p.w[i : i + p.k - 1], ' ') = win.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

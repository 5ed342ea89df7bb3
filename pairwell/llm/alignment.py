"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Both tokenizers read a blank and the text; A is a byte-level BPE, B a sentence-piece model that adds the blank itself.
Tokens are byte ranges. Offsets where tokens of both end cut them into groups: the components of overlapping tokens.
Every token points to its farthest-right overlapping token; the pointers of all tokens of a slice are doubled at once
until none changes, and then each token points to the last token of its group, which labels it.

Neither tokenizer merges across a blank that follows a visible character (checked for the vocabulary of B), so a text is
aligned piece by piece between such blanks, and each different piece once as long as it is kept.

Links are all pairs of an A and a B token occurrence in one group. A pair's count is the number of documents that hold
it linked. Pairs are kept per document as (code, links), so their number is bounded by the different ids of a group.
Counts come from a groupBy. They are joined back in two parts: the frequent pairs, as many as fit the stated bound, are
broadcast; only occurrences of the others are shuffled.

Defined cases: NULL and empty texts, and texts whose bytes either tokenizer does not give back, have no tokens; repeated
rows are documents of their own; a NULL doc_id is kept; an empty table gives no row. A very long text is one slice of
its task. Extra columns are left alone by ``aligned``; clashing names are refused.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written
from .text import appended, quoted, refuse_clash, slices, with_columns

# A pair is coded as id of A * 2**ID_BITS + id of B.
ID_BITS = 17
# Bytes of the pieces a task keeps aligned; beyond that it starts anew. Results do not depend on it.
KEPT_BYTES = 128 << 20
# Pairs whose counts are broadcast (some 40 bytes each), the most frequent first; the others are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
# Links expanded at once while pairs are counted.
_STEP = 1 << 20

_CUT = re.compile(r"(?<=\S) ")
# What a byte-level BPE of this kind takes as words (fixed).
_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def jumped(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and each B token; both cover the same bytes without a gap."""
    n = len(a_ends)
    to_b = np.searchsorted(b_ends, a_ends) + n  # the B token that holds A's last byte reaches farthest
    to_a = np.searchsorted(a_ends, b_ends)
    last = a_ends[to_a] == b_ends if n else np.zeros(len(b_ends), bool)
    to = np.concatenate([to_b, np.where(last, np.arange(n, n + len(b_ends)), to_a)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    number = np.cumsum(last) - 1  # of the groups' last tokens, in order
    group = number[to - n]
    return group[:n], group[n:]


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _gather(begins: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the rows ``at`` of a flat table, and how many each has."""
    sizes = begins[at + 1] - begins[at]
    ends = np.cumsum(sizes)
    return np.repeat(begins[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


def _summed(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(amounts[order], first) if len(first) else amounts[:0]


class Tokens:
    """One tokenizer: ids of lines, and the bytes of each id."""

    def __init__(self, encode, parts: list[bytes]):
        self.encode = encode
        self.bytes, self.begins = _flat(parts)

    def same(self, ids: np.ndarray, raw: bytes) -> bool:
        at, sizes = _gather(self.begins, ids)
        return sizes.sum() == len(raw) and self.bytes[at].tobytes() == raw


def byte_level(path: str) -> Tokens:
    """A: the tokenizer of a JSON file whose entries are byte-level coded.

    ASCII lines go through the same vocabulary as ranks, which is faster; that this gives the same ids is checked on the
    file: the k-th merge must make the k-th entry after the single bytes.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # printable bytes stand for themselves, the others for the characters from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    model = json.loads(tokenizer.to_str())["model"]
    special = {t for t in model["vocab"] if not all(c in byte_of for c in t)}
    special |= {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    vocabulary = tokenizer.get_vocab()
    parts = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        parts[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranked = all(vocabulary[m] == 256 + k for k, m in enumerate(merges)) and len(merges) + 256 == len(model["vocab"]) - len(special & set(model["vocab"]))
    fast = None
    if ranked:
        ranks = {parts[i]: i for t, i in model["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(lines: list[str]) -> list[np.ndarray]:
        slow = [i for i, t in enumerate(lines) if fast is None or not t.isascii()]
        out = [None if fast is None or not t.isascii() else np.array(fast.encode_ordinary(" " + t), np.int64) for t in lines]
        for i, e in zip(slow, tokenizer.encode_batch_fast([" " + lines[i] for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.int64)
        return out

    return Tokens(encode, parts)


def pieces(path: str) -> Tokens:
    """B: a sentence-piece model that adds a blank before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in names):
        raise ValueError("a piece goes on after a blank, so texts cannot be cut at blanks")
    parts = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    blank = np.array(model.encode("x ")[1:], np.int64)  # a lone blank; the model gives nothing for an empty text

    def encode(lines: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) if t else blank for t, ids in zip(lines, model.encode(lines, num_threads=1))]

    return Tokens(encode, parts)


class Aligned:
    """Pieces of texts, each standing for a blank and itself, with their groups and pairs."""

    def __init__(self, a_path: str, b_path: str, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        self.a, self.b, self.kept_bytes = byte_level(a_path), pieces(b_path), kept_bytes
        self.restart()

    def restart(self):
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        self.weight = 0
        # per piece: tokens of A, of B, groups, links, bytes (-1: not given back), end of its pairs, end of its group ends
        self.rows = np.zeros((1024, 7), np.int64)
        self.codes, self.links, self.ends = (np.zeros(4096, t) for t in (np.int64, np.int64, np.int32))

    @staticmethod
    def _put(array: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        if at + len(new) > len(array):
            array = np.concatenate([array, np.zeros((max(len(array), len(new)), *array.shape[1:]), array.dtype)])
        array[at : at + len(new)] = new
        return array

    def encoded(self, new: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[list[str]], list[bool]]:
        """Ids by A and B of the lines, the pieces of each line, and whether both give its bytes back."""
        lines = []
        for part in ([p for p in new if p.isascii()], [p for p in new if not p.isascii()]):
            line, size = [], 0
            for p in part:
                if not p or p[-1].isspace() or len(p) > 1000:  # the end of a text, or long enough
                    lines.append([p])
                    continue
                line.append(p)
                size += len(p)
                if size > 1000:
                    lines.append(line)
                    line, size = [], 0
            lines += [line] * bool(line)
        while True:
            texts = [" ".join(x) for x in lines]
            ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
            good = [self.a.same(x, raw) and self.b.same(y, raw) for x, y, raw in zip(ids_a, ids_b, [(" " + t).encode() for t in texts])]
            if all(g or len(x) == 1 for g, x in zip(good, lines)):
                return ids_a, ids_b, lines, good
            lines = [y for g, x in zip(good, lines) for y in ([x] if g else [[p] for p in x])]

    def learn(self, new: list[str]):
        ids_a, ids_b, lines, good = self.encoded(new)
        none = np.zeros(0, np.int64)
        a = np.concatenate([none, *[x for x, g in zip(ids_a, good) if g]])
        b = np.concatenate([none, *[x for x, g in zip(ids_b, good) if g]])
        kept = [p for x, g in zip(lines, good) if g for p in x]
        lost = [p for x, g in zip(lines, good) if not g for p in x]
        sizes = np.array([len(p.encode()) + 1 for p in kept], np.int64)
        stops = np.cumsum(sizes)
        a_ends, b_ends = (np.cumsum(np.diff(t.begins)[x]) for t, x in ((self.a, a), (self.b, b)))
        of_a, of_b = jumped(a_ends, b_ends)
        n_a, n_b = np.bincount(of_a), np.bincount(of_b)
        ends = a_ends[np.cumsum(n_a) - 1]  # of the groups
        owner = np.searchsorted(stops, ends)  # the piece of a group
        table = np.zeros((len(kept) + len(lost), 7), np.int64)
        table[len(kept) :, 4] = -1
        rows = table[: len(kept)]
        for column, amounts in ((0, n_a), (1, n_b), (2, np.ones(len(ends), np.int64)), (3, n_a * n_b)):
            rows[:, column] = np.bincount(owner, amounts, len(kept)).astype(np.int64) if len(owner) else 0
        rows[:, 4] = sizes
        keys, links = self._pairs(of_a, a, of_b, b, owner)
        had, upto = len(self.places), self.filled
        pairs_end = np.searchsorted(keys >> np.int64(2 * ID_BITS), np.arange(1, len(table) + 1))
        groups_end = np.searchsorted(owner, np.arange(1, len(table) + 1))
        table[:, 5], table[:, 6] = upto[0] + pairs_end, upto[1] + groups_end
        self.codes = self._put(self.codes, upto[0], keys & np.int64((1 << 2 * ID_BITS) - 1))
        self.links = self._put(self.links, upto[0], links)
        self.ends = self._put(self.ends, upto[1], (ends - (stops - sizes)[owner]).astype(np.int32))
        self.rows = self._put(self.rows, had, table)
        self.groups += _spelt(of_a, a, of_b, b, owner, len(table))
        self.places.update(zip(kept + lost, range(had, had + len(table))))
        self.weight += 300 * len(table) + int(sizes.sum()) + 30 * len(keys) + 12 * len(a) + 12 * len(b)

    @property
    def filled(self) -> tuple[int, int]:
        """Entries in the flat tables of pairs and of group ends."""
        n = len(self.places)
        return (int(self.rows[n - 1, 5]), int(self.rows[n - 1, 6])) if n else (0, 0)

    @staticmethod
    def _pairs(of_a: np.ndarray, a: np.ndarray, of_b: np.ndarray, b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece and pair, links) of all groups; equal ids of a group are joined first, and links expanded in steps."""
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.int64((1 << ID_BITS) - 1)
        key_a, times_a = np.unique((of_a << np.int64(ID_BITS)) | a, return_counts=True)
        key_b, times_b = np.unique((of_b << np.int64(ID_BITS)) | b, return_counts=True)
        begins = np.searchsorted(key_b >> np.int64(ID_BITS), np.arange(len(owner) + 1))
        group = key_a >> np.int64(ID_BITS)
        upto = np.cumsum((begins[1:] - begins[:-1])[group])
        cuts = np.unique(np.concatenate([np.searchsorted(upto, np.arange(0, upto[-1], _STEP)), [len(group)]]))
        keys, links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held_keys, held_links, held = [], [], 0
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at, sizes = _gather(begins, group[x:y])
            left = ((owner[group[x:y]] << np.int64(ID_BITS)) | (key_a[x:y] & low)) << np.int64(ID_BITS)
            k, n = _summed(np.repeat(left, sizes) | (key_b[at] & low), np.repeat(times_a[x:y], sizes) * times_b[at])
            held_keys.append(k)
            held_links.append(n)
            held += len(k)
            if held > 4 * _STEP + len(keys) or y == len(group):
                keys, links = _summed(np.concatenate([keys, *held_keys]), np.concatenate([links, *held_links]))
                held_keys, held_links, held = [], [], 0
        return keys, links

    def texts(self, texts: list[str | None], spans: bool) -> dict[str, pa.Array]:
        """The columns that ``aligned`` adds, without the row number."""
        if self.weight > self.kept_bytes:
            self.restart()
        words, begins = [], [0]
        for t in texts:
            if t:
                words += _CUT.split(t)
            begins.append(len(words))
        begins = np.array(begins, np.int64)
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(at < 0).tolist()
        if unseen:
            self.learn(list(dict.fromkeys(words[i] for i in unseen)))
            at[unseen] = [self.places[words[i]] for i in unseen]
        owner = np.repeat(np.arange(len(texts)), np.diff(begins))
        lost = np.zeros(len(texts), bool)
        lost[owner[self.rows[at, 4] < 0]] = True
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.rows[at, :4], axis=0)])
        numbers = np.where(lost[:, None], 0, sums[begins[1:]] - sums[begins[:-1]])
        names, bounds = self.groups, begins.tolist()
        spelt = ["" if gone else ";".join([names[i] for i in at[x:y].tolist()]) for x, y, gone in zip(bounds[:-1], bounds[1:], lost.tolist())]
        good = ~lost[owner]
        heads = np.concatenate([[0], self.rows[: len(self.places), 5]])
        keys, times = _summed((owner[good] << np.int64(32)) | at[good], np.ones(int(good.sum()), np.int64))
        place, sizes = _gather(heads, keys & np.int64(0xFFFFFFFF))
        keys, links = _summed(
            np.repeat(keys >> np.int64(32), sizes) << np.int64(2 * ID_BITS) | self.codes[place], np.repeat(times, sizes) * self.links[place]
        )
        offsets = pa.array(np.searchsorted(keys >> np.int64(2 * ID_BITS), np.arange(len(texts) + 1)), pa.int32())
        out = {c: pa.array(numbers[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        out["groups"] = pa.array(spelt, pa.string())
        out["pairs"] = pa.ListArray.from_arrays(offsets, pa.array(keys & np.int64((1 << 2 * ID_BITS) - 1)))
        out["links"] = pa.ListArray.from_arrays(offsets, pa.array(links))
        if spans:
            stops = np.cumsum(self.rows[at, 4])
            shift = stops - self.rows[at, 4]
            first = np.append(shift, 0)[begins[:-1]]
            place, sizes = _gather(np.concatenate([[0], self.rows[: len(self.places), 6]]), at[good])
            ends = self.ends[place] + np.repeat((shift - first[owner])[good], sizes)
            per_text = np.bincount(np.repeat(owner[good], sizes), minlength=len(texts))
            out["ends"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), pa.array(ends, pa.int32()))
        return out


_DIGITS, _DIGITS_AT = _flat([b"%d" % i for i in range(1 << ID_BITS)])


def _spelt(of_a: np.ndarray, a: np.ndarray, of_b: np.ndarray, b: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each of ``n`` pieces, from the group of each token and the piece of each group."""
    if not len(a):
        return [""] * n
    ids = np.empty(len(a) + len(b), np.int64)
    after = np.full(len(ids), ord(","), np.uint8)
    place_a = np.arange(len(a)) + np.searchsorted(of_b, of_a)
    place_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")
    ids[place_a], ids[place_b] = a, b
    after[place_a[np.append(of_a[1:] != of_a[:-1], True)]] = ord("|")
    after[ends := place_b[np.append(of_b[1:] != of_b[:-1], True)]] = ord(";")
    at, sizes = _gather(_DIGITS_AT, ids)
    stops = np.cumsum(sizes + 1)
    out = np.empty(stops[-1], np.uint8)
    out[np.arange(len(at)) + np.repeat(np.arange(len(ids)), sizes)] = _DIGITS[at]
    out[stops - 1] = after
    text = out.tobytes().decode("ascii")
    bounds = np.concatenate([[0], stops[ends]])[np.searchsorted(owner, np.arange(n + 1))].tolist()
    return [text[x : max(x, y - 1)] for x, y in zip(bounds[:-1], bounds[1:])]


_ADDED = "row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of ``docs`` plus a row number, token, group and link numbers, the groups as text, the different pairs with
    their links, and with ``spans`` the byte offsets (in a blank and the text) where groups end."""
    added = _ADDED + ", ends array<int>" * spans
    refuse_clash(docs, [c.split()[0] for c in added.split(", ")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = Aligned(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(text)
            for x, y in slices(pc.binary_length(pc.fill_null(texts, "")).to_pylist()):
                new = known.texts(texts[x:y].to_pylist(), spans)
                yield appended(batch.slice(x, y - x), {"row": pa.array(np.arange(row, row + y - x)), **new})
                row += y - x

    return docs.mapInArrow(align, with_columns(docs, added))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", ID_BITS)))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    return written(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))


def scored(rows: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of the rows that have links."""
    # how many pairs there are by the magnitude of their count: at most 64 rows
    sizes = {r.m: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).alias("m")).agg(F.count("*").alias("pairs")).collect()}
    lowest, room = 64, broadcast_pairs
    while lowest and sizes.get(lowest - 1, 0) <= room:
        lowest -= 1
        room -= sizes.get(lowest, 0)
    frequent = F.broadcast(counts.where(F.col("n") >= float(2**lowest)))
    flat = rows.select("row", F.inline(F.arrays_zip("pairs", "links"))).withColumnRenamed("pairs", "pair")
    amounts = [(F.col("links") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best")]
    found = flat.join(frequent, "pair").select("row", *amounts)
    if lowest:
        rare = flat.join(frequent, "pair", "left_anti").join(counts.where(F.col("n") < float(2**lowest)), "pair")
        found = found.unionByName(rare.select("row", *amounts))
    return found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def alignment(spark: SparkSession, sf_dir: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The registered query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col(quoted("doc_id")).cast("long").alias("doc_id"), "text")
    rows = aligned(docs, *tokenizer_paths(), spans=False)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = written(rows.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "pairs", "links", digest.alias("groups_sha256")))
    sums = scored(rows, pair_counts(rows), broadcast_pairs)
    out = rows.drop("pairs", "links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""Harmonic packing of token sequences, each worker on its own.

A document is its ids followed by one end id. It is cut into full sequences, then into powers of two
down to ``SMALLEST``; what is left (the tail) stays whole. Each piece belongs to the class k with
``capacity / (k + 1) < length <= capacity / k``, and a bin of class k takes exactly k pieces. Powers of
two fill their bins without a gap, tails lose less than ``1 / (k + 1)`` with k >= 16.
Bins that a worker could not fill at its end are joined by first fit over their pieces, so at most a few
sequences per worker are not full. No row moves between workers.

Padding: a sequence is padded to the capacity unless its length is a power of two.

Defined cases: NULL and empty texts are the end id alone; repeated rows are packed one by one; a NULL
doc_id is kept; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import quoted, slices

CAPACITY = 2048
END_ID = 1
SMALLEST = 128
# Bytes of the words whose ids a task keeps; beyond that it starts anew, and nothing is kept after the task. Results do not
# depend on it.
KEPT_BYTES = 32 << 20
_WORD_BYTES = 170  # of a kept word besides its letters and ids

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


# A stop or comma between a letter and a blank is a word of its own to the tokenizer.
_STOP = r"([a-z])([.,][ \n])"
# Words of which each pre-token surely ends in a token with the end mark, so that many go in one call.
_PLAIN = re.compile(r"[!-~\u00c0-\u012f\u0132-\u017e]*")
_PLAIN_LINE = re.compile(r"[ -~\u00c0-\u012f\u0132-\u017e]*")


class WordIds:
    """Ids of texts, word by word, by the tokenizer itself: it drops white space and lower-cases, so no
    token reaches across a blank and each different word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # one pre-token: a contraction, letters, one digit, or neither
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.restart()

    def restart(self):
        self.places: dict[str, int] = {}
        self.ids, self.begins, self.weight = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), 0

    def keep(self, new: list[str], ids: np.ndarray, counts: np.ndarray):
        had = len(self.places)
        filled = int(self.begins[had])
        self.ids = _room(self.ids, filled + len(ids))
        self.begins = _room(self.begins, had + len(new) + 1)
        self.ids[filled : filled + len(ids)] = ids
        self.begins[had + 1 : had + len(new) + 1] = filled + np.cumsum(counts)
        self.places.update(zip(new, range(had, had + len(new))))
        self.weight += _WORD_BYTES * len(new) + sum(map(len, new)) + 4 * len(ids)

    def encode(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, their ids in a row, and how many each has."""
        order, found, counts, odd = [], [], [], []
        # words of letters alone are one pre-token each: a line of them is cut at the end marks, all its words at once
        letters = list(filter(str.isalpha, new))
        lines = [letters[i : i + 100] for i in range(0, len(letters), 100)]
        joined = [" ".join(x) for x in lines]
        for line, text, e in zip(lines, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(line) or not _PLAIN_LINE.fullmatch(text):
                odd += line
                continue
            order += line
            found.append(ids)
            counts.append(np.diff(ends, prepend=0))
        plain = []
        for w in new:
            if not w.isalpha():
                (plain if _PLAIN.fullmatch(w) and "<|" not in w else odd).append(w)
        lines = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            upto = np.cumsum([len(self.parts.findall(w)) for w in line])
            if len(ends) != upto[-1]:
                odd += line
                continue
            order += line
            found.append(ids)
            counts.append(np.diff(np.concatenate([[0], ends])[upto], prepend=0))
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            order.append(w)
            found.append(np.array(e.ids, np.uint32))
            counts.append([len(e.ids)])
        return order, np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([np.zeros(0, np.int64), *counts])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text begins (plus the total)."""
        plain = pc.replace_substring(pc.replace_substring_regex(pc.ascii_lower(texts), _STOP, r"\1 \2"), "\n", " ")
        words, sizes = [], [0]
        for t in plain.to_pylist():
            words += t.split(" ")
            sizes.append(len(words))
        if self.weight > KEPT_BYTES:
            self.restart()
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(at < 0).tolist()
        if unseen:
            new = list(dict.fromkeys(words[i] for i in unseen))
            self.keep(*self.encode(new))
            at[unseen] = [self.places[words[i]] for i in unseen]
        lengths = self.begins[at + 1] - self.begins[at]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.begins[at] - (ends - lengths), lengths)
        return self.ids[np.arange(len(shift)) + shift], np.concatenate([[0], ends])[sizes]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array with place for ``size`` entries, at least twice as long if it has to grow."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(len(array), size - len(array)), array.dtype)])


def cut(length: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of a document: full sequences, powers of two, the tail."""
    pieces = [capacity] * (length // capacity)
    rest, power = length % capacity, capacity // 2
    while power >= smallest:
        if rest >= power:
            pieces.append(power)
            rest -= power
        power //= 2
    return pieces + [rest] * (rest > 0)


class Bins:
    """Open bins of one worker by class; a bin of class k is closed with its k-th piece."""

    def __init__(self, base: int, capacity: int):
        self.base, self.capacity, self.next, self.open = base, capacity, 0, {}

    def sequence(self) -> int:
        self.next += 1
        return self.base + self.next - 1

    def add(self, piece: list) -> list[list]:
        """Takes [doc_id, start, length, crc, tokens]; returns the pieces of a bin once it is full."""
        k = self.capacity // piece[2]
        group = self.open.setdefault(k, [])
        group.append(piece)
        return self.placed(self.open.pop(k)) if len(group) == k else []

    def placed(self, group: list[list]) -> list[list]:
        number, offset = self.sequence(), 0
        for piece in group:
            piece += [number, offset]
            offset += piece[2]
        return group

    def rest(self) -> Iterator[list[list]]:
        """First fit over the pieces of bins that stayed open, longest first. A power of two alone in
        its bin needs no padding, so such bins are left as they are."""
        loose, room = [], []
        for _, group in sorted(self.open.items()):
            total = sum(p[2] for p in group)
            if total & (total - 1) == 0:
                yield self.placed(group)
            else:
                loose += group
        for piece in sorted(loose, key=lambda p: -p[2]):
            for bin_ in room:
                if bin_[0] >= piece[2]:
                    break
            else:
                room.append(bin_ := [self.capacity, []])
            bin_[0] -= piece[2]
            bin_[1].append(piece)
        for _, group in room:
            yield self.placed(group)


def harmonic(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
             end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it starts in its document, and its sequence and offset there."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, bins, out = _lookup(tokenizer), Bins(TaskContext.get().partitionId() << 40, capacity), []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=_NAMES)

        try:
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), batch.column(1)
                for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                    ids, begins = lookup.texts(pc.fill_null(texts[a:b], ""))
                    for i in range(b - a):
                        whole = np.append(ids[begins[i] : begins[i + 1]], np.uint32(end_id)).astype("<u4")
                        start = 0
                        for n in cut(len(whole), capacity):
                            crc = zlib.crc32(whole[start : start + n].tobytes())
                            out += bins.add([names[a + i], start, n, crc, len(whole)])
                            start += n
                    if len(out) > 20_000:
                        yield table()
                        out = []
        finally:
            lookup.restart()
        for group in bins.rest():
            out += group
        if out:
            yield table()

    return docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text")).mapInArrow(pack, _PIECES)


_kept: dict[str, WordIds] = {}


def _lookup(path: str) -> WordIds:
    """The tokenizer, read once in each Python worker."""
    if path not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        _kept[path] = WordIds(path)
    return _kept[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query over all documents."""
    return harmonic(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())

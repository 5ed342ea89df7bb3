"""Quality classifier by positive-unlabelled learning (non-negative risk estimator).

Trusted positives are labelled texts of good quality, everything else is unlabelled web text: negative
labels are never used. A first network tells positives from unlabelled text; the class prior is read
from its scores on rows it has not seen (the score above which the ratio of unlabelled to positive mass
is smallest, with a confidence margin). The second network minimises

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss, so that its output is the probability of good quality. Features are shares of
kinds of bytes and words over the whole text; language, source and ids are no inputs.

The fit uses at most about ``SAMPLE`` positives and as many unlabelled rows, chosen by a hash of doc_id over
the whole table; every row is scored.

Defined cases: NULL and empty texts have all-zero features and get a score like any other; NULL labels
and NULL doc_ids are not learned from; without any positive row the score is 0.5 everywhere; repeated
rows are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import held_out, sampled
from .tables import small, written
from .text import appended, prefix, prefixed, quoted, refuse_clash, sliced, span_hashes, unprefixed, with_columns, words

SAMPLE = 20_000

_KINDS = np.full(256, 9, np.int64)  # other ASCII signs
_KINDS[ord("a") : ord("z") + 1] = 0
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("0") : ord("9") + 1] = 2
_KINDS[[9, 32]] = 3
_KINDS[[10, 13]] = 4
_KINDS[[ord(c) for c in ".,"]] = 5
_KINDS[[ord(c) for c in "'\"-;:()"]] = 6
_KINDS[[ord(c) for c in "!?"]] = 7
_KINDS[[ord(c) for c in "|_=<>{}[]/\\"]] = 8
_KINDS[:9], _KINDS[11:13], _KINDS[14:32], _KINDS[127] = 10, 10, 10, 10
_KINDS[128:] = 11
N_KINDS = 12
_LETTER = (_KINDS <= 1) | (_KINDS == 11)
N_FEATURES = N_KINDS + 9


def features(texts: list[bytes]) -> np.ndarray:
    """One row of shares for each text."""
    out = np.zeros((len(texts), N_FEATURES))
    buffer, first, last, begins = words(texts)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner * N_KINDS + _KINDS[buffer[1:]], minlength=len(texts) * N_KINDS).reshape(-1, N_KINDS).astype(float)
    counts[:, 4] -= 1  # the gap after each text
    n = np.diff(begins)
    out[:, :N_KINDS] = counts / np.maximum(1, sizes - 1)[:, None]
    out[:, N_KINDS] = np.log1p(sizes - 1) / 10
    out[:, N_KINDS + 1] = counts[:, 1] / np.maximum(1, counts[:, 0] + counts[:, 1])
    if len(first):
        word_of = np.repeat(np.arange(len(texts)), n)
        hashes = span_hashes(buffer, first, last)
        letters = np.concatenate([[0], np.cumsum(_LETTER[buffer])])
        capitals = np.concatenate([[0], np.cumsum(_KINDS[buffer] == 1)])
        smalls = np.concatenate([[0], np.cumsum(_KINDS[buffer] == 0)])
        in_word = lambda upto: upto[last] - upto[first]
        same = np.zeros(len(first), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
        order = np.lexsort((hashes, word_of))
        fresh = np.ones(len(first), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
        tail = _KINDS[buffer[last - 1]]
        for k, flag in enumerate((
            same, fresh, in_word(letters) == 0, (in_word(capitals) > 1) & (in_word(smalls) == 0), tail >= 7, (tail >= 7) & (tail != 11), in_word(letters) > 15,
        )):
            weight = flag[: len(first)].astype(float)
            out[:, N_KINDS + 2 + k] = np.bincount(word_of, weight, len(texts)) / np.maximum(1, n)
    return out


class Net:
    """One hidden layer; ``logits`` of standardised features."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def hidden(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.weights[0] + self.weights[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(self.inputs(x)) @ self.weights[2] + self.weights[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(pos: np.ndarray, rest: np.ndarray, prior: float, positive_unlabelled: bool, steps: int = 1500, batch: int = 512, width: int = 24) -> Net:
    """Adam on the non-negative risk, or on the plain two-class risk of positives against the rest."""
    rng = np.random.default_rng(11)
    both = np.concatenate([pos, rest])
    net = Net(both.mean(0), both.std(0) + 1e-6, [rng.normal(0, 0.3, (pos.shape[1], width)), np.zeros(width), np.zeros(width), np.zeros(1)])
    p_in, u_in = net.inputs(pos), net.inputs(rest)
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        p, u = p_in[rng.integers(0, len(p_in), batch)], u_in[rng.integers(0, len(u_in), batch)]
        z = np.concatenate([p, u])
        h = net.hidden(z)
        g = np.clip(h @ net.weights[2] + net.weights[3], -30, 30)
        s = 1 / (1 + np.exp(-g))  # derivative of loss(-g); that of loss(g) is s - 1
        if positive_unlabelled:
            loss = np.logaddexp(0, g)
            slack = loss[batch:].mean() - prior * loss[:batch].mean()
            d_neg = np.concatenate([-prior * s[:batch], s[batch:]]) / batch
            d_pos = np.concatenate([prior * (s[:batch] - 1), np.zeros(batch)]) / batch
            d = d_pos + d_neg if slack >= 0 else -d_neg
        else:
            d = np.concatenate([s[:batch] - 1, s[batch:]]) / (2 * batch)
        back = np.outer(d, net.weights[2]) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * net.weights[0], back.sum(0), h.T @ d + 1e-4 * net.weights[2], np.array([d.sum()])]
        rate = 0.01 * (1 - step / (steps + 1))
        for w, a, b, dw in zip(net.weights, m, v, grads):
            a += 0.1 * (dw - a)
            b += 0.001 * (dw * dw - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def class_prior(pos: np.ndarray, rest: np.ndarray) -> float:
    """Share of positives in the unlabelled rows, from held-out scores of a classifier between the two."""
    cuts = np.unique(pos)
    above_p = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    above_u = 1 - np.searchsorted(np.sort(rest), cuts) / len(rest)
    margin = np.sqrt(np.log(40) / (2 * len(pos))) + np.sqrt(np.log(40) / (2 * len(rest)))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(pos: np.ndarray, rest: np.ndarray) -> Net | None:
    if len(pos) < 4 or len(rest) < 4:
        return None
    judge = train(pos[::2], rest[::2], 0.5, False)
    prior = class_prior(judge.logits(pos[1::2]), judge.logits(rest[1::2]))
    return train(pos, rest, prior, True)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in sliced(batch.column(1)):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(x.tolist(), pa.list_(pa.float64()))], names=["positive", "x"])


def learned(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Net | None:
    """The network fitted on a bounded sample of the rows that are not held out."""
    ident = F.col(quoted(doc_id))
    own = docs.where(ident.isNotNull() & ~held_out(ident, 3, 1)).select(ident.alias("doc_id"), F.col(quoted(text)).alias("text"))
    good = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id").distinct()

    chosen = sampled(good, sample, 1).withColumn("positive", F.lit(True)).unionByName(sampled(own.select("doc_id"), sample, 2).withColumn("positive", F.lit(False)))
    rows = own.join(small(written(chosen), 16), "doc_id").select("positive", "text").mapInArrow(_featured, "positive boolean, x array<double>")
    table = rows.orderBy("positive", "x").toPandas()
    parts = [np.array(table.x[table.positive == p].tolist()).reshape(-1, N_FEATURES) for p in (True, False)]
    rng = np.random.default_rng(5)
    return fit(*[p[rng.permutation(len(p))] for p in parts])


def scored(docs: DataFrame, net: Net | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score and predicted."""
    refuse_clash(docs, ["score", "predicted"])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in sliced(batch.column(text)):
                s = shared.value.scores(features(texts)) if shared.value else np.full(b - a, 0.5)
                yield appended(batch.slice(a, b - a), {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.mapInArrow(work, with_columns(docs, "score double, predicted int"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, net).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline form: the documents that are not rejected, with their own columns."""
    net = learned(docs, labels)
    return unprefixed(scored(prefixed(docs), net, prefix("text")).where("predicted = 1"), docs)

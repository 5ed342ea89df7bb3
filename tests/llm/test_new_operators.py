"""Token alignment, sharding and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import documents, empty, random_texts, table

from pairwell.llm import alignment, importance, shards

# ---------------------------------------------------------------- 11 alignment

ODD = [
    None, "", " ", "  ", "a", "a ", "a  b", "  a", " a  \n b", "foo\n\nbar  ", "é é ﬁ", "a▁b", "日本語 テキスト です", "x y  z　",
    "<s> <|endoftext|> </s>", "12 345,67", "\x00", "\x1c a\x1c b", "tab\t tab", "😀 👩‍👩‍👧 ok", "a" * 3000, "!!!!!! ??  !!", "\r\n x\r\n", "z " + "ال" * 50, "don't we'll",
]


@pytest.fixture(scope="module")
def plain():
    """Groups and links of one text by the two tokenizers themselves, going through the common ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.tokenizer_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    known = alignment.Aligned(a_path, b_path)

    def spans(tokens, ids):
        return [tokens.bytes[tokens.begins[i] : tokens.begins[i + 1]].tobytes() for i in ids]

    def align(text):
        if not text:
            return None
        raw = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = spans(known.a, ids[0]), spans(known.b, ids[1])
        if b"".join(parts[0]) != raw or b"".join(parts[1]) != raw:
            return None
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        groups, links, i, j = [], Counter(), 0, 0
        for stop in sorted(set(ends[0]) & set(ends[1])):
            x, y = [], []
            while i < len(ids[0]) and ends[0][i] <= stop:
                x.append(ids[0][i])
                i += 1
            while j < len(ids[1]) and ends[1][j] <= stop:
                y.append(ids[1][j])
                j += 1
            groups.append((x, y, stop))
            links.update((p, q) for p in x for q in y)
        return len(ids[0]), len(ids[1]), groups, links

    return align


def digest(groups):
    return hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, _ in groups).encode()).hexdigest()


@pytest.mark.parametrize("broadcast_pairs,kept", [(1_000_000, 1 << 27), (8, 2000), (0, 0)])
def test_alignment_against_plain_alignment(spark, tmp_path, monkeypatch, plain, broadcast_pairs, kept):
    texts = ODD + random_texts(60, 5) + ["Ein schöner Tag, nicht wahr?  Ja."] * 3
    table(spark, [(None if i == 7 else i % 80, t, "en", "s", 0) for i, t in enumerate(texts)]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    original = alignment.Aligned
    monkeypatch.setattr(alignment, "Aligned", lambda a, b: original(a, b, kept))
    got = alignment.alignment(spark, str(tmp_path), broadcast_pairs).collect()
    whole = [plain(t) for t in texts]
    counts = Counter(pair for w in whole if w for pair in w[3])
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    want = []
    for i, w in enumerate(whole):
        name = None if i == 7 else i % 80
        if w is None:
            want.append((name, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = w
        best = sum(n for pair, n in links.items() if counts[pair] == highest[pair[0]])
        want.append((name, n_a, n_b, len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), digest(groups)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_alignment_spans_extra_columns_and_edges(spark, plain):
    paths = alignment.tokenizer_paths()
    docs = documents(spark, ["Hello wonderful world", None, "été 12"]).withColumn("owner", F.lit("x"))
    rows = {r.doc_id: r for r in alignment.aligned(docs, *paths).collect()}
    for i in (0, 2):
        assert rows[i].ends == [stop for *_, stop in plain(rows[i].text)[2]] and rows[i].owner == "x"
    assert rows[1].ends == [] and rows[1].groups == "" and rows[1].n_a == 0
    assert alignment.aligned(empty(spark), *paths).count() == 0
    with pytest.raises(ValueError):
        alignment.aligned(docs.withColumn("Groups", F.lit(1)), *paths)


def test_pointer_jumping_against_walking():
    rng = np.random.default_rng(0)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(total - 1) < p) + 1, total) for p in rng.random(2))
        common = np.intersect1d(a, b)
        left, right = alignment.jumped(a, b)
        assert np.array_equal(left, np.searchsorted(common, a)) and np.array_equal(right, np.searchsorted(common, b))


def test_links_of_a_large_group_are_counted_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    of_a, of_b = np.zeros(400, np.int64), np.zeros(300, np.int64)
    a, b = rng.integers(0, 50, 400), rng.integers(0, 40, 300)
    want = Counter((int(x), int(y)) for x in a for y in b)
    monkeypatch.setattr(alignment, "_STEP", 64)
    keys, links = alignment.Aligned._pairs(of_a, a, of_b, b, np.zeros(1, np.int64))
    low = (1 << alignment.ID_BITS) - 1
    assert {(int(k) >> alignment.ID_BITS & low, int(k) & low): int(n) for k, n in zip(keys, links)} == want


# ---------------------------------------------------------------- 12 sharding


def test_shards_follow_the_law(spark):
    texts = [None, ""] + ["é" * 40000] + random_texts(900, 3) + ["same text"] * 300
    rows = [(None if i == 5 else i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(7, "again", "en", "s", 0)] * 4
    docs = table(spark, rows).repartition(5)
    found, folder = shards.balanced(docs, shards=8)
    got = found.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    loads, places = [0] * 8, defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    rest = sorted(loads)[:-1]  # one text is larger than a shard's share
    assert max(rest) - min(rest) <= 0.02 * sum(rest) / 7
    first, second = (shards.as_list(shards.stored(spark, folder, v)) for v in (1, 2))
    assert first == shards.first_map(shards=8) and {(r.virtual_slot, r.shard) for r in got} <= set(enumerate(second))


def test_editing_the_map():
    rng = np.random.default_rng(2)
    sizes = (rng.pareto(1.5, 4096) * 1000).astype(int).tolist()
    sizes[17] = 0
    now = shards.edited(shards.first_map(4096, 24), sizes, 24)
    loads = np.bincount(now, sizes, 24)
    assert now[17] == shards.first_map(4096, 24)[17] and loads.max() - loads.min() <= max(min(s for s in sizes if s), 0.01 * loads.mean())
    assert shards.edited(now, sizes, 24) == shards.edited(now, sizes, 24)
    grown = shards.edited(now, sizes, 25, only_into=24)
    moved = [s for s in range(4096) if grown[s] != now[s]]
    assert moved and all(grown[s] == 24 for s in moved)
    loads = np.bincount(grown, sizes, 25)
    assert 0.9 * loads.mean() <= loads[24] <= loads.mean()
    assert shards.edited([0, 0, 1], [0, 0, 0], 2) == [0, 0, 1]


def test_shards_of_nothing(spark):
    found, folder = shards.balanced(empty(spark).withColumn("slot", F.lit(1)))
    assert found.count() == 0 and shards.as_list(shards.stored(spark, folder, 2)) == shards.first_map()


# ---------------------------------------------------------------- 13 resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, runs):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def test_column_wise_crcs():
    rng = np.random.default_rng(0)
    spans = [rng.bytes(int(n)) for n in [0, 1, 1, 2, 7, 7, 7, 300, 5000] + list(rng.integers(0, 40, 200))]
    flat, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    lengths = np.array([len(s) for s in spans])
    assert importance.crcs(flat, ends - lengths, lengths).tolist() == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("runs", [1, 3])
def test_features_against_plain_code(runs):
    texts = ["", "One TWO, two-three Ünïcode ÀÉ 12", "...", "a b c d e f", "x"] + random_texts(40, 4) + ["long" * 3000 + " end"]
    at, begins, n_words = importance.features([t.encode() for t in texts], 997, runs)
    for i, t in enumerate(texts):
        n, want = plain_features(t, runs)
        assert n_words[i] == n and Counter(at[begins[i] : begins[i + 1]].tolist()) == Counter(zlib.crc32(f.encode()) % 997 for f in want)


@pytest.mark.parametrize("runs,buckets", [(1, 10_000), (2, 50)])
def test_resampling_against_plain_code(spark, runs, buckets):
    texts = [None, "", "--"] + random_texts(120, 6, longest=60) + ["w1 w2 w3 " * 10] * 5
    names = [None if i == 40 else i if i < 122 else 500 for i in range(len(texts))]
    target = ["w1 w2 w3", "w5 W6", None]
    got = importance.resampled(
        table(spark, [(i, t, "en", "s", 0) for i, t in zip(names, texts)]).repartition(4).withColumn("score", F.lit("other")),
        documents(spark, target), buckets=buckets, runs=runs).collect()
    count = lambda ts: Counter(zlib.crc32(f.encode()) % buckets for t in ts for f in plain_features(t, runs)[1])
    s, t = count(texts), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in s}
    rows = []
    for name, text in zip(names, texts):
        n, feats = plain_features(text, runs)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in feats)
        h = int(hashlib.sha256(f"2024:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        rows.append([name, n, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[: 10 * len(fit) // 100])}
    assert Counter(map(tuple, got)) == Counter((*r, ranks.get(id(r))) for r in rows)


def test_resampling_edges(spark):
    assert importance.resampled(empty(spark), empty(spark)).count() == 0
    one = importance.resampled(documents(spark, ["a b c"]), empty(spark)).first()
    assert (one.n_words, one["rank"]) == (3, None)
    with pytest.raises(ValueError):
        importance.weighted(documents(spark, ["a"]).withColumn("Weight", F.lit(1)), np.zeros(10, np.int64))

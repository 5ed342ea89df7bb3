"""Every training-data operator on small tables, against brute force where there is one."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwell.llm import decontaminate, html, language, licenses, linededup, neardup, pack, quality, text, topk, toxicity
from pairwell.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, lang="en"):
    return table(spark, [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)])


def random_texts(n, seed=0, vocabulary=40, longest=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choices(words, k=rng.randint(0, longest))) for _ in range(n)]


def empty(spark):
    return table(spark, [])


# ---------------------------------------------------------------- 1 language


ENGLISH = ["the cat and the dog were there with them this morning", "that was the other thing they wanted to have", "when they were with the others there was nothing"]
GERMAN = ["der hund und die katze waren nicht in dem haus", "das ist ein schöner tag und wir sind nicht hier", "sie haben die anderen nicht gesehen und sind gegangen"]


def test_language_prediction_and_edges(spark):
    rows = [(i, random.Random(i).choice(ENGLISH if i % 2 else GERMAN), "en" if i % 2 else "de", "s", 0) for i in range(80)]
    odd = [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "12 %% 3", "de", "s", 0), (None, "the cat", "en", "s", 0), (904, "the dog", None, "s", 0)]
    docs = table(spark, rows + odd)
    model = language.learned(docs)
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r for r in language.identified(docs, model).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and not got[901].accepted
    assert got[None].lang_pred == "en" and got[904].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identified(empty(spark), model).count() == 0


def test_language_model_in_parts_loses_no_gram(spark, monkeypatch):
    rows = [(i, t + f" wort{chr(97 + i % 26)}{chr(97 + i % 7)}", lang, "s", 1) for i, (t, lang) in enumerate([*((t, "en") for t in ENGLISH * 40), *((t, "de") for t in GERMAN * 40)])]
    docs = table(spark, [*rows, (900, None, "en", "s", 0), (901, "123", "de", "s", 3), (902, "ζωή σὺν τούτοις", None, "s", 9)])
    whole = {r.doc_id: r for r in language.identified(docs, language.learned(docs)).collect()}
    monkeypatch.setattr(language, "MODEL_GRAMS", 150)
    model = language.learned(docs)
    assert model.parts > 2
    dealt = {r.doc_id: r for r in language.identified(docs, model).collect()}
    assert dealt.keys() == whole.keys()
    for k, r in whole.items():
        assert (r.lang_pred, r.accepted, r.text, r.source) == (dealt[k].lang_pred, dealt[k].accepted, dealt[k].text, dealt[k].source)
        assert dealt[k].cross_entropy == pytest.approx(r.cross_entropy, abs=1e-9) and dealt[k].score == pytest.approx(r.score, abs=1e-6)


def test_language_calibrates_on_every_row_left_out_of_the_counts(spark):
    rng, rows, aside = random.Random(5), [], []
    for i in range(100_000):
        crc = zlib.crc32(str(i).encode())
        if crc % 3 != 1 and (crc % 15 >= 12 or i < 600):
            t, lang = " ".join(rng.choices(rng.choice((ENGLISH, GERMAN))[0].split(), k=rng.randint(1, 6))), rng.choice(("de", "en"))
            rows.append((i, t, lang, "s", 0))
            aside += [(t, lang)] if crc % 15 >= 12 else []
    assert len(aside) > 12_000
    model = language.learned(table(spark, rows))
    d = model.decide([t for t, _ in aside])
    right = np.array([lang for _, lang in aside]) == d["lang"]
    assert np.allclose(model.curve, language.logistic(d["x"], right.astype(float)), rtol=1e-9)
    assert np.allclose(model.limits, [np.quantile(d["ce"][right & (d["lang"] == x)], language.REJECT_QUANTILE) for x in model.langs], rtol=1e-12)


def test_language_quantiles_of_few_and_equal_rows(spark):
    rng = random.Random(6)
    values = {"a": [2.5], "b": [3.0, 1.0], "c": [1.0] * 7 + [4.0], "d": [rng.random() for _ in range(999)], "e": [float(rng.randint(0, 9)) for _ in range(4000)], "f": [rng.gauss(0, 1) for _ in range(30_000)]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "pred string, ce double")
    got = language._quantiles(rows, 0.999)
    assert got.keys() == values.keys() and all(got[k] == pytest.approx(np.quantile(v, 0.999), rel=1e-12) for k, v in values.items())
    assert language._quantiles(rows.limit(0), 0.999) == {}


def test_language_models_are_distributions():
    packed, _, _ = language.grams(["abab abba", "baab"])
    keys, n = np.unique(packed, return_counts=True)
    model = language.kneser_ney({"x": (keys, n)})
    letters = np.unique(packed & np.uint64(0xFFFF))
    for history in np.unique(packed >> np.uint64(16)):
        p = np.exp(model.log_probabilities((history << np.uint64(16)) | letters)).sum()
        assert 0.5 < p <= 1.0000001  # the rest is kept for characters never seen


def test_language_without_training_rows(spark):
    docs = documents(spark, ["hello there"], None)
    assert [r.lang_pred for r in language.identified(docs, language.learned(docs)).collect()] == ["und"]


# ---------------------------------------------------------------- 2 packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pack.tokenizer_path())
    rng = random.Random(3)
    texts = [None, "", "One word.", "İstanbul ΣΑΣ 12,5 don't <|endoftext|>x, y. z", *[" ".join(rng.choices(["Alpha,", "beta", "gamma.\n", "ünder", "x1y2"], k=rng.choice([5, 300, 4000]))) for _ in range(30)]]
    rows = pack.harmonic(documents(spark, texts).repartition(3), pack.tokenizer_path()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.1 * total + 3 * 2048
    assert pack.harmonic(empty(spark), pack.tokenizer_path()).count() == 0


def test_word_ids_are_those_of_each_word_alone():
    lookup = pack.WordIds(pack.tokenizer_path())
    words = ["alpha", "ünder", "x1y2", "don't", "", "ΣΑΣ", "12,5", "<|endoftext|>", "beta.", "ĳssel", "zeta", *[f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"]]
    order, ids, counts = lookup.encode(words)
    assert sorted(order) == sorted(words) and counts.sum() == len(ids)
    for w, own in zip(order, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == lookup.tokenizer.encode(w, add_special_tokens=False).ids, w


def test_only_one_slice_is_held_as_python_objects(monkeypatch):
    held = []
    made = text.byte_texts
    monkeypatch.setattr(text, "byte_texts", lambda column: held.append(len(column)) or made(column))
    column = pa.array(["a" * 40, None, "", "b" * 40, "ü" * 20, "c"])
    found = list(text.sliced(column, 50))
    assert [t for _, _, part in found for t in part] == made(column) and [(a, b) for a, b, _ in found] == [(0, 3), (3, 4), (4, 6)] and max(held) == 3


def test_cut_sums_up():
    for n in (1, 127, 128, 129, 2047, 2048, 2049, 9999):
        assert sum(pack.cut(n)) == n and all(p <= 2048 for p in pack.cut(n))


# ---------------------------------------------------------------- 3 decontamination


def brute_hits(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, named = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    named.add(str(name))
    return len(words), len(hit), sorted(named)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "Ä", "c3", "d"])
    items = [(1, " ".join(word() for _ in range(15))), (2, "a b"), (20, None), (3, " .. "), (4, "Ä ä"), (5, " ".join(["a"] * 14)), (6, " ".join(["a"] * 14))]
    texts = [None, "", "!!", items[0][1].upper() + " tail", "x " + items[0][1].replace(" ", ", ") + "; y", "a " * 40, "ß" * 50, *[" ".join(word() for _ in range(60)) for _ in range(20)]]
    marked = decontaminate.mark(documents(spark, texts), table(spark, items, "item_id long, text string")).collect()
    assert len(marked) == len(texts)
    for r in marked:
        n, hit, named = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r.items, r.n_items) == (n, hit, named, len(named))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        inside = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.text[s.start : s.end])) for s in r.spans)
        assert inside == hit
    with pytest.raises(ValueError):
        decontaminate.mark(documents(spark, ["x"]).withColumn("n_hit", F.lit(1)), table(spark, items, "item_id long, text string"))
    assert decontaminate.mark(empty(spark), table(spark, items, "item_id long, text string")).count() == 0
    clean = decontaminate.clean(documents(spark, ["a b c", None]).withColumn("items", F.lit(1)), table(spark, [], "item_id long, text string"))
    assert clean.count() == 2 and "items" in clean.columns


# ---------------------------------------------------------------- 4 line dedup


def line_sets(text):
    return [frozenset(re.split(r"[ \t\r\x0b\x0c]+", x.lower())) - {""} for x in text.split("\n")]


def brute_lines(texts, percent=80):
    lines = [(i, j, s) for i, t in enumerate(texts) if t is not None for j, s in enumerate(line_sets(t))]
    gone = set()
    for a, (i, j, s) in enumerate(lines):
        if s and any(t and 100 * len(s & t) >= percent * len(s | t) for _, _, t in lines[:a]):
            gone.add((i, j))
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in enumerate(texts)]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    base = ["\n".join(random_texts(rng.randint(1, 5), seed=s, vocabulary=30, longest=12)) for s in range(60)]
    wide = " ".join(f"v{i}" for i in range(300))
    near = wide.replace("v7 ", "x7 ").replace("v9 ", "")
    texts = [None, "", "\n\n", *base, base[3].upper(), wide, near + "\nend", wide + "\n" + wide]
    docs = documents(spark, texts).withColumn("removed_places", F.lit("own"))
    got = {r.doc_id: r.text for r in linededup.clean(docs).collect()}
    want = brute_lines(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert linededup.clean(docs).columns == docs.columns
    assert linededup.clean(empty(spark)).count() == 0
    nameless = table(spark, [(None, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1)])
    assert [r.text for r in linededup.clean(nameless).collect()] == ["a b c"] * 2


def test_sketches_tell_long_lines_apart(spark):
    docs = documents(spark, [" ".join(f"{a}{i}" for i in range(200)) for a in "xyz"]).select("doc_id", "text")
    lines = linededup._described(linededup._lines(docs), bytearray(b"\x01") * (1 << linededup.RARITY_BITS), 80)
    earlier = {"doc_id": "first", "n": "m", "b": "c", "b2": "c2"}
    pairs = lines.join(lines.select(*[F.col(a).alias(b) for a, b in earlier.items()]), F.col("doc_id") >= F.col("first"))
    assert sorted(map(tuple, pairs.where(linededup._close(80)).select("doc_id", "first").collect())) == [(0, 0), (1, 1), (2, 2)]


# ---------------------------------------------------------------- 5 top-k


@pytest.mark.parametrize("big", [1, 10**12])
def test_topk_against_brute_force(spark, big):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) * big for x in np.round(rng.normal(size=20), 2)]) for i in range(400)]
    rows += [(400, rows[7][1]), (401, rows[7][1]), (402, None), (403, [1.0, None] * 10), (404, [float("nan")] * 20), (405, [1.0]), (None, rows[3][1]), (406, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in topk.nearest(vectors, vectors.where("vec_id % 50 = 0"), 7).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows[:402]}
    for q in range(0, 401, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        if big == 1:
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
        else:
            assert len(got[q]) == 7
    assert topk.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


# ---------------------------------------------------------------- 6 licences


def test_license_inheritance(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "a/LICENSE"), (2, "plain text", "a/x/one"), (3, "long " * 50 + "\nReleased under the MIT License.", "a/x/two"),
        (4, "plain text", "a/x/y/three"), (5, "Released under the MIT License", "a/x/y/LICENSE"), (6, None, "b/four"), (7, "", None), (8, "nothing here", "ab/five"), (None, "Released under the MIT License", "c/x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scanned(docs, "path").collect()}
    assert got[1] == ("Apache-2.0", "Apache-2.0", None)
    assert got[2] == (None, "Apache-2.0", "a")
    assert got[3][:2] == ("MIT", "MIT")
    assert got[4] == (None, "MIT", "a/x/y")
    assert got[6] == (None, None, None) and got[7] == (None, None, None) and got[8] == (None, None, None) and got[None] == (None, None, None)
    assert licenses.scanned(docs.limit(0), "path").count() == 0


# ---------------------------------------------------------------- 7 near duplicates


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_classes(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sets, [find(i) for i in range(len(texts))]


def family(seed, copies, edits, words=120):
    rng = random.Random(seed)
    base = [f"f{seed}x{rng.randint(0, 500)}" for _ in range(words)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"n{rng.randint(0, 10**6)}"
        yield " ".join(own)


def test_near_duplicates_against_brute_force(spark):
    texts = [None, "", " \n ", "One", "one", "One two", "a b c", *random_texts(30, vocabulary=8, longest=8), *family(1, 30, 9), *family(2, 25, 3), *family(3, 4, 40), "ß " * 50]
    random.Random(1).shuffle(texts)
    for width, percent in ((3, 85), (5, 80)):
        sets, want = brute_classes(texts, width, percent)
        got = {r.doc_id: r for r in neardup.classes(documents(spark, texts), width, percent).collect()}
        for i in range(len(texts)):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), texts[i]
    kept = neardup.one_of_each(documents(spark, texts).withColumn("kept", F.lit(0)))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(want) if i == c]


def test_bands_follow_the_threshold():
    assert neardup.banding(85) == (32, 8)
    rng = np.random.default_rng(3)
    for percent in (50, 80, 85, 95):
        bands, rows = neardup.banding(percent)
        assert bands * rows <= neardup.BINS and (1 - (percent / 100) ** rows) ** bands < 0.0001
        found = 0
        for _ in range(300):
            common, a, b = np.split(rng.integers(0, 2**64 - 1, 4000, np.uint64), [40 * percent, 40 * percent + 20 * (100 - percent)])
            x, y = (neardup.band_keys(neardup.signature(np.sort(np.concatenate([common, own]))), bands, rows) for own in (a, b))
            found += bool((x == y).any())
        assert found == 300
    with pytest.raises(ValueError):
        neardup.banding(2)


def test_near_duplicates_edges(spark):
    repeated = table(spark, [(1, "a b c d e f g", "en", "s", 1)] * 3 + [(None, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", None, None, None)])
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.classes(repeated).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.one_of_each(repeated).count() == 2
    assert neardup.classes(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# ---------------------------------------------------------------- 8 quality


def test_quality_of_shouting(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["some", "plain", "words", "here", "again"], k=rng.randint(5, 60))) + "." for _ in range(300)]
    bad = [g.upper().replace(" ", "!! ") for g in good[:60]]
    docs = documents(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(360)] + [(None, 1), (361, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(docs, quality.learned(docs, labels)).collect()}
    right = sum(got[i].predicted == int(i < 300) for i in range(360))
    assert right >= 350 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 362
    kept = quality.accepted(docs.withColumn("score", F.lit("own")), labels)
    assert kept.columns == [*docs.columns, "score"] and 280 <= kept.count() <= 315
    nothing = quality.scored(docs, quality.learned(docs, labels.where("quality = 7")))
    assert {r.score for r in nothing.collect()} == {0.5}
    assert quality.scored(empty(spark), None).count() == 0


def test_class_prior_of_a_mixture():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(3, 1, 4000), rng.normal(-3, 1, 4000)
    assert abs(quality.class_prior(pos[:2000], np.concatenate([pos[2000:], neg[:1000]])) - 2 / 3) < 0.05


# ---------------------------------------------------------------- 9 html


def test_main_text_cases():
    page = """<!doctype html><html><head><title>T</title><script>var a="</p>";</script></head><body class="page sidebar-left"><div id="main-menu"><a href=x>Home</a></div>
    <article><header><h1>Head &amp; more</h1></header><p>One <b>bold<p>two<br>lines &lt;x&gt;<div class="share-buttons">Share</div><aside>Side</aside><ul><li>a<li>b</ul><!-- note --><pre> x  y </pre>
    <section class="comments"><article class="comment"><p>First!</p></article></section></article><div class="cookie-notice">Cookies</div><form><p>Mail</p></form><footer>F</footer></body></html>"""
    assert html.main_text(page, set()) == "Head & more\nOne bold\ntwo lines <x>\na\nb\nx y"
    assert html.main_text(None, set()) == "" and html.main_text("", set()) == ""
    assert html.main_text("<p>kept <b", set()) == "kept" and html.main_text("plain < text", set()) == "plain < text"


def test_constant_blocks_become_template(spark):
    rng = random.Random(6)
    page = lambda i: f"<body><div><p>Welcome to our site</p><div><p>{' '.join(random_texts(1, seed=i, vocabulary=500, longest=40))} tail{i}</p></div></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i), "c") for i in range(20)] + [(50, "http://h.example/x", None, "c"), (51, None, page(3), "c"), (52, "http://other.example/", page(4), None)]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extracted(pages).collect()}
    assert len(got) == 23 and all("Welcome" not in got[i].main_text and f"tail{i}" in got[i].main_text for i in range(20))
    assert got[50].main_text == "" and "Welcome" in got[51].main_text and "Welcome" in got[52].main_text and got[51].n_chars == len(got[51].main_text)
    assert html.extracted(pages.limit(0)).count() == 0


def test_tree_matching_is_optimal_on_lists():
    a, _ = html.parse("<div><p>1</p><h2>2</h2><p>3</p></div>")
    b, _ = html.parse("<div><p>1</p><p>3</p><h2>9</h2></div>")
    pairs = []
    assert html.matching(a, b, pairs) == len(pairs) == 4


# ---------------------------------------------------------------- 10 toxicity


def test_toxic_words_and_exact_neighbours(spark):
    rng = random.Random(9)
    plain = [" ".join(rng.choices([f"p{i}" for i in range(300)], k=30)) for _ in range(400)]
    texts = [t + (f" {rng.choice(['jerkface', 'jerkish', 'vileness'])} end" if i % 4 == 0 else "") for i, t in enumerate(plain)]
    docs = documents(spark, [*texts, None, "", "x vileness, jerkface!"])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (401, None)], "doc_id long, toxic int")
    index = toxicity.learned(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, index).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400)) and got[402].predicted == 1 and got[402].evidence
    assert got[400].predicted == 0 and got[401].evidence == [] and all(0 <= r.score <= 1 for r in got.values())
    dense = np.zeros((len(index.ids), len(index.vocabulary)))
    dense[index.rows, index.places] = index.weights
    for places, weights in list(index.weighted([t.encode() for t in texts[:40]])):
        if len(places):
            rows, sims = index.nearest(places, weights)
            all_sims = dense[:, places] @ weights
            assert np.allclose(sims, np.sort(all_sims)[::-1][: len(sims)])
    assert toxicity.scored(empty(spark), index).count() == 0
    one_class = toxicity.scored(docs, toxicity.learned(docs, labels.where("toxic = 0")))
    assert {r.predicted for r in one_class.collect()} == {0}


def brute_cosines(texts, queries):
    """TF-IDF cosines of queries to texts, with document frequencies over ``queries``."""
    bags = [Counter(t for w in re.findall("[a-z0-9]+", (q or "").lower()) for t in [w, *[w[:n] + "*" for n in (4, 5, 6) if len(w) > n]]) for q in queries]
    df = Counter(t for bag in bags for t in bag)
    vectors = [{t: (1 + np.log(c)) * (np.log((len(queries) + 1) / (df[t] + 1)) + 1) for t, c in bag.items()} for bag in bags]
    norm = [sum(x * x for x in v.values()) ** 0.5 for v in vectors]
    return [{i: sum(w * vectors[i].get(t, 0) for t, w in v.items()) / (norm[j] * norm[i]) for i in texts if norm[i] and norm[j]} for j, v in enumerate(vectors)]


def test_toxicity_searches_all_labelled_texts_in_parts(spark):
    texts = [None if not t else t for t in random_texts(300, seed=21, vocabulary=120)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    used = [i for i in range(0, 300, 2) if zlib.crc32(str(i).encode()) % 5]
    examples = toxicity.learned(docs, labels, part_bytes=1500)
    assert examples.parts > 3 and sorted(examples.ids.tolist()) == used
    got = {r.doc_id: r for r in toxicity.scored(docs, examples).collect()}
    assert len(got) == 300
    for j, sims in enumerate(brute_cosines(used, texts)):
        want = sorted(((i, s) for i, s in sims.items() if s > 0), key=lambda x: (-round(x[1], 9), x[0]))[: toxicity.NEAREST]
        assert [e.doc_id for e in got[j].evidence] == [i for i, _ in want]
        assert np.allclose([e.similarity for e in got[j].evidence], [s for _, s in want])


def test_copy_of_a_toxic_text_with_rare_words_is_found(spark):
    texts = [f"ordinary words of text {i % 7}" for i in range(200)]
    texts[3] = "ordinary words but snarlgrub once"
    copy = 200
    docs = documents(spark, [*texts, texts[3]])
    labels = spark.createDataFrame([(i, int(i == 3 or i % 50 == 1)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.learned(docs, labels)).collect()}
    assert got[copy].evidence[0].doc_id == 3 and abs(got[copy].evidence[0].similarity - 1) < 1e-9


def test_runs_of_windows_at_every_offset():
    rng = random.Random(12)
    items = [(k, " ".join(rng.choices("abc", k=rng.randint(1, 40)))) for k in range(12)]
    automaton = decontaminate.Automaton(items)
    for _ in range(60):
        own = items[rng.randrange(12)][1].split()
        a = rng.randint(0, len(own))
        text = " ".join([*rng.choices("abc", k=rng.randint(0, 9)), *own[a : a + rng.randint(0, 30)], *rng.choices("abcd", k=rng.randint(0, 9))])
        found = decontaminate.scan_text(text.encode(), automaton)
        assert (found["n_words"], found["n_hit"], found["items"] and sorted(map(str, found["items"]))) == (lambda n, h, i: (n, h, i))(*brute_hits(text, items))

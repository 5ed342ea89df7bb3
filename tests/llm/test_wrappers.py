"""Tree matching against brute force, and hosts with planted templates."""

import random

from pairwell.llm import html


def brute(a, b):
    """Best matching of two trees by trying every order-preserving pairing of children."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), brute(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a.children, b.children)


def tree(rng, depth):
    node = html.Node(rng.choice("ab"), None, False, False)
    node.children = [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
    return node


def test_matching_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = tree(rng, 3), tree(rng, 3)
        pairs = []
        assert html.matching(a, b, pairs) == brute(a, b) == len(pairs)
        assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs})
        assert all(x.label == y.label for x, y in pairs)


def test_deep_pages_and_long_lists():
    deep = ["<div>" * 5000 + f"<p>text {i}</p>" for i in range(4)]
    html.induce(deep)
    rows = [["".join(f"<li>{w} {i} {k}</li><p>x</p>" if k % (i + 2) else "<li>same</li>" for k in range(1500))][0] for i in range(4) for w in ["row"]]
    html.induce([f"<body><ul>{r}</ul></body>" for r in rows])
    a, _ = html.parse(f"<ul>{rows[0]}</ul>")
    assert html.matching(a, a) == 2 + len(a.children[0].children)


MENU = "".join(f"<div><div>Section {i} of our daily paper with all its many news</div></div>" for i in range(12))
NOTE = "<div><p>" + "We use small files to keep this site running and you agree to it by reading on. " * 4 + "</p></div>"


def page(i, article=None, layout=0):
    words = random.Random(i)
    text = article or "".join(f"<p>Story {i} part {k} says {' '.join(words.choices(['one', 'two', 'red', 'blue', 'sky', 'sea'], k=5))}</p>" for k in range(2))
    if layout:
        return f"<body><table><tr><td><h1>Head {i}</h1></td><td>{text}</td></tr></table><center>{NOTE}<b>Bottom line of all tables</b></center></body>"
    return f"<body><div>{MENU}</div><div><h2>Title {i}</h2>{text}</div>{NOTE}</body>"


def texts(pages):
    constants = set(html.induce(pages))
    return [html.main_text(p, constants) for p in pages]


def test_plain_boilerplate_goes_and_short_articles_stay():
    pages = [page(i) for i in range(12)]
    for i, text in enumerate(texts(pages)):
        assert "Section" not in text and "small files" not in text
        assert text.startswith(f"Title {i}\nStory {i} part 0") and f"Story {i} part 1" in text


def test_every_layout_has_its_template():
    for i, text in enumerate(texts([page(i, layout=int(i % 3 == 0)) for i in range(15)])):
        assert "Section" not in text and "small files" not in text and "Bottom line" not in text and f"Story {i} part 1" in text


def test_copies_of_an_article_do_not_become_template():
    copied = "<p>The same long story that several addresses of this host carry word for word, again and again.</p>"
    pages = [page(i, copied if i < 5 else None) for i in range(12)]
    for i, text in enumerate(texts(pages)):
        assert ("The same long story" in text) == (i < 5) and "Section" not in text


def test_extraction_samples_different_pages(spark):
    rows = [(i, "http://h.org/x", page(0)) for i in range(300)] + [(1000 + i, f"http://h.org/{i}", page(i)) for i in range(1, 12)] + [(2000, None, page(1)), (2001, "http://h.org/none", None)]
    found = {r.page_id: r.main_text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Section" not in found[i] and "Story" in found[i] for i in [0, 299, *range(1001, 1012)])
    assert "Section" in found[2000] and found[2001] == "" and len(found) == len(rows)


def test_every_page_counts_for_its_template(spark):
    # a layout that only 3 of 400 pages have is in hardly any sample of 16
    rows = [(i, f"http://h.org/{i}", page(i, layout=int(i in (17, 170, 333)))) for i in range(400)]
    found = {r.page_id: r.main_text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Section" not in t and "small files" not in t and "Bottom line" not in t and f"Story {i} part 1" in t for i, t in found.items())


def test_templates_are_those_of_all_pages_held_at_once(spark):
    copied = "<p>The same long story that several addresses of this host carry word for word, again and again.</p>"
    rows = [(i, f"http://h.org/{i}", page(i, copied if i < 5 else None, int(i % 3 == 0))) for i in range(40)]
    found = {r.page_id: r.main_text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    constants = set(html.induce([r[2] for r in rows]))
    assert found == {i: html.main_text(p, constants) for i, _, p in rows}

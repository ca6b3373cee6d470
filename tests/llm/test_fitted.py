"""Operators that learn, or whose truth lies in the tables: held-out accuracy, planted cases, brute force."""

import html
import os
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stowage.llm import decontaminate, html_text, quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "text " * 9, None), (2, "", "y")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and {r.doc_id: r.held_out for r in got}[None] is False
    assert quality.keep_good(docs, quality.fit(docs, none)).columns == docs.columns


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in parts if x)


@needs_tables
def test_html_finds_the_articles(spark):
    got = {r.page_id: r for r in html_text.main_text(table(spark, "pages")).collect()}
    pages = table(spark, "pages").collect()
    assert len(got) == len(pages)
    wrong = [p.page_id for p in pages if got[p.page_id].text != article(p.html)]
    assert not wrong
    assert all(r.n_chars == len(r.text) for r in got.values())


WEIGHTS = html_text.PRIORS


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain words &amp; more", "plain words & more"),
        ("<nav>Home</nav><p>One  two\nthree<p>Four&nbsp;five</p><footer>Foot</footer>", "One two three\nFour five"),
        ("<body><header>Top</header><article><header><h1>Title</h1></header><p>Body <b>bold</b> text</p><aside>Ad</aside><p>After the ad</p></article><div class='comments'><p>Nice post</p></div>", "Title\nBody bold text\nAfter the ad"),
        ("<p>a<script>var x='<p>no</p>';</script>b</p><!-- <p>no</p> --><form><p>Send</p></form>", "ab"),
        ("<div class=\"ad\">Buy now</div><p>Unclosed text &lt;tag&gt; <i>here", "Unclosed text <tag> here"),
        ("<ul><li>first<li>second</ul><p>x < y</p>", "first\nsecond\nx < y"),
        ("<body class='has-sidebar nav-open'><div class='page with-sidebar'><article><p>Start here</p><div class='ad-slot'>" + "buy this now " * 40 + "</div><p>End</p></article><p>Outside</p></div><section id=user_comments><article class=comment><p>First!</p></article></section></body>", "Start here\nEnd"),
        ("<main class='content'><h2>Head</h2><p>Text of it</p></main><div id='cookie-notice'>We use cookies here</div>", "Head\nText of it"),
        ("<nav>only <a href=/x>menu</a></nav>", ""),
    ],
)
def test_html_cases(page, want):
    assert html_text.extract(page, WEIGHTS) == want


LINKS = "<ul>" + "<li><a href=/x>word</a></li>" * 60 + "</ul>"
PLAIN = "<ol><li>one</li><li>two</li></ol>"
NOTICE = "<div class='ad-slot'>" + "<ul><li><a href=/x>buy</a></li></ul>" * 60 + "</div>"


@pytest.mark.parametrize("parts", [p for odd in (LINKS, PLAIN, NOTICE) for p in ([odd, "a", "b"], ["a", odd, "b"], ["a", "b", odd], [odd, odd, "a", odd])])
def test_html_keeps_the_whole_article(parts):
    weights = html_text.weights_from([f"<nav><ul><li><a href=/>Home {i}</a></li><li><a href=/>Away</a></li></ul></nav><div class=ad>Buy</div><article><h1>Title</h1><p>Some text</p></article><footer>Foot</footer>" for i in range(200)])
    assert weights["tags"]["li"] == -3.0
    shown = {LINKS: ["word"] * 60, PLAIN: ["one", "two"], NOTICE: []}
    page = "<nav><ul><li><a href=/>Home</a></li></ul></nav><p>Before</p><article>" + "".join(p if p in shown else f"<p>Text {p} of it</p>" for p in parts) + "</article><p>After it</p><footer>Foot</footer>"
    assert html_text.extract(page, weights) == "\n".join(x for p in parts for x in shown.get(p, [f"Text {p} of it"]))


def made(i, mark="article"):
    """A page whose class words say the opposite of what lists of such words would."""
    return f"<div class='social'><p>Follow us at place {i} and then some</p></div><div class='strip zz{i % 3}'>See also this page and that one</div><{mark}><div class='share widget'><h2>Shared {i}</h2><p>What it says, at some length</p></div></{mark}><div class='story'><p>Teaser number {i} of another text</p></div>"


def test_html_learns_class_words():
    """Content in classes that lists take for boilerplate, boilerplate in classes that they don't know."""
    weights = html_text.weights_from([made(i) for i in range(100)])
    want = "Shared 7\nWhat it says, at some length"
    assert html_text.extract(made(7), weights) == want
    assert html_text.extract(made(7, "div"), weights) == want  # nothing marks the article: learned words and the scan find it
    assert html_text.extract(made(7, "div"), html_text.PRIORS) != want


def test_html_scan_decides_between_regions():
    """Blocks of equal weight: the longest run that menus don't part wins, not all that are no menu."""
    weights = {"keys": {"nav": -4.0, "p": 1.0}, "any": 0.0, "tags": {}, "tag": -0.1}
    page = "<p>two words</p><nav>" + "menu " * 20 + "</nav><p>the longer run of text is here</p><p>and it goes on</p><nav>" + "menu " * 20 + "</nav><p>late words</p>"
    assert html_text.extract(page, weights) == "the longer run of text is here\nand it goes on"


@needs_tables
def test_html_without_the_mark(spark):
    """Learned on pages that mark their articles, the weights find those of pages that don't."""
    pages = table(spark, "pages").collect()
    weights = html_text.learn(table(spark, "pages"))
    plain = [(article(p.html), p.html.replace("<article>", "<div>").replace("</article>", "</div>")) for p in pages]
    assert sum(html_text.extract(h, weights) == want for want, h in plain) >= 0.99 * len(plain)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a b</p>", "y"), (None, None, "", "z")], "page_id long, url string, html string, n_chars string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.main_text(pages, WEIGHTS).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (1, "u", "a b", 3), (None, None, "", 0)], key=repr)
    assert html_text.main_text(pages.limit(0)).count() == 0 and html_text.learn(pages.limit(0)) == html_text.PRIORS
    drawing = "<article><p>a <svg><text>b</text></svg><noscript>c</noscript> <math><mi>d</mi></math></p></article>"
    assert html_text.extract(drawing, WEIGHTS) == "a bc d"


@needs_tables
def test_decontamination_finds_every_planted_passage(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t.lower()).strip()
    held = [(r.item_id, squeeze(r.text)) for r in items.collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = {(d, i) for d, t in rows.items() for i, x in held if x in squeeze(t)}
    found = decontaminate.find(docs, items).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert want <= got and len(want) > 10
    for r in found:
        if (r.doc_id, r.item_id) in want and r.edits == 0:
            assert squeeze(dict(held)[r.item_id])[8:40] in squeeze(rows[r.doc_id][r.start : r.stop])
    clean = decontaminate.drop_leaks(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(rows) - {d for d, _ in got}


def levenshtein_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination_edits(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    items = [(i, " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(14))) for i in range(12)]
    docs = [(100, None), (101, ""), (102, "nothing of the kind " * 400)]
    for i, x in items:
        y = list(x)
        for _ in range(i):
            k = rng.randrange(len(y))
            y[k] = rng.choice(("", y[k] + "q", "Z"))
        docs.append((i, "head words " + "".join(y).replace(" ", "\n  ") + " tail"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(50, None), (51, "short")], "item_id long, text string")).collect()}
    w = decontaminate.Windows.of(items)
    for d, t in docs:
        low = re.sub(r"[\x20\x09-\x0d]+", " ", (t or "").lower())
        for i, _ in items:
            close = any(levenshtein_in(w.text[x].decode(), low) <= w.edits[x] for x in range(len(w.text)) if w.item[x] == i) if len(low) < 2000 else False
            assert ((d, i) in got) == close
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_decontamination_finds_parts_at_every_offset(spark):
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n)).replace("  ", " x")
    items = [(n, fresh(n - 2) + "zz") for n in (80, 96, 150, 301)]
    head, tail = fresh(200) + " ", " " + fresh(200)
    docs = {}
    for n, x in items:
        for size in (decontaminate.QUOTE, 90, 126):
            docs.update({n * 10**6 + size * 10**3 + at: head + x[at : at + size].upper() + tail for at in range(n - size + 1)})
    rows = spark.createDataFrame([(0, head + tail), *docs.items()], "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(rows, held).collect()}
    assert got == {(d, d // 10**6) for d in docs}
    assert [r.doc_id for r in decontaminate.drop_leaks(rows, held).collect()] == [0]


def test_decontamination_matches_short_items_as_whole_words(spark):
    items = [(1, "What is 2+2?"), (2, "oak tree"), (3, "Été"), (4, "  "), (5, "東京"), (6, "oak tree")]
    docs = [(10, "what  IS\n2+2?"), (11, "an Oak\ttree, tall"), (12, "soak trees and oak treehouse"), (13, "l’Été “oak tree”"), (14, "Étés"), (15, "私は東京にいる"), (16, "cloak tree é"), (17, "")]
    rows, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): dict(docs)[r.doc_id][r.start : r.stop] for r in decontaminate.find(rows, held).collect()}
    assert got == {(10, 1): "what  IS\n2+2?", (11, 2): "Oak\ttree", (11, 6): "Oak\ttree", (13, 2): "oak tree", (13, 6): "oak tree", (13, 3): "Été", (15, 5): "東京"}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(rows, held).collect()) == [12, 14, 16, 17]


@needs_tables
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, "documents").limit(400)
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "bpe"]
    from stowage.llm import near_dedup, secret_scan
    from stowage.llm.common import written

    for name, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), f"test-{name}")
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.columns == columns and now <= kept
        if name == "quality":
            model = quality.fit(docs, table(spark, "labels"))
            assert now == {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
        elif name == "near_dedup":
            assert now == {r.doc_id for r in near_dedup.groups(docs, 5).where("kept").collect()}
        elif name == "decontamination":
            assert kept - now == {r.doc_id for r in decontaminate.find(docs, table(spark, "benchmark")).collect()}
        else:
            assert now == kept and secret_scan.scan(out).where(F.col("n_assign") + F.col("n_access") + F.col("n_hex") > 0).count() == 0
        docs, kept = out, now
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(kept) and "doc_id" in last.columns

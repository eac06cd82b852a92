"""Vocabulary audit, spelling variants, main text of pages and the classifier against brute force, on awkward rows."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliograph.llm import divergence, page_text, quality_model, variants
from foliograph.llm import kernels as K
from foliograph.llm.elements import Page

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["item", "value", "rank", "posts", "total", "kept", "term", "word", "n", "other", "key", "cut", "host", "hash", "template", "a", "b"]


def texts(rng, n):
    """Documents of few words, some of them one letter apart, with nulls, ties, repeats and a long one."""
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    words = base + [w[:2] + rng.choice("abcÿ") + w[3:] for w in base] + [w[:1] + w[2:] for w in base] + ["XYZ", "ÀÉ", "日本", "a×b", "co-op"]
    out = [None, "", " \t\n", "123 !!", "aaaaa aaaab aaaaa AAAAA aaaab aaaab aaaac aaaac aaaac"]
    out += [rng.choice([" ", ", ", "\n", "1"]).join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    return out + [" ".join(rng.choice(words) for _ in range(20_000)), "x" * 50_000, " ".join(["zzzzz"] * 15 + ["zzzzy"] * 7 + ["zzzyy"] * 3)] + out[5:9] * 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = [(i, t, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", None, "é", "z"]), 1) for i, t in enumerate(texts(rng, 150))]
    return [*made, (None, "aaaaa aaaab", "only", "one", 1), (None, None, "none", "two", None), (7, made[7][1], "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(4).cache()


def test_audit(docs, rows, spark):
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in divergence.audit(docs).collect()}
    assert got == brute.audit([(r[2], r[3], r[1]) for r in rows])
    assert any(k[0] == "only" for k in brute.audit([("only", "a", ""), ("only", "b", "")])) and divergence.audit(docs.limit(0)).count() == 0


def test_audit_in_blocks_and_parts(docs, rows, monkeypatch):
    """Vocabulary in many blocks, counts handed on early, pairs a few at a time: the same result."""
    for name, value in {"BLOCK_TERMS": 40, "PAIRS": 7, "SCAN_BYTES": 100, "FLUSH_TERMS": 5, "FLUSH_BYTES": 50}.items():
        monkeypatch.setattr(divergence, name, value)
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in divergence.audit(docs, top_terms=5).collect()}
    assert got == brute.audit([(r[2], r[3], r[1]) for r in rows], top=5)


def test_shares_are_exact():
    n, total = np.array([0, 1, 10**13 - 1, 7]), np.array([1, 3, 10**13, 9 * 10**13])
    assert divergence.share(n, total).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]


def test_variants(docs, rows):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(docs).collect()}
    want = brute.variants([(r[0], r[1]) for r in rows])
    assert got == want and want["zzzyy"][:2] == ("zzzzy", "zzzzz")
    assert variants.group_variants(docs.limit(0)).count() == 0


def test_variant_counts_in_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(variants, "FLUSH_BYTES", 40)
    monkeypatch.setattr(variants, "FLUSH_WORDS", 3)
    got = {r.word: r.n for r in variants.word_counts(docs).collect()}
    assert got == {w: v[2] for w, v in brute.variants([(r[0], r[1]) for r in rows]).items()}


def test_anagrams_are_not_near(spark):
    """Words of the same letters in another order share keys, and are told apart."""
    words = ["abcde", "abced", "edcba", "abcdef", "abdcef", "abcdd", "bbcde"]
    df = spark.createDataFrame([(i, " ".join(words)) for i in (1000, 1001, 1002, 1003)], "doc_id long, text string")
    got = {r.word: r.n_near for r in variants.group_variants(df).collect()}
    assert got == {w: v[3] for w, v in brute.variants([(r.doc_id, r.text) for r in df.collect()]).items()}


NAV = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>"


def page(body, head="<title>T</title><style>p{}</style><script>var x = '</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{NAV}{body}<footer>&copy; us</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain &amp; text", ["plain & text"]),
        (page("<article><h1>A &lt;b&gt;</h1><p>One <b>two</b>three<br>four.<p>Five<ul><li>x<li>y</ul></article>"), ["A <b>", "One twothree four.", "Five", "x", "y"]),
        (page("<main><h1>Title</h1><article><p>Text</p></article><aside>Not</aside></main>"), ["Title", "Text"]),
        (page("<article><p>Text</p><div class='share-bar'>Tweet</div><div id='adSlot3'>Buy</div><form>Mail <input></form><div hidden>no</div><p style='display: none'>no</p></article>"), ["Text"]),
        (page("<article><header><h1>T</h1></header><p>Text</p></article><section id=comments><article><p>Nice</p></article></section>"), ["T", "Text"]),
        (page("<div class='cookie-notice'>We use cookies</div><div id='sidebar'>Side</div><p>Body text without an article.</p><p><a href=x>Only a link</a></p>"), ["Body text without an article."]),
        (page("<article><table><tr><td>1<td>2<tr><td>3</table><pre>a\n b</pre>loose</article>"), ["1", "2", "3", "a b", "loose"]),
        (page("<article class='post has-comments'><p>a<!-- <p>no</p> -->b</p><textarea>no</textarea>&am&copy</article>"), ["ab", "&am©"]),
        ("<article><p>open <a href=\"x>y</p>", ["open y"]),
        ("<p>a &nbsp; b\x85c</p><p> </p>1 < 2 & 3 <4", ["a b c", "1 < 2 & 3 <4"]),
    ],
)
def test_article(html, want):
    found = Page(html)
    found.survey()
    assert found.blocks() == want


@pytest.mark.parametrize("one", ["<div class='x'>", "<p>", "<b><a ", '<a href="', "</div>", "<span><div>", "<script>", "<!--", "<li>", "<td>", "<table><tr>", "a < b &lt; "])
def test_page_time(one):
    start = time.process_time()
    found = Page(one * 30_000)
    found.survey()
    found.blocks()
    assert time.process_time() - start < 8


def test_template(spark):
    """A block that many different pages of a host share goes; paragraphs of an article and copies of a page stay."""
    box = "<div><b>Read our letters</b> every day of the week</div>"
    rows = [(i, f"http://Host.example/{i}", page(f"<article><h1>N{i}</h1><p>Words of number {i} and more of them.</p><p>Shared words.</p>{box}</article>")) for i in range(8)]
    rows += [(20 + i, f"//other.example:80/{i}", page(f"<article><h1>N{i}</h1><p>Words.</p>{box}</article>")) for i in range(2)]
    rows += [(40 + i, f"http://copies.example/{i}", page("<div><p>A page that stands under many addresses.</p></div>")) for i in range(9)]
    rows += [(60 + i, f"http://bare.example/{i}", f"<div><p>Our notice to all.</p></div><div><p>Text {i} of its own.</p></div>") for i in range(6)]
    rows += [(None, None, None), (1, None, ""), (90, "no host", "<p>x</p>"), rows[0], (91, "http://e.example", page("<article>" + "<p>long </p>" * 3000 + "</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    want = {}
    for i, u, _ in rows:
        want[i, u] = ""
        if i is not None and u and i < 8:
            want[i, u] = f"N{i}\nWords of number {i} and more of them.\nShared words."
        elif i is not None and 20 <= i < 40:
            want[i, u] = f"N{i - 20}\nWords.\nRead our letters every day of the week"
        elif i is not None and 40 <= i < 60:
            want[i, u] = "A page that stands under many addresses."
        elif i is not None and 60 <= i < 90:
            want[i, u] = f"Text {i - 60} of its own."
    want |= {(90, "no host"): "x", (91, "http://e.example"): "\n".join(["long"] * 3000)}
    for most in (page_text.BROADCAST_HASHES, -1):
        page_text_limit, page_text.BROADCAST_HASHES = page_text.BROADCAST_HASHES, most
        got = page_text.extract_text(df.repartition(3)).collect()
        page_text.BROADCAST_HASHES = page_text_limit
        assert len(got) == len(rows) and {(r.page_id, r.url): r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert page_text.extract_text(df.limit(0)).count() == 0


def test_co_training(spark):
    """Scores of all documents, one by one, against dense matrices."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        good = i % 2 == 0
        words = [rng.choice(["river", "stone", "green", "walks", "house", "light"] if rng.random() < (0.8 if good else 0.3) else ["BUY", "now!!", "click", "$$$", "win"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), "en", rng.choice(["a", "b"] if rng.random() < 0.8 else ["c"]) if good else rng.choice(["c", "d"]), None))
    rows += [(400, None, None, None, None), (401, "river " * 20_000, "en", "a", 5), (402, rows[3][1], *rows[3][2:])]
    labels = [(i, int(i % 2 == 0), 0) for i in range(0, 400, 3)]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    got = {r.doc_id: (r.score_text, r.score_meta, r.score) for r in quality_model.score_quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    content, meta = [], []
    for _, _, c, m in quality_model.features(pa.array([r[1] for r in rows], pa.string()), *([r[k] for r in rows] for k in (2, 3, 4))):
        content.append(c)
        meta.append(m)
    y = np.full(len(rows), np.nan)
    for i, q, _ in labels:
        y[i] = q
    known = np.array([i for i, *_ in labels])
    order = known[np.argsort(K.mix(known.astype(np.uint64)), kind="stable")]
    want = np.column_stack(brute.co_trained(np.vstack(content), np.vstack(meta), y, order))
    for k, r in enumerate(rows):
        assert np.allclose(got[r[0]], want[k], atol=2e-3), (r[0], got[r[0]], want[k])


def test_partial_sums_meet_in_small_groups(spark):
    """More tasks than are added up at once: the same sum."""
    rows = spark.range(200, numPartitions=100).select(F.col("id").cast("string").cast("binary").alias("content"), F.lit(b"1234").alias("meta"))
    rows = rows.select(F.unhex(F.lpad(F.hex(F.col("content")), 8, "0")).alias("content"), F.unhex(F.lit("0000803F")).alias("meta"))
    got = quality_model._summed(quality_model.Pool(rows, 100), lambda x: np.array([len(x["meta"]), x["meta"].sum()] + [0.0] * 30))
    assert got[:2].tolist() == [200, 200]

"""Each operator on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import components, decontam, langid, line_rules, mixing, neardup, quality_model, secrets, suffix_dedup, tokens, warc
from foliograph.llm.common import scratch_path

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["row_id", "size", "key", "host", "sid", "spans", "items", "token", "block", "kept", "score", "n_words", "base", "owner"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnoprst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randint(20, 300)) for _ in range(40)]
    texts = [None, "", "   \n\t ", "one", "Two words", "é ñ ü", "12345 !!! ###", "a" * 500, "ab " * 400, base[0], base[0], base[0].upper()]
    texts += base
    for b in base[:12]:  # near copies
        w = b.split()
        for _ in range(3):
            k = rng.randrange(len(w))
            texts.append(" ".join(w[:k] + ["changed"] + w[k + 1 :]))
    passage = words(rng, 70)
    texts += [words(rng, 40) + " " + passage + "\n" + words(rng, 30) for _ in range(8)]
    texts += ["line one here\nline one here\nother\n" + words(rng, 60)] * 2
    texts.append(" ".join(base) * 3)
    texts.append("password = hunter22 AKIA" + "Q" * 16 + " " + "0123456789abcdef" * 2 + " token: Ab3dEf6hIj9lMn2pQr5t é secret:abc")
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "é"]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_mix(docs, rows, none):
    got = mixing.mix_sources(docs, keep=("doc_id", "source")).collect()
    assert len(got) == len(rows)
    size = {i: len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for i, t, *_ in rows}
    by: dict = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    assert sum(r[0].target for r in by.values()) == pytest.approx(1.5 * sum(size.values()))
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1
        assert rs[0].target <= 2 * rs[0].source_size + 1e-6
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix_sources(none).count() == 0


def test_leaks(spark, docs, rows, none):
    items = [(0, " ".join(rows[12][1].split()[3:18])), (1, None), (2, ""), (3, "Two words"), (4, rows[13][1]), (4, rows[13][1]), (None, " ".join(rows[14][1].split()[:12])), (5, "é ñ ü")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks([(r[0], r[1]) for r in rows], items)
    for blocks in (1 << 20, 64):  # one block and many
        got = decontam.find_leaks(docs, bench, block_bytes=blocks).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert decontam.find_leaks(none, bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_hashes_tell_apart():
    """Strings that collide modulo a power of two under any odd base: words, lines, sequences of words."""
    import pyarrow as pa

    from foliograph.llm import kernels as K

    for n in (1024, 2048, 1 << 17, 1 << 20):
        one = "".join("ab"[i.bit_count() & 1] for i in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        data, offsets = K.utf8(pa.array([f"{one} {two} {one}"]))
        starts, ends, h, _ = K.doc_words(data, offsets, K.NOT_SPACE)
        assert h[0] == h[2] != h[1]
        w = np.where([x == "a" for x in one], np.uint64(3), np.uint64(5))
        h = K.range_hashes(np.concatenate([w, np.uint64(8) - w, w]), np.arange(3) * n, np.arange(1, 4) * n)
        assert h[0] == h[2] != h[1]
        assert line_rules.measure(*K.utf8(pa.array([f"{one}\n{two}\n{one}"])))["n_dup_lines"][0] == 1
    k = 1 << 10
    one, two = (" ".join("ab"[(i.bit_count() & 1) ^ x] for i in range(k)) for x in (0, 1))
    assert line_rules.measure(*K.utf8(pa.array([f"{one}\n{two}"])))["line"].size == 2


def test_near_duplicates(docs, rows, none):
    got = neardup.near_duplicates(docs).collect()
    want = brute.near([(r[0], r[1]) for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = neardup.keep_one_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_long_lists(spark, monkeypatch):
    """Groups larger than all block sizes, with links across components."""
    monkeypatch.setattr(neardup, "SHORT_LIST", 4)
    monkeypatch.setattr(neardup, "LIST_BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 400)
    rng = random.Random(9)
    rows = []
    for g in range(3):
        w = words(rng, 90).split()
        for _ in range(40):
            v = list(w)
            for k in rng.sample(range(90), rng.choice([1, 2, 3, 4])):
                v[k] = "x" + str(rng.randrange(10**6))
            rows.append((len(rows) * 7 % 1009, " ".join(v)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows)


def test_near_duplicates_exactly(spark):
    """Filters that compare all pairs that share anything find every pair at the threshold, in short and long lists."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(204)]
    rows = []
    for i in range(60):  # 200 shingles, of which some 28 differ: similarities on either side of 0.75
        w = list(base)
        for k in rng.sample(range(200), rng.choice([2, 4, 5, 6, 7])):
            w[k] = f"x{i}.{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, neardup.EXACT).collect()}
    assert got == brute.near(rows)
    assert neardup.keep_one_each(df, neardup.EXACT).count() == len({c for _, c in got.values()})


def test_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s t u v w"), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 7, True), (7, 7, True), (None, 7, False), (None, None, True), (3, 3, True), (None, None, True)], key=str)
    assert neardup.keep_one_each(df).count() == 4


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}


def test_language(spark, none):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("the and of to".split(), "le la des une".split())[i % 2]) + rng.choice("ab") for _ in range(30)), ("en", "fr")[i % 2]) for i in range(200)]
    rows += [(900, None, None), (901, "", None), (902, "123 !?", None), (None, "the and of", None), (903, "\U00020000", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify_languages(df).collect()}
    assert all(got[i].lang_pred == ("en", "fr")[i % 2] for i in range(200))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred in ("en", "fr") and got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify_languages(none).count() == 0
    unlabelled = langid.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_language_brute(spark, docs, rows):
    """All texts, repeats, ties and a very long one included, against plain Python."""
    rng = random.Random(12)
    more = [(1000 + i, t, lang, None, 0) for i, (t, lang) in enumerate([("the " * 40_000 + words(rng, 9), "en"), ("le la", "fr"), ("le la", "fr"), ("le la", "de"), ("der die", "de"), ("der die", None)])]
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in langid.identify_languages(spark.createDataFrame(rows + more, DOC)).collect()}
    assert got == brute.languages([r[:3] for r in rows + more])


def test_tokens(docs, rows, none, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file())
    extra = ["x<|endoftext|>y <|startoftext|>", "é ́a b c\u0085d", "it's we'll 2024", "ẛ̣" * 50]
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows}
    got = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert all(got[i].n_bytes == len((x or "").encode()) and got[i].over_limit == (want[i] > 2048) for i, x, *_ in rows)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 64)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    counter = tokens.Counter(t.to_str())
    rng = random.Random(7)
    pieces = ["'s", "'", "<|endoftext|>", "<|", "|>", "7", "42", "ab", "Q", "!?", "é", "\u0301", "=", "\u0338", "'re", "ſ", "\x7f", "\x01", "中文"]
    extra += ["".join(rng.choice(pieces) for _ in range(600)) for _ in range(20)]
    for x in extra + [r[1] for r in rows[-3:]]:
        parts = list(tokens._slices(np.frombuffer(x.encode(), np.uint8), counter.special))
        assert b"".join(parts) == x.encode() and (len(x) < 400 or max(map(len, parts)) < 200 or " " not in x)
        n = sum(counter.count([p.split()])[0] for p in parts)
        assert n == len(t.encode(x, add_special_tokens=False).ids)
    assert tokens.count_tokens(none).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(1)
    good = [(i, words(rng, 80), "en", f"s{i % 3}", 400) for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(rng, 8).split()) * 8, "en", f"s{i % 3}", 300) for i in range(150)]
    df = spark.createDataFrame(good + bad, DOC)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in (good + bad)[::2]] + [(None, 1, 0), (99999, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_model.score_quality(df, labels).collect()}
    assert sum(got[r[0]] for r in good) >= 148 and sum(got[r[0]] for r in bad) <= 2
    assert quality_model.score_quality(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert quality_model.score_quality(none, labels).count() == 0


def test_substrings(spark, docs, rows, none):
    got = {r.doc_id: tuple(r) for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert got == {x[0]: x for x in brute.substrings([(r[0], r[1]) for r in rows])}
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_substrings_slices(spark, monkeypatch):
    """Long texts in slices, periodic bytes, overlaps, repeats inside one text, a hot passage."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1024)
    rng = random.Random(2)
    p = words(rng, 80)
    texts = ["z" * 700, "xy" * 400, p + words(rng, 900) + p, *[words(rng, 20) + p[k:] for k in range(0, 60, 7)], words(rng, 2000) + p * 3, "é" * 150]
    # Periods that change: windows differ in a few bits of some words.
    texts += [" den" * 120 + f" d{x}r" * 150 + " den" * 20 for x in "eiao"] + ["x" + " den" * 110 + " der" * 160]
    rows = list(enumerate(texts))
    parts = suffix_dedup  # runs in this process: the patched size holds
    import pyarrow as pa

    table = pa.table({"doc_id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows]), "block": pa.array([0] * len(rows))})
    no = parts._shared_rows([])
    opened = parts._open_keys(4)(table, no)
    told = parts._announce(parts._first_keys(4)(table), opened)
    out = parts._remove(table, told, 4)
    got = list(zip(*(c.to_pylist() for c in out.columns), strict=True))
    assert got == brute.substrings(rows)


def test_secrets(docs, rows, none, spark):
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    for i, t, *_ in rows:
        assert [tuple(x) for x in got[i]["base"]] == brute.secrets(t)
    text = 'é Password: "abcdef1" api_key=zz; PASSWD = xyzxyz; token: secret: abcdefgh; secret=token=abcdefgh; AKIA123 AKIAAKIA' + "B" * 12 + " " + "f" * 23 + " " + "a1" * 12
    one = secrets.scan_secrets(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).first()
    assert [tuple(x) for x in one["base"]] == brute.secrets(text)
    digest = secrets.secret_digest(secrets.scan_secrets(docs)).where("doc_id = 1").first()
    assert digest.base_sha256 == hashlib.sha256(b"").hexdigest() and digest.spans == ""
    assert secrets.scan_secrets(none).count() == 0


def test_secret_owners(spark):
    live, example = "Zq7Lm2Xw9Rt4Bv6Np1Ks", "Ex4mPl3Ex5mPl6Ky7Q8w"
    rows = [(i, f"x{i} {example} y", f"s{i}") for i in range(5)] + [(9, f"a {live} b {live}", "s1"), (10, f"password={live}", None)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry_text=True).collect()}
    assert (got[0].n_live, got[0].n_example) == (0, 1) and got[0]["found"] == []
    assert [tuple(x) for x in got[9]["found"]] == [(2, 3, 22), (25, 3, 45)]
    cleaned = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry_text=True).withColumn("text", secrets.redact(F.col("text"), F.col("live")))
    text = {r.doc_id: r.text for r in cleaned.collect()}
    assert text[9] == "a [redacted] b [redacted]" and text[10] == "[redacted]" and text[0] == rows[0][1]


def test_many_spans(spark):
    """Spans of a text are found and cut out in linear time."""
    n = 100_000
    text = " ".join(f"token={i:06d}" for i in range(n))
    df = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    found = secrets.scan_secrets(df, carry_text=True).withColumn("text", secrets.redact(F.col("text"), F.col("live"), "#"))
    got = found.select("n_assign", "n_live", "text", F.col("base")[n - 1]["end"].alias("last")).first()
    assert (got.n_assign, got.n_live, got["last"]) == (n, n, len(text)) and got.text == " ".join("#" * n)


def test_rules(docs, rows, none, spark):
    got = {r.doc_id: r for r in line_rules.apply_rules(docs).collect()}
    for i, t, *_ in rows:
        assert tuple(got[i][k] for k in line_rules.MEASURES) == brute.line_measures(t), i
    body = random.Random(8)
    banner = words(body, 200)
    many = [(i, f"{banner}\n{words(body, 60)}", "h") for i in range(30)] + [(100 + i, words(body, 60), "h") for i in range(10)] + [(200, banner, None)]
    kept = {r.doc_id: r.kept for r in line_rules.apply_rules(spark.createDataFrame(many, "doc_id long, text string, source string")).collect()}
    assert not any(kept[i] for i in range(30)) and all(kept[100 + i] for i in range(10)) and kept[200]
    assert line_rules.apply_rules(none).count() == 0


def test_archives(spark):
    rows = [(5, "http://a/é?x", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u\nv", ""), (4, "w", None), (None, "n", "<p>é</p>"), (11, "big", "x" * 100_000), (2, None, "<p>é</p>"), (12, "solo", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(pages, folder, file_bytes=50)
    back = warc.read_archives(index, folder, range_bytes=64).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t in rows:
        later = first[t or ""] is not None and (i is None or i > first[t or ""])
        want.append((i, len((t or "").encode()), sha(t), "revisit" if later else "response", first[t or ""] if later else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == sorted(want, key=str)
    assert {r.html for r in back if r.page_id == 12} == {"\r\n\r\nWARC/1.1"}
    some = warc.read_archives(index, folder, selected=F.col("page_id") == 11).collect()
    assert [r.page_id for r in some] == [11]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_quality_reaches_all_unlabelled(spark):
    """A source of junk that no small sample of the unlabelled documents holds gets its weight all the same."""
    rng = random.Random(4)
    text = lambda good: words(rng, 40) if good else " ".join(w.upper() for w in words(rng, 8).split() * 5)
    ids = [r.id for r in spark.range(6600).orderBy(F.xxhash64("id"), "id").collect()]
    known, rare = set(ids[:300]), set(ids[-300:])
    good = {i: i not in rare and rng.random() < 0.5 for i in ids}
    source = {i: "rare" if i in rare else "ab"[good[i] ^ (rng.random() < 0.8)] for i in ids}
    df = spark.createDataFrame([(i, text(good[i]), "en", source[i], 300) for i in ids], DOC)
    labels = spark.createDataFrame([(i, int(good[i]), 0) for i in known], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.score_quality(df, labels).collect()}
    assert sum(got[i].score_meta for i in rare) / len(rare) < 0.25
    assert sum(got[i].kept == good[i] for i in ids) > 6500


def test_copies_of_a_leak_are_no_example(spark):
    """Exact copies over many owners stay secret, different texts of many owners make an example; the limit grows slowly."""
    leak, token, example = "2abc3ff2ca8fb1e4c565", "Zq7Lm2Xw9Rt4Bv6Np1Ks", "Ex4mPl3Ex5mPl6Ky7Q8w"
    rows = [(i, f"a password={leak} b {token}", f"s{i}") for i in range(8)] + [(100 + i, f"x{i} {example} y", f"s{i}") for i in range(8)]
    rows += [(200 + i, f"own{i} secret={'abcdef'[i % 6]}{i:07d}", "s0") for i in range(40)]
    rows += [(300 + i, f"near {i} {leak}", f"s{i}") for i in range(3)]  # with the copies: four texts, of 52
    found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry_text=True)
    text = {r.doc_id: r.text for r in found.withColumn("text", secrets.redact(F.col("text"), F.col("live"))).collect()}
    assert all(text[i] == "a [redacted] b [redacted]" for i in range(8))
    assert all(text[100 + i] == rows[8 + i][1] for i in range(8))


def test_rules_hot_host(spark):
    """A line in 30 documents goes from a host of 2,000 as from one of 40."""
    rng = random.Random(11)
    banner = words(rng, 200)
    for n in (40, 2000):
        rows = [(i, f"{banner}\n{words(rng, 60)}" if i < 30 else words(rng, 55), "h") for i in range(n)]
        got = {r.doc_id: r for r in line_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert all(got[i].removed_words == 200 and not got[i].kept for i in range(30))
        assert all(got[i].kept for i in range(30, n))


def test_substrings_kept_and_spans(docs, rows):
    """Kept bytes are the text without the spans; other columns come along."""
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs.withColumn("name", F.concat(F.lit("n"), "doc_id")), keep=("doc_id", "name", "lang")).collect()}
    assert len(got) == len(rows) and any(r.spans for r in got.values())
    for i, t, lang, *_ in rows:
        left, at = b"", 0
        data = (t or "").encode()
        for s in got[i].spans:
            left, at = left + data[at : s.start], s.end
        assert bytes(got[i].kept) == left + data[at:] and (got[i].name, got[i].lang) == (f"n{i}", lang)


def test_rules_text(spark):
    """Removed lines go from the text, with the newline that ends them; the rest stays as it is."""
    rows = [(i, f"é {i}\nShare  THIS é\n\nbody {i}\nshare this é", "h") for i in range(25)] + [(90, None, "h"), (91, "share this é\n", "other"), (92, "", "h")]
    got = {r.doc_id: r for r in line_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry_text=True).collect()}
    for i in range(25):
        assert got[i].text == f"é {i}\n\nbody {i}\n" and got[i].removed_words == 6
        assert "".join(rows[i][1][s.start : s.end] for s in got[i].removed) == "Share  THIS é\nshare this é"
    assert [got[i].text for i in (90, 91, 92)] == [None, "share this é\n", ""] and got[91].removed == []

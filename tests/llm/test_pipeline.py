"""The stages one by one, each on its own input, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from . import brute


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnoprst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    item = words(rng, 25)
    good = [words(rng, 90) for _ in range(60)]
    texts = list(good)
    texts += [" ".join(w.upper() + "!!" for w in words(rng, 8).split()) * 8 for _ in range(30)]  # junk
    texts += [g + " more" for g in good[:5]] + [good[0]]  # copies
    texts += [words(rng, 30) + " " + item + " " + words(rng, 30) for _ in range(3)]  # leaks
    texts += [words(rng, 60) + " password=Zq7Lm2Xw9Rt4Bv" + str(i) for i in range(2)]
    texts += [None, "", "short"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("row_id", F.lit("x")).withColumn("size", F.lit(1)).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not 60 <= i < 90), 0) for i in range(0, 90, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, text = docs.columns, {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert out.columns == columns
        if k == 0:
            assert not any(60 <= i < 90 for i in after) and all(i in after for i in range(60))
        elif k == 1:
            want = brute.near([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        elif k == 2:
            found = brute.leaks([(i, r.text) for i, r in before.items()], [(1, spark.read.parquet(f"{path}/benchmark.parquet").first().text)])
            assert set(after) == {i for i, (_, hit, _) in found.items() if not hit}
        elif k == 3:
            assert set(after) == set(before)
            assert all("Zq7Lm2Xw9Rt4Bv" not in (r.text or "") for r in after.values())
            assert all(r.text == text[i] for i, r in after.items() if "password" not in (text[i] or ""))
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
        else:
            total = sum(len((r.text or "").split()) for r in before.values())
            assert abs(sum(r.taken for r in after.values()) - 1.5 * total) <= 4
        docs = out
    again = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, path).collect()}
    assert again == {i: r.taken for i, r in after.items()}


def test_empty(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_short_secrets_go(spark):
    """A password of six characters is redacted, as is a longer one of few different characters."""
    rows = [(0, "password=abc123 x", "en", "a", 17), (1, "secret: hunter22", "en", None, 16), (2, "nothing here", "en", "a", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, docs, "").collect()}
    assert [got[i].text for i in range(3)] == ["[redacted] x", "[redacted]", "nothing here"]
    assert [got[i].n_chars for i in range(3)] == [12, 10, 12]


def test_awkward_rows(spark, tmp_path):
    """Every stage on null ids and texts, repeated rows, one id with two texts, a very long text, extra columns with names used inside."""
    rng = random.Random(13)
    body = words(rng, 80)
    rows = [(None, body, "en", None, None), (5, body, "en", "a", 3), (5, body, "en", "a", 3), (5, words(rng, 60), None, "a", 3), (7, None, None, None, None), (7, "", "", "", 0)]
    rows += [(8, " ".join(words(rng, 50) for _ in range(600)), "fr", "b", -1), (None, None, None, None, None), (9, body + " password=abc123xyz", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row_id", "i1", "suspect", "_k", "c0", "y", "live", "k_0", "size"):
        docs = docs.withColumn(c, F.lit("x"))
    spark.createDataFrame([(5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(rng, 30)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or out.columns == docs.columns
        counts.append(out.count())
        docs = out
    # Everything is kept without labels of both kinds; the copies of a text go; what has words is taken from.
    assert counts[0] == len(rows) and counts[1] == 6 and counts[2] == counts[3] == 6
    kept = {(r.doc_id, (r.text or "")[:20]) for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert (8, rows[6][1][:20]) in kept and (5, body[:20]) in kept and not any("abc123" in t for _, t in kept)

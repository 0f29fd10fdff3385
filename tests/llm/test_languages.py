"""Language identification against held-out labels and plain loops."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import langid
from tests.llm.test_operators import docs, none, texts  # noqa: F401  the fixtures


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # noqa: F811
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    apart = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(apart) > 150
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in apart) / len(apart) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 10


def test_languages_of_odd_texts(spark, docs, none):  # noqa: F811
    own = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, "bb"))
    got = {r.doc_id: r for r in langid.identify(own).collect()}
    for i, t in enumerate(texts()):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(own.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    again = langid.identify(own.repartition(2)).collect()
    assert {r.doc_id: r.lang_pred for r in again} == {i: r.lang_pred for i, r in got.items()}


def _model(langs, seed=0):
    rng = np.random.default_rng(seed)
    return langid.Model(langs, rng.normal(size=(1 << langid.BITS, langid.DIM)).astype(np.float32), rng.normal(size=(langid.DIM, len(langs))).astype(np.float32), rng.normal(size=len(langs)).astype(np.float32), 1.0, 0.0)


def _row(gram):
    x = int.from_bytes(gram, "little")
    x = (x + len(gram) * 0x3C6EF372) % (1 << 32)
    x = (x ^ x >> 15) * 0x2C1B3C6D % (1 << 32)
    return (x ^ x >> 13) * 0x9E3779B1 % (1 << 32) >> 32 - langid.BITS


def test_logits_by_loops(monkeypatch):
    """The mean over all n-grams of the whole text, with few languages and with more than the table has columns."""
    some = [langid.letters(t) for t in ("hello big world", "x", "éé à la carte", "z" * 300, "ab " * 900)]
    for model in (_model(["a", "b"]), _model([f"l{i}" for i in range(40)], 1)):
        for chunk in (langid._CHUNK, 64):
            monkeypatch.setattr(langid, "_CHUNK", chunk)
            got = model.logits(some)
            for b, row in zip(some, got, strict=True):
                rows = [model.table[_row(b[i : i + n])] for n in langid.ORDERS for i in range(len(b) - n + 1)]
                assert np.allclose(row, np.mean(rows, axis=0) @ model.weights + model.bias, atol=1e-3)
            assert all(np.allclose(model.logits([b])[0], w, atol=1e-5) for b, w in zip(some, got, strict=True))


def test_more_than_a_thousand_languages(spark):
    """Rare ones beyond the bound are not learnt; nothing fails."""
    rows = [(i, f"{'abcdefgh'[i % 8] * 3} {'klmno'[i % 5]} words {i % 7}", "main" if i % 3 == 0 else f"l{i}") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, most=300)
    assert len(model.langs) <= 30 and "main" in model.langs
    got = langid.predict(df, model)
    assert got.count() == 2400 and {r.lang_pred for r in got.select("lang_pred").distinct().collect()} <= set(model.langs)


def test_rejection_is_calibrated():
    """Of documents like those that calibrate, about the asked share falls below the least score; with too few none does."""
    rng = np.random.default_rng(3)
    letter = {0: b"abcd", 1: b"cdef"}

    def bags(n):
        truth = rng.integers(0, 2, n)
        return [langid.bag_of(np.frombuffer(bytes(rng.choice(list(letter[t]), rng.integers(4, 20)).tolist()), np.uint8)) for t in truth], truth

    (train, targets), (spare, truth), (fresh, true) = bags(600), bags(2000), bags(6000)
    model = langid.fit(train, targets, spare, truth, ["a", "b"], 0.05)
    z = np.stack([share @ model.table[rows] for rows, share in fresh]) @ model.weights + model.bias
    best, score = model.scores(z)
    right = score[best == true]
    assert len(right) > 4000 and 0.03 < (right < model.least).mean() < 0.07
    assert langid.fit(train, targets, spare[:10], truth[:10], ["a", "b"], 0.05).least == 0.0
    assert langid.fit(train[:5], targets[:5], [], truth[:0], ["a", "b"], 0.05).least == 0.0


def test_whole_texts_are_learnt(spark):
    """Languages that differ only at the end of long texts."""
    rnd = random.Random(1)
    rows = [(i, "common words and so on " * 300 + ("zq xk " if i % 2 else "vw jy ") * 40 + rnd.choice("ab"), "one" if i % 2 else "two") for i in range(80)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang_pred == ("one" if r.doc_id % 2 else "two") for r in got if r.held_out) / sum(r.held_out for r in got) > 0.9

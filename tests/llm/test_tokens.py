"""Tokens against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from folioscope.llm import queries, sp_tokens
from tests.llm.test_operators import docs, none, texts  # noqa: F401  the fixtures
from tests.oracle import SF


def test_tokens(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sp_tokens.MODEL)
    odd = [" ▁a", "日本語 😀 \x00 <s> </s> <unk> <0x41>", "  two  spaces ", "ÀÉ́ ﬁ", "tab\tand\r\nline", "a" * 3000]
    rows = list(enumerate(texts() + odd))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("parity", F.lit("clash"))
    got = sp_tokens.encode(df).collect()
    assert {r.doc_id: r.ids for r in got} == {i: sp.encode(t or "") for i, t in rows}
    assert all(r.round_trip and r.parity and r.n_tokens == len(r.ids) for r in got)
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest() for i, t in rows}
    back = sp_tokens.decode(sp_tokens.encode(df).select("doc_id", "ids")).collect()
    assert {r.doc_id: r.text for r in back} == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert sp_tokens.encode(none).count() == 0


def test_parity_of_every_text(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sp_tokens.MODEL)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op10_sentencepiece(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.parity is not None and r.parity == (r.ids == sp.encode(docs[r.doc_id])) for r in got)
    same = spark.createDataFrame([(i, t) for i, t in enumerate(["a text", None, "", "a text"] * 40)], "doc_id long, text string").coalesce(1)
    assert all(r.parity for r in sp_tokens.encode(same).collect())


def test_texts_that_differ_are_marked():
    import pyarrow as pa

    with open(sp_tokens.MODEL, "rb") as f:
        data = f.read()
    backend = sp_tokens._loaded(data)
    encode = backend.encode
    backend.encode = lambda normal: [x[:-1] if "odd" in t else x for t, x in zip(normal, encode(normal), strict=True)]
    try:
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": [f"{'odd' if i % 3 else 'plain'} text {i // 6}" for i in range(60)]})
        out = pa.Table.from_batches(list(sp_tokens._encode(data, ["doc_id"])([batch])))
    finally:
        del backend.encode
    assert out.column("parity").to_pylist() == [i % 3 == 0 for i in range(60)]


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def made_model(kind, byte_fallback, own=(), dummy_prefix=1, squeeze=1):
    """A model file of pieces and scores that a rule gives, as tokenizers aren't trained here."""
    rnd = random.Random(21)
    pieces = [("<unk>", 0.0, sp_tokens.UNKNOWN), ("<s>", 0.0, sp_tokens.CONTROL), ("</s>", 0.0, sp_tokens.CONTROL), *((p, 0.0, sp_tokens.USER) for p in own)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, sp_tokens.BYTE) for i in range(256)]
    found = {sp_tokens.MARK, *"abcdeé", *(sp_tokens.MARK + c for c in "abcde")}
    while len(found) < 400:
        found.add(rnd.choice(sorted(found)) + rnd.choice("abcdeé"))
    pieces += [(p, -float(i) if kind == sp_tokens.BPE else -3.0 - rnd.random() * len(found) / 40 - 2.0 * (len(p) == 1), sp_tokens.NORMAL) for i, p in enumerate(sorted(found, key=lambda p: (len(p), p))) if p not in own]
    trainer = _message((3, kind), (35, int(byte_fallback)))
    normalizer = _message((1, "identity"), (3, dummy_prefix), (4, squeeze), (5, 1))
    return _message(*((1, _message((1, p), (2, s), (3, k))) for p, s, k in pieces), (2, trainer), (3, normalizer))


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("kind", [sp_tokens.UNIGRAM, sp_tokens.BPE])
@pytest.mark.parametrize("own", [(), ("<sep>", "dead")])
def test_made_models(spark, tmp_path, kind, byte_fallback, own):
    import sentencepiece

    data = made_model(kind, byte_fallback, own)
    path = tmp_path / "m.model"
    path.write_bytes(data)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rnd = random.Random(4)
    rows = [t for t in texts() if t is None or len(t) < 3000] + ["a<sep>b dead<sep>", "  two  spaces ", "日本語 abc", "zzz a z", " ", "<0x41> <s>"]
    rows += ["".join(rnd.choice("abcdeéz ") for _ in range(rnd.randint(1, 300))) for _ in range(200)]
    got = sp_tokens.encode(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), str(path)).collect()
    assert {r.doc_id: r.ids for r in got} == {i: sp.encode(t or "") for i, t in enumerate(rows)}
    # The rebuilt tokenizer itself agrees on nearly all, so that sentencepiece's ids seldom stand in.
    assert sum(r.parity for r in got) >= 0.97 * len(rows)


def test_long_texts_are_cut_at_words():
    import sentencepiece

    with open(sp_tokens.MODEL, "rb") as f:
        data = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    backend = sp_tokens.Backend(data)
    n, rnd = sp_tokens.STRETCH, random.Random(8)
    some = ["word " * n, "a" * (n - 1) + " ", "a" * (n - 1) + "  ", "a" * n + "   b", " " * 3 * n, "a" * 3 * n, "日本 語 " * n, "▁a" * n, "x\x00 \n" * n]
    some += ["".join(rnd.choice("ab é日\n  ▁") for _ in range(rnd.randint(n, 4 * n))) for _ in range(100)]
    got = sp_tokens.encoded(backend, some)
    assert [m[0] for m in got] == [struct.pack(f"<{len(x)}i", *x) for x in map(sp.encode, some)]
    normal = list(map(backend.normalise, some))
    assert backend.encode(normal) == [e.ids for e in backend.fast.encode_batch(normal, add_special_tokens=False)]
    for t in map(backend.normalise, some):
        cut = backend.stretches(t)
        assert "".join(cut) == t and "▁" not in cut
        assert all(a[-1] != "▁" == b[0] for a, b in zip(cut, cut[1:]))
    assert max(map(len, backend.stretches(backend.normalise(some[0])))) <= n + 5


def test_models_whose_pieces_cross_words_take_whole_texts():
    def model(*more, kind=sp_tokens.BPE):
        return sp_tokens.Model([("<unk>", 0.0, sp_tokens.UNKNOWN), *((p, -1.0, k) for p, k in more)], kind)

    mark, a = (sp_tokens.MARK, sp_tokens.NORMAL), ("a", sp_tokens.NORMAL)
    assert model(mark, a, ("▁▁", sp_tokens.NORMAL), ("▁▁a", sp_tokens.NORMAL)).at_words()
    assert not model(mark, a, ("a▁", sp_tokens.NORMAL)).at_words()
    assert not model(mark, a, ("▁a▁", sp_tokens.NORMAL)).at_words()
    assert not model(a).at_words()
    assert not model(mark, a, ("<sep>", sp_tokens.USER)).at_words()
    assert not model(mark, a, kind=sp_tokens.UNIGRAM).at_words()

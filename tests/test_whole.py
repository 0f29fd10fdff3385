"""Queries hold whole inputs: what lies beyond any head of a text or part of a table counts."""

import hashlib
import math
import random
import re
from difflib import SequenceMatcher

import pytest

import folioscope.plans.text_queries  # noqa: F401
from folioscope.functions.text import WORD
from folioscope.operators import concepts
from folioscope.plans.registry import QUERIES
from tests.oracle import SF


def test_hash_embedding_takes_whole_texts(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert max(map(len, docs.values())) > 2200
    want = {}
    for doc, text in docs.items():
        v = [0] * 128
        for w in re.findall(WORD, text.lower()):
            for i, b in enumerate(hashlib.sha256(w.encode()).digest()[:16]):
                v[(11 * i + b) % 128] += b
        norm = math.sqrt(sum(x * x for x in v))
        want |= {(doc, k): math.floor(x / norm * 1e6 + 0.5) for k, x in enumerate(v) if x}
    assert {(r.doc_id, r.slot): r.v_e6 for r in QUERIES["hash_embedding"](spark, SF).collect()} == want


def embedded(text: str) -> list[float]:
    v = [0.0] * 128
    for w in re.findall(WORD, text.lower()):
        for i, b in enumerate(hashlib.sha256(w.encode()).digest()[:16]):
            v[(11 * i + b) % 128] += b
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def one_by_one(rows: list[tuple[int, str, str]]) -> dict[int, int]:
    """Each name against all concepts so far."""
    made: list[tuple[int, str, list[float]]] = []
    known: dict[str, int] = {}
    out = {}
    for seq, name, text in rows:
        if name not in known:
            best = max(((SequenceMatcher(None, name, n).ratio(), s) for s, n, _ in made), default=(0, 0), key=lambda p: p[0])
            v = embedded(name)
            near = max(((sum(map(float.__mul__, v, d)), s) for s, _, d in made), default=(0, 0), key=lambda p: p[0])
            known[name] = best[1] if best[0] >= 0.9 else near[1] if near[0] >= 0.85 else seq
            if known[name] == seq:
                made.append((seq, name, embedded(f"{name}. {text}")))
        out[seq] = known[name]
    return out


@pytest.mark.parametrize("block", [4096, 50])
def test_resolution_compares_all_names(spark, block):
    rnd = random.Random(7)
    long = "qabcdefghijklmnoprsz"
    rows = [("emf", "electromotive force induced electromotive force"), ("electromotive force", ""), (long, ""), ("x" + long[1:-1] + "y", ""), ("w", "heat energy of a body that is stored within"), ("heat energy of a body that is stored within the", "")]
    # Many words in common slots: close without a common word.
    rows += [(" ".join(f"{c}{i}" for i in range(150)), "") for c in "uv"]
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 12))) for _ in range(60)]
    for _ in range(250):
        name = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
        at = rnd.randrange(len(name))
        rows.append((rnd.choice([name, name[:at] + rnd.choice("abcde") + name[at + 1 :]]).strip(), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))))
    rows = [(i, " ".join(n.split()), t) for i, (n, t) in enumerate(rows)]
    want = one_by_one(rows)
    assert want[1] == 0 and want[3] == 2 and want[5] == 4 and want[7] == 6
    df = spark.createDataFrame(rows, "seq long, name string, description string")
    assert {r.seq: r.concept for r in concepts.resolved(df, block=block).collect()} == want


def test_language_of_whole_texts(spark, tmp_path):
    rows = [(1, "a" * 45 + " 漢"), (2, "1 " * 30 + "word"), (3, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.fits for r in QUERIES["lang_compat"](spark, str(tmp_path)).collect()} == {1: False, 2: True, 3: True}

"""Operators against brute force, on texts with nulls, empties, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import common, decontam_prefix, hnsw_dups, line_dedup, queries, shard_shuffle, simhash_vp, suffix_runs, url_filter, warc
from tests.oracle import SF, duck, spark_rows


def texts(seed: int = 3, n: int = 120) -> list[str | None]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    shared = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    out: list[str | None] = [None, "", " \n\t", "x" * 1000, "y" * 401, "y" * 400, "One", "\n\n", "\n"]
    for _ in range(n):
        out.append("\n".join(rnd.choice(shared) if rnd.random() < 0.5 else " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 50))) for _ in range(rnd.randint(0, 6))))
    base = out[40]
    out += [base] * 30 + [base + f" tail{i % 7}" for i in range(30)] + ["word " * 40000]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2.5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Size double").repartition(7).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(150)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


@pytest.mark.parametrize(("window", "hot"), [(100, 1024), (100, 3), (33, 2), (400, 4)])
def test_repeats(docs, window, hot):
    data = [(t or "").encode() for t in texts() if t is None or len(t) < 5000]
    own = docs.where("text is null or length(text) < 5000")
    seen = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    for r, b in zip(sorted(suffix_runs.remove_repeats(own, window, hot).collect(), key=lambda r: r.doc_id), data, strict=True):
        mark = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                mark[i : i + window] = b"\1" * window
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        spans = sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, r.kept) == (len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest(), kept)


def test_repeats_in_one_long_text(docs, none):
    r = suffix_runs.remove_repeats(docs.where("length(text) > 5000"), 400).first()
    assert r.n_removed == r.n_bytes == 200000 and len(r.spans) == 1
    assert suffix_runs.remove_repeats(none).count() == 0


def test_long_texts_of_equal_bytes(spark):
    rows = [(1, "ab" * 300_000), (2, "x" * 399), (3, "word " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.shares_passage) for r in suffix_runs.remove_repeats(df, words=51).collect()}
    assert got == {1: (600_000, False), 2: (0, False), 3: (0, False)}


def test_shared_passages(spark):
    """Passages of 12 words and more in texts that are else their own."""
    rnd = random.Random(15)
    words = [rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(60)]
    passages = [[rnd.choice(words) for _ in range(n)] for n in (11, 12, 13, 40, 300)]
    rows = []
    for i in range(80):
        w = [f"{rnd.choice(words)}{rnd.randint(0, 9999)}" for _ in range(rnd.choice((3, 30, 400)))]
        if i % 4 == 0:
            p, at = rnd.choice(passages), rnd.randint(0, len(w))
            w[at:at] = p[: rnd.randint(11, len(p))]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "same " * 50), (104, " ".join(passages[1])), (104, " ".join(passages[1]))]
    held = defaultdict(set)
    for k, (_, x) in enumerate(rows):
        w = (x or "").split()
        for i in range(len(w) - 11):
            held[tuple(w[i : i + 12])].add(k)
    want = sorted((i, any(k in s for s in held.values() if len(s) > 1)) for k, (i, _) in enumerate(rows))
    got = suffix_runs.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"), 12)
    assert sorted(tuple(r) for r in got.collect()) == want and 5 < sum(x for _, x in want) < 60


@pytest.mark.parametrize("size", [300, 1 << 21])
def test_words_over_parts_of_long_texts(monkeypatch, size):
    """Segments over words are the same however a text is cut."""
    rnd = random.Random(9)
    data = [" ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(n)).encode() for n in (5, 12, 400, 90)]
    want = suffix_runs._passages(data, 12).to_pylist()
    monkeypatch.setattr(suffix_runs, "CHUNK", size)
    windows = [{b[w["s"] : w["s"] + w["l"]] for w in x} for b, x in zip(data, suffix_runs._passages(data, 12).to_pylist(), strict=True)]
    for b, x, y in zip(data, want, windows, strict=True):
        every = {b" ".join(b.split()[i : i + 12]) for i in range(len(b.split()) - 11)}
        assert {v for v in every if any(v in s for s in y)} == every == {v for v in every if any(v in b[w["s"] : w["s"] + w["l"]] for w in x)}


def test_repeats_over_chunks(spark, monkeypatch):
    rnd = random.Random(5)
    a = "".join(rnd.choice("abc") for _ in range(9000))
    monkeypatch.setattr(suffix_runs, "CHUNK", 1000)
    data = a[:5000] + a[2000:2600] + a[5000:]
    rows, offs, parts = [], [], []
    for r, o, d, e in suffix_runs._pieces([data.encode(), b"", b"short"], 400):
        rows += r
        offs += o
        parts += [bytes(d[b:c]) for b, c in zip([0, *e], e, strict=False)]
    assert set(rows) == {0} and all(data.encode()[o : o + len(p)] == p for o, p in zip(offs, parts, strict=True))


def test_run_index():
    rnd = np.random.default_rng(2)
    text = np.concatenate([rnd.integers(0, 3, 200), rnd.integers(0, 3, 50)] * 2).astype(np.int16)
    text[200:230] = text[:30]
    raw = text.astype(np.uint8).tobytes()
    got = suffix_runs.RunIndex(text, 1000).statistics()
    for i in range(len(raw)):
        best = 0
        for j in range(len(raw)):
            k = 0
            while j != i and max(i, j) + k < len(raw) and raw[i + k] == raw[j + k]:
                k += 1
            best = max(best, k)
        assert got[i] == best


def test_sharding(docs, none):
    got = shard_shuffle.placement(docs, 7).collect()
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts())}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == want and len(got) == len(want)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r.doc_id, r.shard, r.slot) for r in shard_shuffle.placement(docs.repartition(3), 7).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    assert shard_shuffle.placement(none, 7).count() == 0
    small = shard_shuffle.shuffled(docs.unionByName(docs), 5, bucket_bytes=2000).cache()
    assert small.count() == 2 * len(want) and small.select("shard", "slot").distinct().count() == 2 * len(want)


def test_shards_of_one_busy_id(spark, monkeypatch):
    """20,000 rows of one id, half of them alike: no bucket is much larger than it should be."""
    inner = shard_shuffle._fisher_yates

    def checked(seed, shards):
        run = inner(seed, shards)

        def small(table):
            assert sum(table.column("size").to_pylist()) < 4 * 20_000
            return run(table)

        return small

    monkeypatch.setattr(shard_shuffle, "_fisher_yates", checked)
    monkeypatch.setattr(shard_shuffle, "ROW_OF_BUCKETS", 3)
    df = spark.range(20_000).select(F.lit(5).alias("doc_id"), F.when(F.col("id") % 2 == 0, "alike").otherwise(F.concat(F.lit("text "), "id")).alias("text")).repartition(4)
    got = shard_shuffle.shuffled(df.unionByName(df.limit(0)), 7, bucket_bytes=20_000).select("shard", "slot").collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 20_000 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_on_disk(docs, tmp_path, spark):
    shard_shuffle.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts()))


def brute_fp(text, size):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                moved = True
    return root


def test_simhash(docs, none):
    fp = {i: brute_fp(t, 4) for i, t in enumerate(texts()) if t is None or len(t) < 50000}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    root = brute_components(fp, links)
    got = simhash_vp.near_duplicates(docs.where("text is null or length(text) < 50000")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}
    assert simhash_vp.near_duplicates(none).count() == 0


def test_near_links_of_random_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    near = base[rng.integers(0, 300, 900)]
    for _ in range(3):
        near = near ^ (np.int64(1) << rng.integers(0, 63, 900))
    fp = np.unique(np.concatenate([base, near]))
    for name, value in (("LEAF_ROWS", 16), ("STORED", 40), ("ASKED", 60)):
        monkeypatch.setattr(simhash_vp, name, value)
    links = simhash_vp.near_links(spark.createDataFrame([(int(x),) for x in fp], "fp long"), 4)
    got = {r.node: r.root for r in common.components(links).collect()}
    d = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= 4
    root = brute_components(fp.tolist(), [(int(fp[i]), int(fp[j])) for i, j in zip(*np.nonzero(np.triu(d, 1)), strict=True)])
    assert {x: got.get(x, x) for x in fp.tolist()} == root


def test_near_copies(spark):
    rnd = random.Random(8)
    base = [[f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice((60, 250, 900)))] for _ in range(60)]
    rows = []
    for i, w in enumerate(base):
        edited = list(w)
        edited[len(w) // 2] = "changed"
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(edited)), (3 * i + 2, " ".join(w).upper())]
    rows += [(None, rows[0][1]), (1000, None), (1001, "")]
    got = {r.doc_id: r.component_id for r in simhash_vp.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3 * i + k: 3 * i for i in range(60) for k in (1, 2)} | {1001: 1000}


def brute_copies(rows, size=5, similarity=0.8):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(simhash_vp.shingles(t, size)))
    alike = [(a, b) for a in sets for b in sets if a < b and any((not x and not y) or len(x & y) >= similarity * len(x | y) > 0 for x in sets[a] for y in sets[b])]
    root = brute_components(list(sets), alike)
    return {i: r for i, r in root.items() if r != i}


@pytest.mark.parametrize("block", [2_000_000, 3000])
def test_near_copies_by_brute_force(spark, monkeypatch, block):
    """Edits that leave similarities on both sides of the limit, chains, and a group of many blocks."""
    monkeypatch.setattr(simhash_vp, "SET_HASHES", block)
    monkeypatch.setattr(simhash_vp, "PIVOTS", 2)
    rnd = random.Random(12)
    bases = [[f"w{rnd.randint(0, 3000)}" for _ in range(n)] for n in (30, 60, 150, 400, 400)]
    rows = []
    for k in range(260):
        w = list(bases[k % 5 if k < 100 else 4])
        for _ in range(rnd.randint(0, max(1, len(w) // 30))):
            w[rnd.randrange(len(w))] = f"e{k}"
        rows.append((1000 - k, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for k in range(20):
        rows.append((2000 + k, " ".join(chain[5 * k : 5 * k + 100])))
    rows += [rows[0], (None, rows[3][1]), (3000, None), (3001, ""), (3002, "one two"), (3003, "ONE  two"), (3004, "long text " * 30000), (3005, "long text " * 29000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1)).withColumn("h", F.lit("x"))
    got = {r.doc_id: r.component_id for r in simhash_vp.near_copies(df).collect()}
    want = brute_copies(rows)
    assert got == want and len(set(want.values())) > 4
    assert simhash_vp.near_copies(df.where("false")).count() == 0


def test_decontamination(spark, docs, none):
    t = texts()
    items = [(1, t[30]), (2, "éß abc"), (3, ""), (4, None), (5, t[31][:200]), (6, "word " * 9), (7, t[30]), (None, t[33])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rgx = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(x):
        return rgx.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))

    windows = defaultdict(set)
    for name, x in items:
        w = words(x)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])] |= {str(name)} if name is not None else set()
    want = {}
    for i, x in enumerate(t):
        if x is not None and len(x) > 50000:
            continue
        w, hit, names = words(x), set(), set()
        for g, who in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names |= who
        want[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    own = docs.where("text is null or length(text) < 50000")
    got = decontam_prefix.report(own, bench)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(len((x or "").encode()) for _, x in items) > 3 * 100  # so items are cut and dealt out in parts
    parts = decontam_prefix.contamination(own, bench, item_bytes=100)
    assert {r.doc_id: (r.n_words, sum(s.hi - s.lo for s in r.spans), len(r["items"])) for r in parts.collect()} == {i: w[:3] for i, w in want.items()}
    kept = decontam_prefix.clean(own, bench, item_bytes=100)
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]} and kept.columns == own.columns
    assert decontam_prefix.report(none, bench).count() == 0
    assert decontam_prefix.report(own, bench.where("false")).where("contaminated").count() == 0


def brute_vectors(rows, threshold=0.98):
    good = {}
    for i, (vid, e, label) in enumerate(rows):
        if vid is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            good[i] = np.array(e, float) / np.linalg.norm(np.array(e, float))
    links = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    n = Counter(x for p in links for x in p)
    root = brute_components([r[0] for r in rows if r[0] is not None], [(rows[a][0], rows[b][0]) for a, b in links])
    return {r[0]: (n[i], root[r[0]], root[r[0]] == r[0]) for i, r in enumerate(rows) if r[0] is not None}


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_vectors(spark, shard_rows):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * 0.05).tolist() for _ in range(rng.integers(1, 20))]
    rows += [rows[3]] * 50 + [[2 * x for x in rows[3]], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, None, [], [1.0, 2.0], [float("inf")] * 16]
    rows = [(i, e, None if i % 37 == 5 else i % 2) for i, e in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1))
    got = {r.vec_id: tuple(r)[1:] for r in hnsw_dups.near_duplicates(df, shard_rows=shard_rows).collect()}
    assert got == brute_vectors(rows)
    assert hnsw_dups.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 47, 48, 49, 300, 767, 769, 2500])
def test_graph_finds_links_at_every_size(n, monkeypatch):
    """Groups of near vectors of all sizes, one larger than a beam; the graph is searched, not all products."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(max(1, n // 12), 32))
    of = np.where(rng.random(n) < 0.1, 0, rng.integers(0, len(centres), n))
    x = hnsw_dups._unit(centres[of] + rng.normal(size=(n, 32)) * rng.choice([0.02, 0.06, 0.3], (n, 1)))
    graph = hnsw_dups.Graph(x)
    again = hnsw_dups.Graph(x, graph.pack())
    used, beam = [], hnsw_dups.Graph.beam
    monkeypatch.setattr(hnsw_dups.Graph, "beam", lambda self, layer, *a: used.append(layer) or beam(self, layer, *a))
    q, node = again.near(x.astype(np.float32), 0.98)
    got = set(zip(q.tolist(), node.tolist(), strict=True))
    got |= {(b, a) for a, b in got}  # a link counts from whichever side it is found
    sims = (x @ x.T).astype(np.float32)
    sure = set(zip(*(a.tolist() for a in np.nonzero(sims >= 0.9801)), strict=True))
    maybe = set(zip(*(a.tolist() for a in np.nonzero(sims >= 0.9799)), strict=True))
    assert used.count(0) > 0 and got <= maybe and len(sure - got) <= 0.001 * len(sure)


def test_a_label_without_good_vectors(spark):
    rows = [(i, None if i % 2 else [0.0, 0.0], 1) for i in range(500)]
    got = hnsw_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, i, True) for i in range(500)]


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = hnsw_dups._unit(rng.normal(size=(3000, 24)))
    graph = hnsw_dups.Graph(x)
    q = x[::20].astype(np.float32)
    ids, _ = graph.beam(0, q, graph.descend(q, 0), 64)
    truth = np.argsort(-(q @ graph.x.T), axis=1)[:, :10]
    assert (truth[:, :, None] == ids[:, None, :]).any(axis=2).mean() >= 0.9


def test_urls(spark):
    hosts = ["example.org", "a.example.org", "xexample.org", "EXAMPLE.org", "org", "b.com", "x.net", "example.org:80", "", "a..org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/x", "?q=/es/", "/es/#a", "/fr"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None), (901, "example.org/es/"), (902, "ftp://example.org/en/1"), (902, "ftp://example.org/en/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")

    def judge(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, "allow"))

    assert sorted(map(repr, (tuple(r) for r in url_filter.filtered(df, rules).collect()))) == sorted(repr((i, *judge(u))) for i, u in rows)
    assert {r.verdict for r in url_filter.filtered(df, rules.where("false")).collect()} == {"allow"}
    assert url_filter.filtered(df.where("false"), rules).count() == 0


def test_one_busy_url(spark):
    """A third of the rows has one URL, a third none: no task joins more than its share."""
    n = 60_000
    url = F.when(F.col("id") % 3 == 0, "http://example.org/es/x").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".com/fr/")))
    df = spark.range(n).select(F.col("id").alias("page_id"), url.alias("url"))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {(r.rule, r.verdict): r["n"] for r in url_filter.filtered(df, rules).groupBy("rule", "verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {("example.org/es/", "block"): n // 3, (None, "allow"): n // 3, ("com/fr/", "allow"): n // 3}
    plan = url_filter.judge(df, rules)
    assert plan.where("host = ''").count() == 0 and plan.count() == n // 3 + 1


def test_bloom_lets_all_listed_through(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    words = url_filter.bloom(keys, 200)
    h = np.array([r.h for r in keys.collect()])
    word, bits = url_filter._places(h, 200)
    assert ((words[word] & bits) == bits).all()
    word, bits = url_filter._places(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20000), 200)
    assert ((words[word] & bits) == bits).all(axis=1).mean() < 0.02


def test_warc(spark, tmp_path):
    big = "<p>é" * 400
    rows = [(1, "http://a", big), (2, "http://b\r\n", big), (3, "u", big), (4, None, "x" * 10), (5, "u", "x" * 10), (6, "u", None), (7, "u", ""), (3, "u", big), (8, "u", "z" * 999_999), (None, "n", big), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(df, archive_bytes=3000).cache()
    members = warc.normalise(archives).cache()
    got = warc.read_records(members).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b == big.encode() and i != 3
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert all(bytes(r.payload) == (b"" if r.record_type == "revisit" else dict((i, (h or "").encode()) for i, _, h in rows)[r.page_id]) for r in got)
    for a, m in zip(sorted(archives.collect(), key=lambda r: r.archive), sorted(members.collect(), key=lambda r: r.archive), strict=True):
        assert b"".join(warc.inflate(bytes(a.data))) == b"".join(warc.inflate(bytes(m.data)))
    with pytest.raises(ValueError):
        list(warc.inflate(bytes(a.data)[:-20]))
    warc.unpack_to(members, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == members.count()
    assert warc.read_records(warc.normalise(warc.write_archives(df.where("false")))).count() == 0


def test_archives_of_many_small_pages(spark):
    """Null pages, and one large payload again and again, fill several archives."""
    big = "<p>" * 400
    df = spark.range(3000).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    df = df.unionByName(spark.range(600).select(F.lit(7).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit(big).alias("html"))).unionByName(spark.range(300).select(F.col("id").alias("page_id"), F.lit("v").alias("url"), F.lit(big).alias("html")))
    archives = warc.write_archives(df.repartition(5), archive_bytes=100_000).cache()
    whole = [len(b"".join(warc.inflate(bytes(r.data)))) for r in archives.collect()]
    assert len(whole) >= 15 and max(whole) < 350_000
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(warc.normalise(archives)).collect())
    assert got.pop((None, "response", None, 0)) == 3000
    assert got == {(i, "revisit", 299, 1200): 601 if i == 7 else 1 for i in range(299)} | {(299, "response", None, 1200): 1}


def brute_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    order = {i: (i is None, i or 0) for i, _ in rows}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)], key=order.get) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines(spark, docs, none):
    rnd = random.Random(2)
    hot = " Hot line that all Have\x0b"
    rows = [(i, t) for i, t in enumerate(texts())] + [(500 + i, "\n".join([hot] * rnd.randint(1, 3) + [f"own line number {rnd.randint(0, 30)}", "short"])) for i in range(200)]
    rows += [(None, hot + "\nonly here with null id"), (None, hot), (600, hot + "\nsecond row of one document"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(0)).withColumn("N_lines", F.lit(0))
    got = line_dedup.deduplicated(df.repartition(5)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(rows)
    assert line_dedup.deduplicated(none).count() == 0


def test_bitmaps_are_not_broadcast(spark):
    """However small the table: what is sent to all tasks must not grow with the documents."""
    df = spark.createDataFrame([(i, f"a line that two hold\nown line {i}") for i in range(4)], "doc_id long, text string")
    for out in (line_dedup.deduplicated(df), line_dedup.without_repeats(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lines_write_one_table(spark):
    """Each file that a task writes starts programs, in which an executor's memory counts twice: only what was streamed is a table."""
    df = spark.createDataFrame([(i, f"a line that two hold\nown line {i}") for i in range(4)], "doc_id long, text string")
    for make in (line_dedup.deduplicated, line_dedup.without_repeats):
        before = common.cuts_so_far(spark)
        out = make(df)
        assert len(common.cuts_so_far(spark) - before) == 1
        assert sorted(r.text for r in out.collect()) == ["a line that two hold\nown line 0", "own line 1", "own line 2", "own line 3"]


def test_cut_writes_no_side_files(spark):
    path = common.cut(spark.range(100).repartition(4))._folioscope_path.removeprefix("file://")
    names = os.listdir(path)
    assert len([x for x in names if x.startswith("part-")]) == 4 and not [x for x in names if x.endswith(".crc")]


def test_long_bitmaps(spark):
    """Lost lines at both ends of words, in all of a word, and alone in a far one; a hash that runs over many partitions, with the least and greatest ids."""
    rnd = random.Random(5)
    shared = [f"shared line number {i}" for i in range(64)]
    own = lambda i, n: [f"line {k} of document {i} alone" for k in range(n)]
    least, most = -(1 << 63), (1 << 63) - 2
    rows = [(least, "\n".join(shared)), (2, "\n".join(own(2, 63) + shared[:2] + own(2, 62)[::-1] + shared[2:3])), (3, "\n".join(own(3, 64) + shared)), (4, "\n".join(own(4, 5000) + shared[5:6]))]
    rows += [(most - i, "\n".join(rnd.choices(shared, k=3))) for i in range(300)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == brute_lines(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck(queries.oracle_sql()[name])


def test_dense_groups_widen_no_beam(monkeypatch):
    """200 near copies among 2000 others: more links than a beam has places, all found without a wider one."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 12))
    x = hnsw_dups._unit(np.concatenate([rng.normal(size=(2000, 12)), base + rng.normal(size=(200, 12)) * 0.01])).astype(np.float32)
    graph, widths, beam = hnsw_dups.Graph(x), [], hnsw_dups.Graph.beam
    monkeypatch.setattr(hnsw_dups.Graph, "beam", lambda self, layer, q, e, width: widths.append(width) or beam(self, layer, q, e, width))
    monkeypatch.setattr(hnsw_dups, "RECALL", 0.5)
    q, node = graph.near(x, 0.98)
    got = {(i, j) for i, j in zip(q.tolist(), node.tolist(), strict=True) if i != j}
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert got == {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j}
    assert max(widths) == hnsw_dups.BEAM


def test_spread_vectors_widen_no_beam(monkeypatch):
    """4000 vectors spread to all sides, some with near copies: the narrowest beam finds its 0.99 of the nearest, and all links."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x[3000:] = x[rng.integers(0, 2500, 1000)] + rng.normal(size=(1000, 64)) * rng.choice([0.05, 0.13, 0.3], (1000, 1))
    x = hnsw_dups._unit(x).astype(np.float32)
    graph, widths, beam = hnsw_dups.Graph(x), [], hnsw_dups.Graph.beam
    monkeypatch.setattr(hnsw_dups.Graph, "beam", lambda self, layer, q, e, width: widths.append(width) or beam(self, layer, q, e, width))
    q, node = graph.near(x, 0.98)
    a, b = np.nonzero(x @ x.T >= 0.9801)
    got = set(zip(q.tolist(), node.tolist(), strict=True))
    assert {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)} <= got | {(j, i) for i, j in got}
    assert max(widths) == hnsw_dups.BEAM and hnsw_dups.RECALL >= 0.99


def test_near_copies_go_through_trees(monkeypatch):
    """Candidates of a block come from vantage-point trees, and are those of comparing all pairs."""
    rng = np.random.default_rng(6)
    fp, n = rng.integers(0, 1 << 63, (600, simhash_vp.WORDS), dtype=np.uint64), rng.integers(90, 130, 600)
    fp[300:] = fp[:300] ^ (np.uint64(1) << rng.integers(0, 63, (300, 1), dtype=np.uint64))
    calls, search = [], simhash_vp.search
    monkeypatch.setattr(simhash_vp, "search", lambda *a: calls.append(a[2]) or search(*a))
    monkeypatch.setattr(simhash_vp, "TREE_ROWS", 128)
    rows = pd.DataFrame({"first": np.tile(np.arange(600), 2), "fp": [x.tobytes() for x in fp] * 2, "n": np.tile(n, 2), "kind": np.repeat([0, 1], 600)})
    got = simhash_vp._compare_wide(0.8)((), rows)
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= simhash_vp.wide_radius(0.8)
    near &= (np.minimum(n[:, None], n) >= 0.8 * np.maximum(n[:, None], n)) & (np.arange(600)[:, None] < np.arange(600))
    want = brute_components(list(range(600)), list(zip(*(x.tolist() for x in np.nonzero(near)), strict=True)))
    assert dict(zip(got["b"].tolist(), got["a"].tolist(), strict=True)) == {i: r for i, r in want.items() if i != r}
    assert calls and set(calls) == {simhash_vp.wide_radius(0.8, 1, 5.5)}

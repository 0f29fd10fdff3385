"""Benchmark decontamination by a prefix-filtered join of word shingles.

Items are cut into windows of `window` consecutive words (a shorter item is one window). A window that occurs
in a document has all its shingles there, so joining one of them, its prefix, is enough: the one that is rarest
over all documents. Each hit on a prefix shingle fixes where the window would start; bounds on that place and
on the document's length come first, then every word of the window is compared.

The windows go to the executors as arrays of word numbers while the benchmark's texts take at most `item_bytes`
(some 10 bytes of memory for each byte of text, 70 on the driver while they are built); a larger benchmark is
worked off in parts of about that size, each over all documents, and the spans are merged. An item of more than an
eighth of it is cut into stretches that overlap by a window less one word, so that no part is much larger.

Defined results: a null or empty text has no words; an item without words has no windows; an item without an
item_id marks words but is not listed; equal items all count; rows with equal doc_id stay rows of their own;
an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, pieces

SHINGLE = 5
ITEM_BYTES = 8_000_000
#: Pairs of a hit and a window that are compared at once.
_PAIRS = 1 << 18
#: Bytes of word characters, A-Z in lower case; all others become spaces.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Items:
    """Different windows of a part of the benchmark, as places in one array of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, shingle: int):
        self.window, self.vocabulary, self.names = window, {}, []
        none = np.zeros(0, np.int32)
        flat, begin, size, owner, at = [none], [none], [none], [none], 0
        for name, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words(text)]
            if w:
                n = min(window, len(w))
                many = len(w) - n + 1
                flat.append(np.array(w, np.int32))
                begin.append(np.arange(at, at + many, dtype=np.int32))
                size.append(np.full(many, n, np.int32))
                owner.append(np.full(many, len(self.names), np.int32))
                self.names.append(name)
                at += len(w)
        flat.append(np.zeros(window, np.int32))
        self.flat, begin, size, owner = (np.concatenate(x) for x in (flat, begin, size, owner))
        place = np.arange(window, dtype=np.int32)
        table = np.where(place < size[:, None], self.flat[begin[:, None] + place], -1)
        order = np.lexsort(table.T) if len(table) else none
        fresh = np.ones(len(order), bool)
        fresh[1:] = (table[order[1:]] != table[order[:-1]]).any(axis=1)
        first = order[fresh]
        self.begin, self.size = begin[first], size[first]
        #: Items of window u: owner[owner_at[u] : owner_at[u + 1]].
        self.owner, self.owner_at = owner[order], np.append(np.flatnonzero(fresh), len(order)).astype(np.int32)
        self.mix = np.random.default_rng(11).integers(1, 1 << 62, (shingle, len(self.vocabulary) + 1), dtype=np.int64)
        #: For each length of shingle: the number of its first key, and its sorted keys.
        self.keys: dict[int, tuple[int, np.ndarray]] = {}
        self.count = 0
        for k, rows in self._lengths(shingle):
            keys, valid = self._keys(rows, k)
            known = np.unique(keys[valid])
            self.keys[k] = (self.count, known)
            self.count += len(known)

    def _lengths(self, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
        k_of = np.minimum(self.size, shingle)
        return ((int(k), np.flatnonzero(k_of == k)) for k in np.unique(k_of))

    def _keys(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all shingles of some windows, and which of them lie within their window."""
        m = self.window - k + 1
        at = self.begin[rows, None] + np.arange(m, dtype=np.int32)
        keys = np.zeros(at.shape, np.int64)
        for i in range(k):
            keys += self.mix[i, self.flat[np.minimum(at + i, len(self.flat) - 1)]]
        return keys, np.arange(m) <= self.size[rows, None] - k

    def number(self, text: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(x, -1) for x in text), np.int64, len(text))

    def hits(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids of known shingles of k words, and their numbers. Keys may collide; words are compared later."""
        m = len(ids) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        ok = known[:m].copy()
        for i in range(1, k):
            ok &= known[i : i + m]
        at = np.flatnonzero(ok)
        key = self.mix[0, ids[at]].copy()
        for i in range(1, k):
            key += self.mix[i, ids[at + i]]
        base, keys = self.keys[k]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = keys[place] == key
        return at[same], base + place[same]

    def order(self, counts: np.ndarray) -> None:
        """Take as each window's prefix its rarest shingle; of equally rare ones the first."""
        prefix, self.offset = np.zeros(len(self.begin), np.int64), np.zeros(len(self.begin), np.int32)
        for k, rows in self._lengths(len(self.mix)):
            keys, valid = self._keys(rows, k)
            base, known = self.keys[k]
            number = base + np.minimum(np.searchsorted(known, keys), len(known) - 1)
            best = np.where(valid, counts[number], np.iinfo(np.int64).max).argmin(axis=1)
            self.offset[rows], prefix[rows] = best, number[np.arange(len(rows)), best]
        #: Windows of prefix p: by_prefix[starts[p] : starts[p + 1]].
        self.by_prefix = np.argsort(prefix, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(prefix[self.by_prefix], np.arange(self.count + 1)).astype(np.int32)

    def spans(self, text: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Disjoint ranges [lo, hi) of the words that windows cover, and the names of those windows' items."""
        ids = self.number(text)
        ranges, windows = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int32)]
        for k in self.keys:
            at, number = self.hits(ids, k)
            many = (self.starts[number + 1] - self.starts[number]).astype(np.int64)
            at, number, many = at[many > 0], number[many > 0], many[many > 0]
            ends = np.cumsum(many)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
                pair = np.arange(lo, min(lo + _PAIRS, int(ends[-1])))
                hit = np.searchsorted(ends, pair, side="right")
                u = self.by_prefix[self.starts[number[hit]] + pair - (ends - many)[hit]]
                begin = at[hit] - self.offset[u]
                ok = (begin >= 0) & (begin + self.size[u] <= len(ids))
                u, begin = u[ok], begin[ok]
                for i in range(self.window):
                    ok = i >= self.size[u]
                    ok[~ok] = ids[begin[~ok] + i] == self.flat[self.begin[u[~ok]] + i]
                    u, begin = u[ok], begin[ok]
                ranges.append(np.unique(np.stack([begin, begin + self.size[u]], axis=1), axis=0))
                windows.append(np.unique(u))
        every = np.unique(np.concatenate(ranges), axis=0)
        top = np.maximum.accumulate(every[:, 1]) if len(every) else every[:, 1]
        fresh = np.flatnonzero(np.append(True, every[1:, 0] > top[:-1])) if len(every) else np.zeros(0, np.int64)
        merged = np.stack([every[fresh, 0], top[np.append(fresh[1:], len(every)) - 1]], axis=1) if len(every) else every
        names = {self.names[i] for u in np.unique(np.concatenate(windows)) for i in self.owner[self.owner_at[u] : self.owner_at[u + 1]]}
        return merged, sorted(names - {None})


def _counts(shared):
    def run(batches):
        part = shared.value
        total = np.zeros(part.count, np.int64)
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                ids = part.number(words(text))
                for k in part.keys:
                    total[np.unique(part.hits(ids, k)[1])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["shingle", "n"])

    return run


_SPANS = "dk long, doc_id long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"


def _spans(shared):
    def run(batches):
        for batch in pieces(batches):
            n, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                w = words(text)
                found, names = shared.value.spans(w)
                n.append(len(w))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in found.tolist()])
                items.append(names)
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["dk", "doc_id", "n_words", "spans", "items"])

    return run


def _stretches(window: int, most: int):
    """Items of more than `most` bytes as stretches of their words that hold the same windows."""

    def run(batches):
        for batch in pieces(batches):
            names, out = [], []
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text) if len(text) * 4 > most else []
                size = sum(map(len, w)) + len(w)
                if size <= most:
                    names.append(name)
                    out.append(text)
                    continue
                step = max(window, len(w) * most // size)
                for at in range(0, max(1, len(w) - window + 1), step):
                    names.append(name)
                    out.append(b" ".join(w[at : at + step + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], ["item_id", "text"])

    return run


def _parts(texts: DataFrame, benchmark: DataFrame, window: int, shingle: int, item_bytes: int) -> Iterator[tuple[Items, bool]]:
    """The benchmark in parts, and whether there are several, of about item_bytes, with prefixes by the shingles' frequency over all texts."""
    sc = texts.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = cut(items.mapInArrow(_stretches(window, max(1, item_bytes // 8)), "item_id string, text string").distinct())
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    for p in range(parts):
        # At most about item_bytes: the benchmark's own share of this part, not the corpus.
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        part = Items([(r.item_id, r.text) for r in sorted(own, key=lambda r: (r.item_id or "", r.text))], window, shingle)
        found = texts.mapInArrow(_counts(sc.broadcast(part)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        counts = np.zeros(part.count, np.int64)
        for r in found.toLocalIterator():
            counts[r.shingle] = r.n
        part.order(counts)
        yield part, parts > 1


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = SHINGLE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """dk, doc_id, n_words, spans (ranges of words hit), items (ids with occurring windows), one row for each document.

    dk numbers the rows of docs; where the benchmark takes several parts, in a table that all of them read.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("dk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for part, several in _parts(rows.select("text"), benchmark, window, shingle, item_bytes):
        if several and not found:
            rows = cut(rows)
        found.append(rows.mapInArrow(_spans(sc.broadcast(part)), _SPANS))
    if len(found) == 1:
        return found[0]
    out = cut(reduce(DataFrame.unionByName, found))
    merged = out.groupBy("dk", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<lo:long,hi:long>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["lo"] <= F.element_at(acc, -1)["hi"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(x["hi"], F.element_at(acc, -1)["hi"]).alias("hi"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.withColumn("spans", joined)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["hi"] - x["lo"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = SHINGLE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    sc = docs.sparkSession.sparkContext
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def keep(shared):
        def run(batches):
            for batch in pieces(batches):
                yield batch.filter(pa.array([not len(shared.value.spans(words(t))[0]) for t in batch.column("text").to_pylist()], pa.bool_()))

        return run

    for part, _ in _parts(docs.select(F.col("text").cast("string").alias("text")), benchmark, window, shingle, item_bytes):
        docs = docs.mapInArrow(keep(sc.broadcast(part)), schema)
    return docs

"""Exact removal of long repeated byte strings with run-compressed Burrows-Wheeler indexes.

A string of `window` bytes goes to the place of its minimiser (the k-mer of least hash in it), which its
own bytes decide, so equal strings meet in one group wherever they stand. Runs of windows with one
minimiser make segments; equal segments (by 64-bit hashes of their bytes, among those with one minimiser) collapse to one
with a count before anything is shuffled with its text, and no more is done for a group whose segments are all equal.
A string that two segments of a group share holds the minimiser and half of what else it is long on one side of it, so
segments that share neither half with another are left out. The others of a group are indexed: suffixes are sorted, the transform is kept by its runs, the suffixes at run ends are
sampled, and matching statistics stream from the samples (a position that is no sample matches one byte less than the
position before it). Windows with a match of full length are marked.

Groups with more different segments than one index takes are split by what their windows have in common,
in narrower and narrower ranges of windows, down to single windows, so no group stays large.

shared_passages() says which texts hold so many words in a row that another text holds too, however few bytes they are:
the same segments over words. Texts that share a whole segment are settled; the segments of the others are compared
window by window, by 128-bit hashes, with those of their groups.

Defined results: a null text is empty; texts shorter than the window lose nothing; rows with equal doc_id
are separate texts; equal rows remove each other's windows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, pieces

KMER, WORD_KMER = 32, 8
CHUNK = 1 << 21
INDEX_BYTES = 1_000_000
HOT_SEGMENTS = 1024
#: Longer than any text.
NO_WINDOW = 1 << 40

_ODD = 0x9E3779B97F4A7C15
#: A random odd number for each byte.
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums by which any stretch's hash is (sums[b] - sums[a]) * down[a]."""
    up, down = _pows(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def runs(values: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: first start, last start, minimiser's place, its hash.

    values are symbols of pieces that end at `ends`; no window crosses an end. k symbols make a k-mer.
    """
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64)
    sums, down = _sums(values)
    h = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    w, bits = window - k + 1, np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = np.full(-(-len(h) // w) * w, ~np.uint64(0))
    keyed[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    keyed = keyed.reshape(-1, w)
    suffix = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    prefix = np.minimum.accumulate(keyed, axis=1).ravel()
    m = n - window + 1
    place = (np.minimum(suffix[:m], prefix[w - 1 : w - 1 + m]) & low).astype(np.int64)
    lens = np.diff(ends, prepend=0)
    place[np.arange(m) + window > np.repeat(ends, lens)[:m]] = -1
    first = np.flatnonzero(np.diff(place, prepend=-2))
    last = np.append(first[1:], m) - 1
    ok = place[first] >= 0
    first, last = first[ok], last[ok]
    at = place[first]
    return first, last, at, h[at]


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of an array's bytes."""
    view = memoryview(data.tobytes())
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64).view(np.int64)


def word_values(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of pieces that end at `ends`: first byte, byte after the last, a hash of each, and the number of words up to each end."""
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[ends] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums, down = _sums(_TABLE[data])
    return begin, end, _mix((sums[end] - sums[begin]) * down[begin]) + (end - begin).astype(np.uint64), np.searchsorted(begin, ends)


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Chunks of about CHUNK bytes: rows, offsets in their texts, bytes, ends. Long texts overlap by window - 1 bytes."""
    rows, offs, parts, size = [], [], [], 0
    for row, b in enumerate(texts):
        for o in range(0, max(1, len(b) - window + 1), CHUNK):
            piece = b[o : o + CHUNK + window - 1]
            if len(piece) < window:
                continue
            if parts and size + len(piece) > CHUNK + window:
                yield rows, offs, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts])
                rows, offs, parts, size = [], [], [], 0
            rows.append(row)
            offs.append(o)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield rows, offs, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts])


def _word_pieces(texts: list[bytes], words: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Like _pieces(), but the parts of a long text begin with a word and go on for words - 1 beyond the next one's beginning."""
    rows, offs, parts, size = [], [], [], 0
    for row, b in enumerate(texts):
        at = 0
        while at < len(b):
            border, end = at + CHUNK, len(b)
            if border < len(b):
                border = next((m.start() for m in _WORD.finditer(b, border) if m.start() > border or not _IN_WORD[b[border - 1]]), len(b))
                end = next((m.end() for i, m in enumerate(_WORD.finditer(b, border)) if i == words - 2), len(b))
            if parts and size + end - at > CHUNK:
                yield rows, offs, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts])
                rows, offs, parts, size = [], [], [], 0
            rows.append(row)
            offs.append(at)
            parts.append(b[at:end])
            size += end - at
            at = border
    if parts:
        yield rows, offs, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts])


_SCAN = "dk long, doc_id long, z binary, n_bytes long, seg array<struct<a:long,c:long,s:int,l:int,o:int>>, passages array<struct<a:long,c:long,s:int,l:int>>"


def _structs(rows: np.ndarray, texts: int, names: str, columns: list[np.ndarray]) -> pa.Array:
    """One list of structs for each text, from columns whose rows belong to texts."""
    offsets = np.searchsorted(rows, np.arange(texts + 1)).astype(np.int32)
    fields = [pa.array(x if name in "ac" else x.astype(np.int32)) for name, x in zip(names, columns, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, list(names)))


def _segments(texts: list[bytes], window: int) -> pa.Array:
    got: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
    for rows, offs, data, ends in _pieces(texts, window):
        first, last, at, a = runs(_TABLE[data], ends, window, min(KMER, window))
        h = _hashes(data, first, last + window)
        piece = np.searchsorted(ends, first, side="right")
        shift = np.asarray(offs)[piece] - np.concatenate([[0], ends[:-1]])[piece]
        for to, x in zip(got, (np.asarray(rows)[piece], a.view(np.int64), h, first + shift, last - first + window, at - first), strict=True):
            to.append(x)
    rows, *columns = (np.concatenate(x) for x in got)
    return _structs(rows, len(texts), "acslo", columns)


def _passages(texts: list[bytes], words: int) -> pa.Array:
    """Segments over words: minimiser, hash, first byte and length in bytes."""
    got: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    for rows, offs, data, ends in _word_pieces(texts, words) if words else ():
        begin, end, values, counts = word_values(data, ends)
        first, last, _, a = runs(values, counts, words, min(WORD_KMER, words))
        h = _hashes(values, 8 * first, 8 * (last + words))
        piece = np.searchsorted(ends, begin[first], side="right")
        shift = np.asarray(offs)[piece] - np.concatenate([[0], ends[:-1]])[piece]
        for to, x in zip(got, (np.asarray(rows)[piece], a.view(np.int64), h, begin[first] + shift, end[last + words - 1] - begin[first]), strict=True):
            to.append(x)
    rows, *columns = (np.concatenate(x) for x in got)
    return _structs(rows, len(texts), "acsl", columns)


def _scan(window: int, words: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, size=CHUNK):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            columns = [pa.array([pack.compress(b) for b in texts], pa.binary()), pa.array([len(b) for b in texts], pa.int64()), _segments(texts, window), _passages(texts, words)]
            yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("doc_id"), *columns], ["dk", "doc_id", "z", "n_bytes", "seg", "passages"])

    return run


class RunIndex:
    """Run-length Burrows-Wheeler index of one text of symbols, with the suffixes at run ends sampled."""

    def __init__(self, text: np.ndarray, depth: int):
        """depth: suffixes are ordered by at least so many symbols."""
        self.n = n = len(text)
        used, code = np.unique(text, return_inverse=True)
        bits = max(1, int(len(used)).bit_length())
        self.code = (code + 1).astype(np.int64)
        first = max(1, 62 // bits)
        padded = np.concatenate([self.code, np.zeros(first, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(first):
            key = (key << bits) | padded[i : i + n]
        order = np.argsort(key)
        rank, fresh = self._ranks(key, order)
        self.levels = [(first, rank)]
        h, q = first, int(n + 1).bit_length()
        fold = 3 if 3 * q <= 63 else 2
        while h < depth:
            single = fresh & np.append(fresh[1:], True)
            open_at = np.flatnonzero(~single)
            if not len(open_at):
                break
            sub = order[open_at]
            padded = np.concatenate([rank + 1, np.zeros((fold - 1) * h, np.int64)])
            key = padded[sub]
            for j in range(1, fold):
                key = (key << q) | padded[sub + j * h]
            move = np.argsort(key)
            order = order.copy()
            order[open_at] = sub[move]
            key = key[move]
            fresh = fresh.copy()
            fresh[open_at] = np.diff(key, prepend=-1) != 0
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            rank = np.empty(n, np.int64)
            rank[order] = start
            h *= fold
            self.levels.append((h, rank))
        self.order = order
        before = self.code[order - 1]
        before[order == 0] = 0
        change = np.flatnonzero(np.diff(before, prepend=-1))
        self.run_starts = change
        # Where the whole text's suffix stands, no symbol is before it: both its neighbours are sampled too.
        heads = np.union1d(self.run_starts, np.flatnonzero(order <= 0))
        tails = np.union1d(np.append(self.run_starts[1:], n) - 1, np.flatnonzero(order <= 0))
        self.samples = [(order[j], order[j - 1]) for j in (heads[heads > 0],)] + [(order[j], order[j + 1]) for j in (tails[tails < n - 1],)]

    def _ranks(self, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(self.n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(self.n), 0))
        return rank, fresh

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, from the ranks of each sorted length."""
        n, at = self.n, np.zeros(len(i), np.int64)
        for h, rank in reversed(self.levels):
            live = np.arange(len(i))
            while len(live):
                x, y = i[live] + at[live], j[live] + at[live]
                ok = (x < n) & (y < n)
                live, x, y = live[ok], x[ok], y[ok]
                live = live[rank[x] == rank[y]]
                at[live] += h
        live = np.arange(len(i))
        while len(live):
            x, y = i[live] + at[live], j[live] + at[live]
            ok = (x < n) & (y < n)
            live, x, y = live[ok], x[ok], y[ok]
            live = live[self.code[x] == self.code[y]]
            at[live] += 1
        return np.minimum(at, n - np.maximum(i, j))

    def statistics(self) -> np.ndarray:
        """For every position, the longest string from there that also starts anywhere else."""
        out = np.zeros(self.n, np.int64)
        for i, j in self.samples:
            np.maximum.at(out, i, self.common(i, j))
        if not self.n:
            return out
        place = np.arange(self.n)
        return np.maximum(np.maximum.accumulate(out + place) - place, 0)


def repeated_windows(parts: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each part, ranges (first, last) of window starts whose string also starts elsewhere in the parts."""
    text = np.zeros(sum(len(p) + 1 for p in parts), np.int16)
    begins, at = [], 0
    for p in parts:
        begins.append(at)
        text[at : at + len(p)] = np.frombuffer(p, np.uint8)
        text[at : at + len(p)] += 1
        at += len(p) + 1
    match = RunIndex(text, max(map(len, parts)) + 1).statistics()
    out = []
    for b, p in zip(begins, parts, strict=True):
        hit = np.zeros(max(0, len(p) - window + 1) + 2, np.int8)
        hit[1:-1] = match[b : b + len(hit) - 2] >= window
        edge = np.diff(hit)
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True)))
    return out


def _sharing_halves(key: list[int], o: list[int], seg: list[bytes], window: int) -> list[int]:
    """Places of the segments that share the minimiser and half a window before or after it with another of their key."""
    k = min(KMER, window)
    half = (window - k) // 2
    before = [(a, x[p - half : p + k]) if p >= half else None for a, p, x in zip(key, o, seg, strict=True)]
    after = [(a, x[p : p + k + half], 0) if p + k + half <= len(x) else None for a, p, x in zip(key, o, seg, strict=True)]
    seen = Counter(before) + Counter(after)
    return [i for i, halves in enumerate(zip(before, after, strict=True)) if any(h is not None and seen[h] > 1 for h in halves)]


def _index(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        halves = (table.column(x).to_pylist() for x in ("key", "o", "seg"))
        table = table.take(pa.array(_sharing_halves(*halves, window), pa.int64()))
        key, n, dk, s, seg = (table.column(x).to_pylist() for x in ("key", "n", "dk", "s", "seg"))
        got: list[tuple[int, int, int]] = []
        lo = 0
        while lo < len(key):
            hi, size = lo, 0
            while hi < len(key) and (size < INDEX_BYTES or key[hi] == key[hi - 1]):
                size += len(seg[hi]) + 1
                hi += 1
            for i, ranges in enumerate(repeated_windows(seg[lo:hi], window), lo):
                if n[i] == 1:
                    got += [(dk[i], s[i] + a, s[i] + b + window) for a, b in ranges]
            lo = hi
        return pa.table({"dk": pa.array([x[0] for x in got], pa.int64()), "lo": pa.array([x[1] for x in got], pa.int64()), "hi": pa.array([x[2] for x in got], pa.int64())})

    return run


_WANTED = "array<struct<a:long,n:long,dk:long,s:int,l:int>>"
_FETCHED = "key long, cls binary, n long, dk long, s long, o int, seg binary, kinds long"
#: `kinds` of a row that is a passage; else it is how many different segments its group has.
PASSAGE = -1


def _fetch(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in pieces(batches, "z"):
        out: list[tuple] = []
        for z, wanted, passages in zip(*(batch.column(x).to_pylist() for x in ("z", "wanted", "passages")), strict=True):
            b = unpack.decompress(z)
            out += [(w["a"], b"", w["n"], w["dk"], w["s"], w["o"], b[w["s"] : w["s"] + w["l"]], w["kinds"]) for w in wanted or ()]
            out += [(w["a"], b"", w["n"], w["dk"], w["s"], 0, b[w["s"] : w["s"] + w["l"]], PASSAGE) for w in passages or ()]
        yield _fetched_batch(out)


def _fetched_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "cls", "n", "dk", "s", "o", "seg", "kinds"])


def _narrow(window: int, width: int):
    """Split segments into ranges of `width` windows, placed from the minimiser, keyed by the bytes all of them hold."""

    def digest(*parts: bytes) -> bytes:
        return hashlib.blake2b(b"".join(parts), digest_size=16).digest()

    def run(batches):
        for batch in pieces(batches, "seg"):
            rows = batch.to_pydict()
            out: list[tuple] = []
            for key, n, dk, s, o, seg in zip(*(rows[x] for x in ("key", "n", "dk", "s", "o", "seg")), strict=True):
                last = len(seg) - window
                for block in range((0 - o) // width, (last - o) // width + 1):
                    a, b = max(0, block * width + o), min(last, block * width + width - 1 + o)
                    begin = block * width + width - 1 + o
                    core = seg[begin : max(begin, begin - width + 1 + window)]
                    part = seg[a : b + window]
                    name = key.to_bytes(8, "little", signed=True) + block.to_bytes(8, "little", signed=True)
                    out.append((int.from_bytes(digest(name, core)[:8], "little", signed=True), digest(name, part, (o - a).to_bytes(4, "little", signed=True)), n, dk, s + a, o - a, part, 0))
            yield _fetched_batch(out)

    return run


_WINDOWS = "h1 long, h2 long, dk long, open boolean"


def _windows(words: int):
    """A row for every window of so many words of the passages fetched."""

    def run(batches):
        for batch in pieces(batches, "seg"):
            out, dks, opens = [], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for dk, n, part in zip(*(batch.column(x).to_pylist() for x in ("dk", "n", "seg")), strict=True):
                values = word_values(np.frombuffer(part, np.uint8), np.array([len(part)]))[2]
                view = memoryview(values.tobytes())
                many = len(values) - words + 1
                out += [xxhash.xxh3_128_digest(view[8 * i : 8 * (i + words)]) for i in range(many)]
                dks.append(np.full(many, dk, np.int64))
                opens.append(np.full(many, n == 0))
            h = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.concatenate(dks)), pa.array(np.concatenate(opens))], ["h1", "h2", "dk", "open"])

    return run


class Passages:
    """Segments over words of a scan: which texts share one, and which segments are still to be compared."""

    def __init__(self, scan: DataFrame):
        found = scan.select("dk", F.explode("passages").alias("g")).select("dk", "g.*")
        classes = cut(found.groupBy("a", "c").agg(F.min(F.struct("dk", "s", "l")).alias("r"), F.max("dk").alias("high")))
        several = classes.where("r.dk <> high").select("a", "c")
        #: Texts that share a whole segment.
        self.settled = cut(found.select("dk", "a", "c").join(several, ["a", "c"], "left_semi").select("dk").distinct())
        # A group is compared if it holds another segment than that of an open text.
        single = classes.where("r.dk = high").select("a", "c", F.col("high").alias("dk")).join(self.settled, "dk", "left_anti")
        groups = classes.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds >= 2").join(single.select("a").distinct(), "a")
        mixed = classes.join(groups.select("a"), "a").join(single.select("a", "c", F.lit(True).alias("open")), ["a", "c"], "left")
        #: (dk, passages): segments to fetch of each text; n is 0 for those of open texts.
        self.wanted = mixed.groupBy("r.dk").agg(F.collect_list(F.struct("a", F.when(F.col("open"), 0).otherwise(1).cast("long").alias("n"), "r.dk", "r.s", "r.l")).alias("passages"))

    def sharing(self, parts: DataFrame, words: int) -> DataFrame:
        """(dk) of all texts that share a passage; parts are the segments fetched."""
        windows = cut(parts.where(F.col("kinds") == PASSAGE).select("dk", "n", "seg").mapInArrow(_windows(words), _WINDOWS))
        alike = windows.groupBy("h1", "h2").agg(F.min("dk").alias("low"), F.max("dk").alias("high")).where("low <> high").select("h1", "h2")
        more = windows.where("open").join(alike, ["h1", "h2"], "left_semi").select("dk")
        return self.settled.unionByName(more).distinct()


def shared_passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """doc_id, shares_passage: whether a text holds `words` words in a row that another row's text holds too. Words lie between white space."""
    return repeats(docs, NO_WINDOW, words=words).select("doc_id", "shares_passage")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("dk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame, window: int = 400, hot_segments: int = HOT_SEGMENTS, words: int = 0) -> DataFrame:
    """(dk, doc_id, z, n_bytes, marks, shares_passage): every text, packed, with the byte ranges that repeated windows cover.

    shares_passage is as of shared_passages() for `words`, and false if that is 0.
    """
    scan = cut(_rows(docs).mapInArrow(_scan(window, words), _SCAN), "lz4")
    passages = Passages(scan) if words else None
    found = scan.select("dk", F.explode("seg").alias("g")).select("dk", "g.*")
    classes = cut(found.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("dk", "s", "l", "o")).alias("r")))
    groups = classes.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds >= 2")
    mixed = classes.join(groups, "a").select("a", "n", "r.*", "kinds")
    wanted = mixed.groupBy("dk").agg(F.collect_list(F.struct("a", "n", "dk", "s", "l", "o", "kinds")).alias("wanted"))
    # Segments and passages are fetched together, as every text packed goes with the one it stands for.
    wanted = wanted.join(passages.wanted, "dk", "full") if passages else wanted.withColumn("passages", F.lit(None).cast(_WANTED))
    parts = cut(scan.select("dk", "z").join(wanted, "dk").select("z", "wanted", "passages").mapInArrow(_fetch, _FETCHED))
    marks = found.join(classes.where("n >= 2").select("a", "c"), ["a", "c"], "left_semi").select("dk", F.col("s").cast("long").alias("lo"), (F.col("s") + F.col("l")).cast("long").alias("hi"))

    def indexed(level: DataFrame) -> DataFrame:
        size = level.agg(F.sum(F.length("seg") + 1)).first()[0] or 0
        buckets = max(1, -(-size // INDEX_BYTES))
        keyed = level.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "n", "dk", "s", "o", "seg")
        return keyed.groupBy("bucket").applyInArrow(_index(window), "dk long, lo long, hi long")

    marks = marks.unionByName(indexed(parts.where(F.col("kinds").between(2, hot_segments))))
    hot = parts.where(F.col("kinds") > hot_segments)
    for width in (64, 8, 1):
        if hot.isEmpty():
            break
        level = cut(hot.mapInArrow(_narrow(window, width), _FETCHED)).drop("kinds")
        kinds = cut(level.groupBy("key", "cls").agg(F.sum("n").alias("all_n"), F.min(F.struct("dk", "s")).alias("r")))
        level = level.join(kinds, ["key", "cls"]).join(kinds.groupBy("key").agg(F.count("*").alias("kinds")), "key")
        level = cut(level)
        whole = level.where("all_n >= 2").select("dk", F.col("s").alias("lo"), (F.col("s") + F.length("seg")).alias("hi"))
        first = level.where(F.struct("dk", "s") == F.col("r")).select("key", "cls", F.col("all_n").alias("n"), "dk", "s", "o", "seg", "kinds")
        marks = marks.unionByName(whole).unionByName(indexed(first.where(F.col("kinds").between(2, hot_segments))))
        hot = first.where(F.col("kinds") > hot_segments)
    ranges = marks.groupBy("dk").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    out = scan.select("dk", "doc_id", "z", "n_bytes").join(ranges, "dk", "left")
    if not words:
        return out.withColumn("shares_passage", F.lit(False))
    sharing = cut(passages.sharing(parts, words)).withColumn("yes", F.lit(True))
    return out.join(sharing, "dk", "left").withColumn("shares_passage", F.coalesce("yes", F.lit(False))).drop("yes")


def _apply(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in pieces(batches, "z"):
        removed, spans, shas, texts = [], [], [], []
        for z, marks in zip(batch.column("z").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            b, at, gone, joined, kept = unpack.decompress(z), 0, 0, [], []
            for lo, hi in sorted((m["lo"], m["hi"]) for m in marks or ()):
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(hi, joined[-1][1])
                else:
                    joined.append([lo, hi])
            for lo, hi in joined:
                kept.append(b[at:lo])
                gone += hi - lo
                at = hi
            rest = b"".join([*kept, b[at:]])
            removed.append(gone)
            spans.append([{"lo": lo, "hi": hi} for lo, hi in joined])
            shas.append(hashlib.sha256(rest).hexdigest())
            texts.append(rest)
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        columns = [pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(shas, pa.string()), batch.column("shares_passage"), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("doc_id"), batch.column("n_bytes"), *columns], ["dk", "doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "shares_passage", "kept"])


def remove_repeats(docs: DataFrame, window: int = 400, hot_segments: int = HOT_SEGMENTS, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept_sha256, shares_passage, kept (the bytes left; a cut may fall inside a character)."""
    out = "dk long, doc_id long, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept_sha256 string, shares_passage boolean, kept binary"
    return repeats(docs, window, hot_segments, words).mapInArrow(_apply, out).drop("dk")

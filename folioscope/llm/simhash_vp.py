"""SimHash near-duplicates found with vantage-point partitions of the fingerprints.

Texts become 64-bit fingerprints by majority over hashed word shingles; equal fingerprints collapse to one.
Two fingerprints within r bits agree up to r // parts bits in one of `parts` slices, and the distance in a
slice is a metric. Each slice is partitioned by distance to vantage points, level by level; a fingerprint is
stored in one leaf of each slice and asked for in every leaf that its ball overlaps, by the triangle bound.
Within a leaf a vantage-point tree of the whole fingerprints prunes the rest, and every pair it leaves is
compared exactly. Leaves with many rows are dealt out in blocks. Linked pairs become union-find labels in each
task, so a dense group leaves a star of links, not all its pairs.

near_copies() takes a least Jaccard similarity of the sets of shingles instead of a radius. Wide fingerprints give
candidates, whose sets are then compared exactly.

Defined results: a null text has no words; texts without words have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; rows with equal doc_id count as one document; a null doc_id
stays null and joins no component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import components, cut, pieces

#: Rows of a leaf that one task compares, stored and asked for.
LEAF_ROWS, STORED, ASKED = 2048, 4096, 16384
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_STEP = 4096


def shingles(text: str | None, size: int) -> Iterator[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(size)), strict=False))


def fingerprint(text: str | None, size: int = 4) -> tuple[int, int]:
    """The fingerprint as a signed 64-bit number, and the number of shingles."""
    h = np.fromiter(map(_hash, shingles(text, size)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _STEP):
        ones += np.unpackbits(h[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0]), len(h)


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (signed), n (shingles)."""

    def run(batches):
        for batch in pieces(batches):
            got = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["doc_id", "fp", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, n long")


class SliceTree:
    """Vantage points for slices of the fingerprints; leaf names are paths of near (0) and far (1)."""

    def __init__(self, parts: int, reach: int, depth: int, seed: int = 5):
        self.parts, self.reach, self.depth = parts, reach, depth
        self.width = 64 // parts
        rng = np.random.default_rng(seed)
        self.points = [rng.integers(0, 1 << self.width, 1 << d, dtype=np.uint64) for d in range(depth)]

    def slices(self, fp: np.ndarray) -> list[np.ndarray]:
        x = fp.view(np.uint64)
        return [(x >> np.uint64(p * self.width)) & np.uint64((1 << self.width) - 1) for p in range(self.parts)]

    def _levels(self, part: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves that balls of radius `reach` overlap. Near is within half the width; ties of a level go by its parity."""
        rows, path = np.arange(len(part)), np.zeros(len(part), np.int64)
        for d in range(self.depth):
            far = np.bitwise_count(part[rows] ^ self.points[d][path]).astype(np.int64)
            cut_at = self.width // 2 - (d & 1)
            near, away = far - reach <= cut_at, far + reach > cut_at
            rows, path = np.concatenate([rows[near], rows[away]]), np.concatenate([path[near] * 2, path[away] * 2 + 1])
        return rows, path

    def stored(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._levels(part, 0)

    def asked(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._levels(part, self.reach)


class Labels:
    """Union-find over positions, kept as an array of labels."""

    def __init__(self, n: int):
        self.at = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.at[i], self.at[j]
        differ = a != b
        if not differ.any():
            return
        pairs = np.unique(np.stack([a[differ], b[differ]]), axis=1)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                up[x] = x = up.get(up[x], up[x])
                if x not in up:
                    break
            return x

        for x, y in pairs.T.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        olds = np.array(list(up))
        table = np.arange(len(self.at))
        table[olds] = [root(x) for x in olds.tolist()]
        self.at = table[self.at]


def search(stored: np.ndarray, asked: np.ndarray, radius: int, found, depth: int = 0, places: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """found(i, j) gets every pair of positions with stored[i] and asked[j] within radius, in portions."""
    i, j = places or (np.arange(len(stored)), np.arange(len(asked)))
    if not len(i) or not len(j):
        return
    if len(i) <= 64 or len(j) <= 4 or depth >= 16:
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(j), step):
            y, x = np.nonzero(np.bitwise_count(asked[j[k : k + step], None] ^ stored[i][None, :]) <= radius)
            if len(x):
                found(i[x], j[k + y])
        return
    v = stored[i[len(i) // 2]]
    di, dj = np.bitwise_count(stored[i] ^ v).astype(np.int16), np.bitwise_count(asked[j] ^ v).astype(np.int16)
    mid = int(np.median(di))
    if mid == int(di.max()):
        mid -= 1
    if mid < int(di.min()):  # all at one distance
        lo, hi = int(di.min()) - radius, int(di.max()) + radius
        search(stored, asked, radius, found, 16, (i, j[(dj >= lo) & (dj <= hi)]))
        return
    for own in (di <= mid, di > mid):
        lo, hi = int(di[own].min()), int(di[own].max())
        search(stored, asked, radius, found, depth + 1, (i[own], j[(dj >= lo - radius) & (dj <= hi + radius)]))


def _route(tree: SliceTree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fp = rows["fp"].to_numpy(np.int64)
            for p, part in enumerate(tree.slices(fp)):
                for kind, (at, leaf) in enumerate((tree.stored(part), tree.asked(part))):
                    yield pd.DataFrame({"leaf": leaf * tree.parts + p, "kind": kind, "fp": fp[at]})

    return run


def _compare(radius: int):
    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp, kind = rows["fp"].to_numpy(np.int64), rows["kind"].to_numpy()
        names = np.unique(fp)
        stored, asked = np.unique(fp[kind == 0]), np.unique(fp[kind == 1])
        si, aj = np.searchsorted(names, stored), np.searchsorted(names, asked)
        labels = Labels(len(names))
        search(stored.view(np.uint64), asked.view(np.uint64), radius, lambda i, j: labels.join(si[i], aj[j]))
        moved = np.flatnonzero(labels.at != np.arange(len(names)))
        return pd.DataFrame({"a": names[labels.at[moved]], "b": names[moved]})

    return run


def near_links(prints: DataFrame, radius: int = 4, parts: int = 4) -> DataFrame:
    """Links (a, b) between fingerprints that leave the same components as all pairs within radius."""
    count = prints.count()
    # Deep enough for leaves of LEAF_ROWS; a slice has no more than its own values to tell apart.
    depth = min(64 // parts - 4, max(0, (max(1, count) // LEAF_ROWS).bit_length()))
    tree = SliceTree(parts, radius // parts, depth)
    routed = cut(prints.select("fp").mapInPandas(_route(tree), "leaf long, kind int, fp long"))
    sizes = routed.groupBy("leaf").agg(F.count_if(F.col("kind") == 0).alias("s"), F.count_if(F.col("kind") == 1).alias("q"))
    sizes = sizes.where("s > 0 and q > 0").select("leaf", F.ceil(F.col("s") / STORED).alias("sb"), F.ceil(F.col("q") / ASKED).alias("qb"))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("kind") == 0, F.col("sb")).otherwise(F.col("qb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("kind") == 0, F.col("qb")).otherwise(F.col("sb")) - 1))
    dealt = routed.join(sizes, "leaf").select("leaf", "kind", "fp", own.alias("own"), other.alias("other"))
    dealt = dealt.select("leaf", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")).alias("x"), F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own")).alias("y"), "kind", "fp")
    # Dealt by all keys: the join's partitions, by leaf, would put all blocks of a leaf into one task.
    return dealt.repartition("leaf", "x", "y").groupBy("leaf", "x", "y").applyInPandas(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links."""
    prints = cut(fingerprints(docs, size).select("doc_id", "fp"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = named.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(groups, "fp").select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Multipliers that turn one shingle hash into WORDS independent ones.
WORDS, _SPREAD = 4, np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: Rows of a size that one task compares. Large blocks: each row is sent once for every block of the other side.
WIDE_STORED, WIDE_ASKED = 16384, 65536
#: Hashes of a block of sets that one task verifies; each row counts for ROW_HASHES more. Pivots of a group of many blocks.
SET_HASHES, ROW_HASHES, PIVOTS = 2_000_000, 128, 16


def wide_radius(similarity: float, words: int = WORDS, deviations: float = 6.0) -> int:
    """Bits of so many words that a pair of this Jaccard similarity differs in, by the angle between its sets, and so many standard deviations more."""
    bits = 64 * words
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return min(bits, int(bits * share + deviations * np.sqrt(bits * share * (1 - share))))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted different hashes of the shingles."""
    return np.unique(np.fromiter(map(_hash, shingles(text, size)), np.uint64))


def wide_fingerprint(text: str | None, size: int = 5) -> tuple[bytes, bytes, int]:
    """The 128-bit hash of the set of shingles, its fingerprint of 64 * WORDS bits and its size."""
    h = shingle_set(text, size)
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), _STEP):
        x = h[i : i + _STEP, None] * _SPREAD[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(_SPREAD[1])
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return xxhash.xxh3_128_digest(h.tobytes()), np.packbits(2 * ones > len(h), bitorder="little").tobytes(), len(h)


#: Rows stored, of neighbouring sizes, that share a vantage-point tree.
TREE_ROWS = 4096


def _compare_wide(similarity: float):
    """Labels of rows of like size whose fingerprints agree well enough, in the first word, by vantage-point trees, and in all."""
    first, whole = wide_radius(similarity, 1, 5.5), wide_radius(similarity)

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "first"], kind="stable")
        names, place = np.unique(rows["first"].to_numpy(), return_inverse=True)
        kind, n = rows["kind"].to_numpy(), rows["n"].to_numpy(np.float64)
        fp = np.frombuffer(b"".join(rows["fp"]), np.uint64).reshape(-1, WORDS)
        s, q = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        head, labels = np.ascontiguousarray(fp[:, 0]), Labels(len(names))

        def found(x: np.ndarray, y: np.ndarray) -> None:
            ok = (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])) & (place[x] != place[y])
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= whole
            labels.join(place[x[ok]], place[y[ok]])

        for a in range(0, len(s), TREE_ROWS):
            i = s[a : a + TREE_ROWS]
            # Both are in order of their sizes, so those of like size are one stretch.
            lo, hi = np.searchsorted(n[q], similarity * n[i[0]] - 1e-9), np.searchsorted(n[q], n[i[-1]] / similarity + 1e-9, side="right")
            j = q[lo:hi]
            search(head[i], head[j], first, lambda x, y, i=i, j=j: found(i[x], j[y]))
        moved = np.flatnonzero(labels.at != np.arange(len(names)))
        return pd.DataFrame({"a": names[labels.at[moved]], "b": names[moved]})

    return run


def _deal(rows: DataFrame, keys: list[str], weight: Column, stored: int, asked: int) -> DataFrame:
    """Rows of kind 0 (stored) and 1 (asked), dealt so that each pair of their blocks within `keys` meets in one (keys, x, y)."""
    stores = F.col("kind") == 0
    sizes = rows.groupBy(*keys).agg(F.sum(F.when(stores, weight)).alias("s"), F.sum(F.when(~stores, weight)).alias("q")).where("s > 0 and q > 0")
    sizes = sizes.select(*keys, F.ceil(F.col("s") / stored).alias("sb"), F.ceil(F.col("q") / asked).alias("qb"))
    own = F.pmod(F.xxhash64("first", "fp"), F.when(stores, F.col("sb")).otherwise(F.col("qb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(stores, F.col("qb")).otherwise(F.col("sb")) - 1))
    dealt = rows.join(sizes, keys).select(*rows.columns, own.alias("own"), other.alias("other"))
    return dealt.select(*rows.columns, F.when(stores, F.col("own")).otherwise(F.col("other")).alias("x"), F.when(stores, F.col("other")).otherwise(F.col("own")).alias("y"))


def _kinds(*kinds: tuple[int, Column]) -> Column:
    """One row for each kind and group."""
    return F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), group.alias("group")) for kind, group in kinds]))


def _candidates(distinct: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of `first` between sets of like size whose fingerprints agree well enough for this similarity.

    Sets meet those of their own size class and the next, in blocks: balls this wide overlap nearly every leaf of a
    vantage-point partition of the fingerprints, so sizes partition them. In a block, vantage-point trees of the first
    word find what lies within its radius among like sizes; the other words are compared for what they leave.
    """
    ring = F.floor(-F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(similarity)) + 1e-9).cast("long")
    routed = distinct.select("first", "fp", "n", _kinds((0, ring), (1, ring), (1, ring - 1)))
    dealt = _deal(routed, ["group"], F.lit(1), WIDE_STORED, WIDE_ASKED)
    return dealt.repartition("group", "x", "y").groupBy("group", "x", "y").applyInPandas(_compare_wide(similarity), "a long, b long")


def _verify(radius: int, similarity: float):
    """Labels of the rows after exact comparison; pairs that share a label already are not compared again."""

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first", kind="stable")
        names, place = np.unique(rows["first"].to_numpy(), return_inverse=True)
        kind = rows["kind"].to_numpy()
        fp = np.frombuffer(b"".join(rows["fp"]), np.uint64).reshape(-1, WORDS)
        sets = [np.frombuffer(x, np.uint64) for x in rows["h"]]
        n = np.array([len(x) for x in sets], np.int64)
        begin = np.cumsum(n) - n
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mine, labels = np.zeros(len(values), bool), Labels(len(names))
        _, known, of = np.unique(rows["sub"].to_numpy(), return_index=True, return_inverse=True)
        labels.join(place, place[known[of]])
        asked = np.flatnonzero(kind != 0)
        for i in np.flatnonzero(kind != 1):
            c = asked[labels.at[place[asked]] != labels.at[place[i]]]
            c = c[(np.minimum(n[c], n[i]) >= similarity * np.maximum(n[c], n[i])) & (n[c] > 0)]
            c = c[np.bitwise_count(fp[c] ^ fp[i]).sum(axis=1, dtype=np.int64) <= radius]
            if not len(c):
                continue
            own = ids[begin[i] : begin[i] + n[i]]
            mine[own] = True
            edge = np.cumsum(n[c]) - n[c]
            both = np.add.reduceat(mine[ids[np.repeat(begin[c] - edge, n[c]) + np.arange(n[c].sum())]], edge, dtype=np.int64)
            mine[own] = False
            c = c[both >= similarity * (n[c] + n[i] - both) - 1e-9]
            labels.join(place[c], np.full(len(c), place[i]))
        moved = np.flatnonzero(labels.at != np.arange(len(names)))
        return pd.DataFrame({"a": names[labels.at[moved]], "b": names[moved]})

    return run


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that leave the same components as all pairs of one `root` whose sets h are alike.

    A group of candidates within SET_HASHES is one task. A larger one is dealt out in blocks, each compared in
    itself and with a few pivots of the group; then what is not in the group's largest component is compared
    with the whole group, again in blocks. So only a few rows of a dense group are sent more than once.
    """
    verify = _verify(wide_radius(similarity), similarity)
    weight = F.col("n") + ROW_HASHES
    large = cut(sets.groupBy("root").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("rows")).where(F.col("w") > SET_HASHES))
    blocks = F.coalesce(F.ceil(F.col("w") / SET_HASHES), F.lit(1))
    drawn = F.pmod(F.xxhash64(F.lit("pivot"), "first", "fp"), F.lit(1 << 30)) * F.col("rows") < PIVOTS * (1 << 30)
    everywhere = F.col("w").isNotNull() & (drawn | (F.col("first") == F.col("root")))
    block = F.when(everywhere, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("first", "fp"), blocks)))
    placed = sets.join(large, "root", "left").select("root", F.explode(block).alias("block"), "first", F.col("first").alias("sub"), F.lit(2).alias("kind"), "fp", "h")
    within = cut(placed.repartition("root", "block").groupBy("root", "block").applyInPandas(verify, "a long, b long"))
    if large.isEmpty():
        return within
    subs = components(within).select(F.col("node").alias("first"), F.col("root").alias("sub"))
    rows = sets.join(large.select("root"), "root", "left_semi").join(subs, "first", "left").withColumn("sub", F.coalesce("sub", "first"))
    most = rows.groupBy("root", "sub").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.max_by("sub", F.struct("c", "sub")).alias("most"))
    rest = rows.join(most, "root").where("sub <> most").select(*rows.columns)
    asked = rows.join(rest.select("root").distinct(), "root", "left_semi")
    both = rest.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    dealt = _deal(cut(both), ["root"], weight, SET_HASHES, SET_HASHES)
    return within.unionByName(dealt.repartition("root", "x", "y").groupBy("root", "x", "y").applyInPandas(verify, "a long, b long"))


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every document that is alike to one of smaller doc_id, directly or through others.

    Alike: the Jaccard similarity of their sets of shingles is at least `similarity`; texts without words are
    alike. Candidates come from wide fingerprints, which let all but one in 10^7 pairs at the limit through where
    texts are long, and about one in 20,000 less of a dozen words; every link between different sets is then verified exactly.
    Documents without a doc_id take no part.
    """

    def prints_of(batches):
        for batch in pieces(batches):
            got = [wide_fingerprint(t, size) for t in batch.column("text").to_pylist()]
            key, fp, n = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(fp, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "key", "fp", "n"])

    def sets_of(batches):
        for batch in pieces(batches):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            keys, prints = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], [h.tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column("first"), batch.column("root"), pa.array(keys, pa.binary()), pa.array(prints, pa.binary())], ["first", "root", "key", "h"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut(rows.mapInArrow(prints_of, "doc_id long, key binary, fp binary, n long"))
    distinct = cut(prints.groupBy("key", "fp", "n").agg(F.min("doc_id").alias("first")))
    groups = cut(components(_candidates(distinct, similarity)))
    members = rows.join(groups.withColumnRenamed("node", "doc_id"), "doc_id").select(F.col("doc_id").alias("first"), "root", "text")
    hashed = members.mapInArrow(sets_of, "first long, root long, key binary, h binary").groupBy("first", "root", "key").agg(F.first("h").alias("h"))
    sets = cut(hashed.join(distinct, ["first", "key"]).select("first", "root", "fp", "n", "h"))
    roots = components(_verified(sets, similarity))
    named = prints.join(distinct, ["key", "fp", "n"]).select("doc_id", "first").join(roots.withColumnRenamed("node", "first"), "first", "left")
    return named.select("doc_id", F.coalesce("root", "first").alias("component_id")).where("doc_id <> component_id").distinct()

"""Embedding near-duplicates over hierarchical navigable small-world graphs, one for each shard of a label.

Vectors of one label (and length) are dealt by hash into shards of at most about `shard_rows`; each gets a
layered graph, however few they are. Every shard is searched with the vectors of every shard of its label. A query that
finds as many links as a node has neighbours stands in a dense group and then takes all products; a beam whose audit
(some queries held against brute force) misses a link of the others or shows less recall than asked is doubled for all.
Where a beam as wide as the shard still fails its audit all queries take all products. Candidates count only if their cosine in double precision reaches the threshold.
Equal vectors are one class with a count, so a vector with very many copies costs as much as one.

Defined results: a null label, a null, empty or zero vector and one with null or non-finite components have no
links; vectors of different lengths don't link; rows with equal vec_id count as one vector for components; a null
vec_id takes no part in links; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import components, cut

SHARD_ROWS = 8192
NEIGHBOURS, BEAM, AUDIT, RECALL = 24, 48, 128, 0.99
#: Width of the beams that choose a new node's links. Many links, chosen among many, let narrow beams find what the audit asks for.
BUILD_BEAM = 4 * NEIGHBOURS
#: Queries searched at once, and products taken at once: what is gathered for them should stay in a core's cache.
QUERIES, PRODUCTS = 256, 2048
_SLACK = 1e-4


class Graph:
    """A layered small-world graph over unit vectors, built and searched for many vectors at once."""

    def __init__(self, unit: np.ndarray, packed: bytes | None = None, seed: int = 9):
        """packed: what pack() gave for the same vectors."""
        self.x = np.ascontiguousarray(unit, np.float32)
        n = len(self.x)
        levels = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(NEIGHBOURS)), 6).astype(int)
        levels[:1] = levels.max(initial=0)
        self.levels = levels
        #: For each layer, its nodes' rows of links (-1: none).
        self.layers = [np.full((n, 2 * NEIGHBOURS if layer == 0 else NEIGHBOURS), -1, np.int32) for layer in range(levels.max(initial=0) + 1)]
        at = 0 if packed is not None else 1
        if packed is not None:
            for k, rows in enumerate(self.layers):
                nodes = np.flatnonzero(levels >= k)
                rows[nodes] = np.frombuffer(packed, np.int32, rows[nodes].size, at).reshape(len(nodes), -1)
                at += 4 * rows[nodes].size
            return
        while at < n:
            size = min(256, at, n - at)
            self._add(np.arange(at, at + size))
            at += size

    def pack(self) -> bytes:
        return b"".join(rows[self.levels >= k].tobytes() for k, rows in enumerate(self.layers))

    def beam(self, layer: int, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `width` nodes found for each query, with their products; -1 where there are fewer."""
        rows, b = self.layers[layer], len(queries)
        ids, sims = np.full((b, width), -1, np.int32), np.full((b, width), -np.inf, np.float32)
        done = np.ones((b, width), bool)
        places = len(self.x) + 1
        seen = np.zeros(b * places, bool)  # a query's last place stands for no node, as does the last one of the query before
        k = min(entry.shape[1], width)
        ids[:, :k], done[:, :k] = entry[:, :k], entry[:, :k] < 0
        seen[places * np.arange(b)[:, None] + entry[:, :k]] = True
        sims[:, :k] = np.where(entry[:, :k] >= 0, np.einsum("bkd,bd->bk", self.x[entry[:, :k]], queries), -np.inf)
        live = np.arange(b)
        step = max(4, width // 8)  # nodes opened at once: a wide beam is sorted again for each
        while True:
            live = live[~done[live].all(axis=1)]
            if not len(live):
                return ids, sims
            open_sims = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_sims, min(step, width) - 1, axis=1)[:, :step]
            ok = np.take_along_axis(open_sims, pick, axis=1) > -np.inf
            nodes = np.where(ok, np.take_along_axis(ids[live], pick, axis=1), -1)
            done[live[:, None], pick] = True
            near = np.where(nodes[:, :, None] >= 0, rows[nodes], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            place = places * live[:, None] + near
            near[seen[place]] = -1
            seen[place] = True
            r, c = np.nonzero(near >= 0)
            got = np.full(near.shape, -np.inf, np.float32)
            got[r, c] = self._products(near[r, c], queries, live[r])
            all_sims = np.concatenate([sims[live], got], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(all_sims, top, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), top, axis=1)
            done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], axis=1), top, axis=1)

    def _products(self, nodes: np.ndarray, queries: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.empty(len(nodes), np.float32)
        for k in range(0, len(nodes), PRODUCTS):
            s = slice(k, k + PRODUCTS)
            out[s] = np.einsum("ed,ed->e", self.x[nodes[s]], queries[of[s]])
        return out

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        entry = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.layers) - 1, to, -1):
            ids, sims = self.beam(layer, queries, entry, 4)
            entry = np.take_along_axis(ids, np.argsort(-sims, axis=1), axis=1).astype(np.int64)
        return entry

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in falling order, those nearer to the query than to any taken before; then the nearest of the rest."""
        b, k = ids.shape
        x = self.x[ids]
        among = x @ x.transpose(0, 2, 1)
        taken, count = np.zeros((b, k), bool), np.zeros(b, int)
        for j in range(k):
            ok = (ids[:, j] >= 0) & (count < most) & ~((among[:, j] >= sims[:, j, None]) & taken).any(axis=1)
            taken[:, j] = ok
            count += ok
        order = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, axis=1)

    def _add(self, new: np.ndarray) -> None:
        q = self.x[new]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        for layer in range(self.levels[new].max(), -1, -1):
            own = np.flatnonzero(self.levels[new] >= layer)
            ids, sims = self.beam(layer, q[own], self.descend(q[own], layer), BUILD_BEAM)
            mates = among[np.ix_(own, own)]
            k = min(NEIGHBOURS, len(own) - 1)
            if k > 0:
                near = np.argpartition(-mates, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, new[own][near].astype(np.int32)], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(mates, near, axis=1)], axis=1)
            order = np.argsort(ids, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            ids[ids == new[own][:, None]] = -1
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            order = np.argsort(np.where(ids < 0, np.inf, -sims), axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            chosen = self._diverse(ids, sims, NEIGHBOURS)
            self.layers[layer][new[own], : chosen.shape[1]] = chosen
            self._back(layer, new[own], chosen)

    def _back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        rows = self.layers[layer]
        r, c = np.nonzero(chosen >= 0)
        to, source = chosen[r, c], new[r].astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        heads, begin, count = np.unique(to, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        if not width:
            return
        extra = np.full((len(heads), width), -1, np.int32)
        extra[np.repeat(np.arange(len(heads)), count), np.arange(len(to)) - np.repeat(begin, count)] = source
        ids = np.sort(np.concatenate([rows[heads], extra], axis=1), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        r, c = np.nonzero(ids >= 0)
        sims = np.full(ids.shape, -np.inf, np.float32)
        sims[r, c] = self._products(ids[r, c], self.x, heads[r])
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        full = (ids >= 0).sum(axis=1) > rows.shape[1]
        kept = ids[:, : rows.shape[1]].copy()
        if full.any():
            kept[full] = self._diverse(ids[full], sims[full], rows.shape[1])
        rows[heads, : kept.shape[1]] = kept

    def near(self, queries: np.ndarray, least: float, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) whose product reaches least, about; widens beams until the audit passes.

        Queries that find NEIGHBOURS links or more stand in a dense group and take all products.
        """
        n, b = len(self.x), len(queries)
        audit = np.unique(np.linspace(0, b - 1, min(b, AUDIT)).astype(int))
        truth = queries[audit] @ self.x.T
        top = np.argpartition(-truth, min(3, n - 1), axis=1)[:, : min(4, n)]
        width = min(width, n)
        while (missed := not self._passes(queries[audit], truth, top, least, width)) and width < n:
            width = min(n, 2 * width)
        out_q, out_n = [], []
        for k in range(0, b, QUERIES):
            some = np.arange(k, min(b, k + QUERIES))
            if not missed:
                ids, sims = self.beam(0, queries[some], self.descend(queries[some], 0), width)
                dense = self._dense(sims, least)
                q, c = np.nonzero((sims >= least) & ~dense[:, None])
                out_q.append(some[q])
                out_n.append(ids[q, c])
                some = some[dense]
            q, node = np.nonzero(queries[some] @ self.x.T >= least)
            out_q.append(some[q])
            out_n.append(node)
        return np.concatenate(out_q), np.concatenate(out_n)

    def _dense(self, sims: np.ndarray, least: float) -> np.ndarray:
        """Queries with as many links in their beam as a node has: of a group this large the graph may not lead to all."""
        return ((sims >= least).sum(axis=1) >= NEIGHBOURS) & (sims.shape[1] < len(self.x))

    def _passes(self, queries: np.ndarray, truth: np.ndarray, top: np.ndarray, least: float, width: int) -> bool:
        """Whether a beam finds every link of some queries, and of their nearest nodes the share RECALL."""
        ids, sims = self.beam(0, queries, self.descend(queries, 0), width)
        ids = np.where(self._dense(sims, least)[:, None], -1, ids)  # those take all products anyway
        open_rows = (ids >= 0).any(axis=1)
        if not open_rows.any():
            return True
        hit = (top[open_rows][:, :, None] == ids[open_rows][:, None, :]).any(axis=2)
        q, node = np.nonzero(truth[open_rows] >= least)
        return hit.mean() >= RECALL and bool((ids[open_rows][q] == node[:, None]).any(axis=1).all())


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_SHARD = "label string, dim int, shard long, cls binary, n binary, vec binary, graph binary"


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("cls")
    dim = table.column("dim")[0].as_py()
    vec = np.array(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
    unit = _unit(vec)
    graph = Graph(unit).pack()
    one = {x: [table.column(x)[0].as_py()] for x in ("label", "dim", "shard")}
    packed = {"cls": np.array(table.column("cls"), np.int64), "n": np.array(table.column("n"), np.int64), "vec": unit}
    return pa.table({**{k: pa.array(v, t) for (k, v), t in zip(one.items(), (pa.string(), pa.int32(), pa.int64()), strict=True)}, **{k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()}, "graph": pa.array([graph], pa.binary())})


def _search(threshold: float):
    def load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
        unit = np.frombuffer(row["vec"], np.float64).reshape(-1, row["dim"])
        return np.frombuffer(row["cls"], np.int64), np.frombuffer(row["n"], np.int64), unit, Graph(unit, row["graph"])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
        one, two = load(rows[0]), load(rows[-1])
        same = len(rows) == 1
        i, j = one[3].near(two[2].astype(np.float32), threshold - _SLACK)[::-1]
        pairs = [np.stack([i, j])]
        if not same:
            pairs.append(np.stack(two[3].near(one[2].astype(np.float32), threshold - _SLACK)))
        i, j = np.unique(np.concatenate(pairs, axis=1), axis=1)
        if same:
            i, j = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)])[:, i != j], axis=1)
        sure = np.zeros(len(i), bool)
        for k in range(0, len(i), 65536):
            s = slice(k, k + 65536)
            sure[s] = np.einsum("ed,ed->e", one[2][i[s]], two[2][j[s]]) >= threshold
        i, j = i[sure], j[sure]
        a, b = one[0][i], two[0][j]
        # Counts of links for each class, and for each class one link to its least partner: unions need no more
        # than a forest, so links are thinned to one for each pair of labels after a pass of label joining.
        names = np.unique(np.concatenate([a, b]))
        x, y = np.searchsorted(names, a), np.searchsorted(names, b)
        links = np.bincount(x, weights=two[1][j], minlength=len(names)) + np.bincount(y, weights=one[1][i], minlength=len(names))
        at = np.arange(len(names))
        while len(x):
            low = at.copy()
            np.minimum.at(low, x, at[y])
            np.minimum.at(low, y, at[x])
            low = low[low]
            if (low == at).all():
                break
            at = low
        return pa.table({"cls": pa.array(names), "links": pa.array(links.astype(np.int64)), "to": pa.array(names[at])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False))
    good &= F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(good, v).alias("v"))
    classes = cut(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n")))
    classes = classes.withColumn("dim", F.size("v"))
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    dealt = classes.join(shards, ["label", "dim"]).select("label", "dim", F.pmod(F.xxhash64("cls", "v"), F.col("shards")).alias("shard"), "cls", "n", "v")
    # Dealt by all keys: the joins' partitions, by label and dim, would put all shards of a label into one task.
    dealt = dealt.repartition("label", "dim", "shard")
    built = cut(dealt.groupBy("label", "dim", "shard").applyInArrow(_build, _SHARD))
    partners = built.select("label", "dim", F.col("shard").alias("other"))
    pairs = built.join(partners, ["label", "dim"]).withColumn("x", F.least("shard", "other")).withColumn("y", F.greatest("shard", "other"))
    pairs = pairs.repartition("label", "dim", "x", "y")
    found = cut(pairs.groupBy("label", "dim", "x", "y").applyInArrow(_search(threshold), "cls long, links long, to long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.where("cls <> to").select(F.col("to").alias("a"), F.col("cls").alias("b")))
    known = classes.select("label", "v", "cls", "n").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    # A table of its own: a label's copies of one vector may be a third of all rows, and only a join's plain sides are split.
    known = cut(known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("component_id")))
    linked = rows.where("v is not null").join(known, ["label", "v"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Line deduplication over range-partitioned line hashes.

The lines' keys are hashed to 128 bits; rows of hash, document and position are range-partitioned and sorted
by all three, so one very common line spreads over as many partitions as it needs. Each partition is streamed:
the first document of a hash keeps its lines, later ones lose theirs. A hash that runs on from the partition
before is settled by one row for each partition (its first and last hash). The result is a compressed
bitmap of lost lines for each document, not text: the words of 64 lines that hold one. Texts are hashed and bitmaps
made by Spark itself, so no task keeps more than one Python worker. What was streamed is the only table written;
lines are hashed again for the ranges' sample, as writing costs a program started for each file (see `tables.cut`).

Defined results: a null text is one empty line; rows with equal doc_id are one document, so they don't take
lines from each other; a null doc_id comes after all others, and all rows with it are one document; keys shorter
than `least` code points stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, pieces

LEAST = 10
_SPACE = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _lines(least: int):
    def run(batches):
        for batch in pieces(batches):
            hashes, rows, places = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for i, line in enumerate((text or "").split("\n")):
                    line = line.strip(_SPACE)
                    if len(line) >= least:
                        hashes.append(xxhash.xxh3_128_digest(line.encode().lower()))
                        rows.append(row)
                        places.append(i)
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            at = np.asarray(rows, np.int64)
            docs, keys = (batch.column(x).to_numpy() for x in ("doc", "tk"))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs[at]), pa.array(keys[at]), pa.array(places, pa.int32())], ["h1", "h2", "doc", "tk", "line"])

    return run


_STREAM = "pid int, kind int, h1 long, h2 long, doc long, tk long, line int"
#: Kinds of rows: lost for sure, to be settled with the partition before, first and last hash of the partition.
LOST, OPEN, HEAD, TAIL = range(4)


def _stream(batches):
    """Rows come sorted by hash, document and line."""
    pid = TaskContext.get().partitionId()
    head = last = None  # (hash, first document)

    def rows(kind, h1, h2, doc, tk, line):
        n = len(h1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), pa.array(np.full(n, kind, np.int32) if np.isscalar(kind) else kind), *(pa.array(x) for x in (h1, h2, doc, tk, line))], ["pid", "kind", "h1", "h2", "doc", "tk", "line"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, tk, line = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("h1", "h2", "doc", "tk", "line"))
        fresh = np.ones(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last and last[0] == (h1[0], h2[0]):
            fresh[0] = False
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), -1))
        first = np.where(begin >= 0, doc[begin], last[1] if last else 0)
        if head is None:
            head = ((h1[0], h2[0]), doc[0])
        opened = (h1 == head[0][0]) & (h2 == head[0][1])
        out = opened | (doc != first)
        if out.any():
            yield rows(np.where(opened, OPEN, LOST).astype(np.int32)[out], h1[out], h2[out], doc[out], tk[out], line[out])
        last = ((h1[-1], h2[-1]), first[-1])
    if head is not None:
        for kind, (h, doc) in ((HEAD, head), (TAIL, last)):
            yield rows(kind, *(np.array([x], np.int64) for x in (h[0], h[1], doc, 0)), np.array([0], np.int32))


def lost_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, tk, line) of every line that a document loses; doc is doc_id or the largest long for null."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), text_key().alias("tk"), F.col("text").cast("string").alias("text"))
    lines = rows.mapInArrow(_lines(least), "h1 long, h2 long, doc long, tk long, line int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc", "line", "tk"]
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    seen = cut(ranged.mapInArrow(_stream, _STREAM))
    # Two rows for each partition: which document holds the hash that a partition begins with.
    edges: dict[int, dict[int, tuple]] = {}
    for r in seen.where(F.col("kind").isin(HEAD, TAIL)).collect():
        edges.setdefault(r.pid, {})[r.kind] = ((r.h1, r.h2), r.doc)
    owners, last = [0] * (max(edges, default=0) + 1), None
    for pid in sorted(edges):
        head, tail = edges[pid][HEAD], edges[pid][TAIL]
        owners[pid] = first = last[1] if last and last[0] == head[0] else head[1]
        last = (tail[0], first if tail[0] == head[0] else tail[1])
    # A constant, so that nothing is broadcast beside the merge with the texts.
    first = F.expr(f"array({', '.join(f'{x}L' for x in owners)})")[F.col("pid")]
    gone = (F.col("kind") == LOST) | ((F.col("kind") == OPEN) & (F.col("doc") != first))
    return seen.where(gone).select("doc", "tk", "line")


def bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, tk, lost): for each text that loses lines, the words of 64 lines in which it does, with ones at lost lines."""
    # Dealt out by text alone, so that both groupings and the merge with the texts need no further shuffle.
    lost = lost_lines(docs, least).repartition("doc", "tk")
    words = lost.groupBy("doc", "tk", F.shiftright("line", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, line & 63))").alias("bits"))
    return words.groupBy("doc", "tk").agg(F.collect_list(F.struct("word", "bits")).alias("lost"))


def _with_bitmaps(docs: DataFrame, least: int) -> DataFrame:
    """docs with `_lost`: the bitmap of each text's lost lines, or null."""
    lost = bitmaps(docs, least).select(F.col("doc").alias("_doc"), F.col("tk").alias("_tk"), F.col("lost").alias("_lost"))
    keyed = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "_tk": text_key()})
    # Merged at every size: bitmaps grow with the documents, so sending them all to each task works for small tables only.
    return keyed.join(lost.hint("merge"), ["_doc", "_tk"], "left").drop("_doc", "_tk")


def _left(text: str | None, lost: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without its lost lines, how many lines it had and how many went."""
    lines = (text or "").split("\n")
    if lost is None:
        return text, len(lines), 0
    words = {x["word"]: x["bits"] for x in lost}
    kept = [x for i, x in enumerate(lines) if not words.get(i >> 6, 0) >> (i & 63) & 1]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _rewritten(names: list[str], counts: bool):
    def run(batches):
        for batch in pieces(batches):
            got = [_left(*x) for x in zip(batch.column("text").to_pylist(), batch.column("_lost").to_pylist(), strict=True)]
            columns = [pa.array([x[0] for x in got], pa.string()) if name == "text" else batch.column(name) for name in names]
            if counts:
                shas = [hashlib.sha256((x[0] or "").encode()).hexdigest() for x in got]
                columns += [pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(MADE if counts else ())])

    return run


MADE = ("n_lines", "n_dropped", "kept_sha256")


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All columns of docs with n_lines, n_dropped, kept_sha256 (those named like them are replaced), and text without the lines that go (null stays null)."""
    rows = docs.drop(*[c for c in docs.columns if c.lower() in MADE])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return _with_bitmaps(rows, least).mapInArrow(_rewritten(rows.columns, True), f"{schema}, n_lines long, n_dropped long, kept_sha256 string")


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, and text without the lines that go."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _with_bitmaps(docs, least).mapInArrow(_rewritten(docs.columns, False), schema)

"""Two-pass external shuffle of records into shards.

Pass one scatters records over memory-sized buckets by a seeded hash of doc_id; their number follows from
the bytes of the input. A bucket that repeated ids make larger than two is dealt out anew over as many as it needs, by
a hash of the record and, for equal records, of their place in the input. Pass two orders each bucket by doc_id and
text, draws a Fisher-Yates permutation seeded by the bucket, and numbers its records on from those of the buckets
before it. Record g of that order goes to slot g // shards of shard g % shards, so counts differ by one at most.

Defined results: a null text has no bytes and CRC 0; rows with a null or a repeated doc_id are rows of
their own; where a bucket is dealt out anew, equal records may change places if the input is split otherwise; an
empty table gives an empty result. Columns of the input are kept by write_shards(); those named like the new ones are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import MOST_TASKS, cut

BUCKET_BYTES = 8_000_000
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "bucket", "sub", "base", "scatter", "place")
#: Buckets whose counts are added up together.
ROW_OF_BUCKETS = 4096


def record_size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")


def _fisher_yates(seed: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending"), ("scatter", "ascending")])
        bucket, sub, base = (table.column(x)[0].as_py() for x in ("bucket", "sub", "base"))
        order = np.random.Generator(np.random.PCG64([seed, bucket, sub])).permutation(len(table))
        place = base + np.arange(len(table))
        out = table.take(pa.array(order)).drop_columns(["bucket", "sub", "base", "scatter"])
        return out.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))

    return run


def _bases(counts: DataFrame) -> DataFrame:
    """counts(bucket, sub, n) with `base`, the sum of n before: within rows of buckets, and over one number for each row."""
    counts = counts.withColumn("row", F.floor(F.col("bucket") / ROW_OF_BUCKETS))

    def before(order) -> Column:
        return F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")

    rows = counts.groupBy("row").agg(F.sum("n").alias("n"))
    rows = rows.select("row", before(Window.orderBy("row")).alias("first"))
    within = counts.withColumn("own", before(Window.partitionBy("row").orderBy("bucket", "sub")))
    return within.join(rows, "row").select("bucket", "sub", (F.col("first") + F.col("own")).alias("base"))


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs with size, text_crc32, shard and slot; one row for each row."""
    rows = docs.drop(*[c for c in docs.columns if c.lower() in MADE])
    key = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.col("doc_id").cast("long"))
    rows = rows.withColumns({"size": record_size(), "text_crc32": F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long"), "scatter": F.xxhash64(key, F.lit(seed))})
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod("scatter", F.lit(buckets)).cast("long"))
    counts = cut(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    large = cut(counts.where(F.col("bytes") > 2 * bucket_bytes).select("bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("subs")))
    if large.isEmpty():
        rows, counts = rows.withColumn("sub", F.lit(0).cast("long")), counts.withColumn("sub", F.lit(0).cast("long"))
    else:
        rows = rows.join(large, "bucket", "left")
        sub = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id(), F.lit(seed)), "subs")
        rows = cut(rows.withColumn("sub", F.coalesce(sub, F.lit(0)).cast("long")).drop("subs"))
        counts = rows.groupBy("bucket", "sub").agg(F.count("*").alias("n"))
    rows = rows.join(cut(_bases(counts)), ["bucket", "sub"]).repartition(int(min(buckets, MOST_TASKS)), "bucket", "sub")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("bucket", "sub", "base", "scatter"))
    return rows.groupBy("bucket", "sub").applyInArrow(_fisher_yates(seed, shards), f"{schema}, shard int, slot long")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write docs as Parquet, a folder for each shard; slot gives the order within it."""
    shuffled(docs, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)


def placement(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record that shuffled() moves."""
    moved = shuffled(docs, shards, seed)
    return moved.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

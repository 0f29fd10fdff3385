"""Tables between stages: written to the folder that all executors share, and groups of linked rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset and Spark runs on one machine, one of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_folioscope_dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
        found = sc._folioscope_dir = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    return found


def _made(spark: SparkSession) -> dict[str, None]:
    """Paths of the tables that cut() wrote and nothing has dropped yet."""
    sc = spark.sparkContext
    if not hasattr(sc, "_folioscope_made"):
        sc._folioscope_made = {}
    return sc._folioscope_made


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


#: Hadoop starts a program for the permission of each local file and folder that it makes, and until that program runs, the
#: executor's memory counts twice. Without checksum files a task starts two in place of three. Other stores don't heed this.
_NO_SIDE_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Lost executors then only repeat what comes after it. The table goes when the JVM ends, or with drop_cut() or drop_all_but().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope/{uuid.uuid4().hex}"
    df.write.options(compression=codec, **_NO_SIDE_FILES).parquet(path)
    fs, hadoop = _file_system(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    _made(spark)[path] = None
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    _drop(df.sparkSession, df._folioscope_path)


def _drop(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)
    fs.cancelDeleteOnExit(hadoop)
    _made(spark).pop(path, None)


def cuts_so_far(spark: SparkSession) -> set[str]:
    return set(_made(spark))


def drop_all_but(spark: SparkSession, before: set[str], kept: DataFrame) -> None:
    """Delete what cut() has written since `before` was taken by cuts_so_far(), but for the table `kept`."""
    for path in [p for p in _made(spark) if p not in before and p != kept._folioscope_path]:
        _drop(spark, path)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node reachable.

    Each round hooks every node onto its smallest neighbour, follows those hooks to their ends by
    doubling, and keeps only links between different ends, so at least half of the live nodes go.
    Only minima are grouped, so a node with very many links is aggregated before the shuffle.
    """
    live = cut(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = cut(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            drop_cut(hooks)
            hooks = jumped
            if hooks.where("moved").isEmpty():
                break
        ends = hooks.select("node", "root")
        if labels is None:
            labels = ends
        else:
            labels = cut(labels.join(ends.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        a, b = (ends.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        nxt = cut(live.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        drop_cut(live)
        live = nxt
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.select("node", "root")

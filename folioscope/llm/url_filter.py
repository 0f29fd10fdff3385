"""URL filter: a blocked Bloom filter in front of an exact join.

Rules list a host (with all its subdomains) and the beginning of a path. Every way in which a rule could be
written that fits a URL, a suffix of its host and a beginning of its path, is tested against a Bloom filter of
the canonical rules, whose bits for one key lie in one 512-bit block. Possible hits go to a hash join with the
rules, which removes false positives; of the rules that fit, the longest (host and path together) decides, and of
equally long ones that with the longer host. URLs that no rule fits are allowed.

The filter takes `bits_per_key` bits a rule up to `most_bytes`; beyond, it only lets more through to the join.
Defined results: a null URL or one without `://` has an empty host and path and fits no rule; equal URLs are
judged once; a rule given twice with both verdicts blocks; a rule without a host fits nothing; an empty list allows everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut

BITS_PER_KEY, MOST_BYTES = 16, 16_000_000
PROBES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where it has none."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of each key's probes: [keys, PROBES]."""
    h = h.astype(np.int64).view(_U)
    block = (h >> _U(20)) % _U(blocks)
    a, b = h & _U(511), (h >> _U(9)) & _U(511) | _U(1)
    bit = (a[:, None] + b[:, None] * np.arange(PROBES, dtype=_U)[None, :]) & _U(511)
    return (block[:, None] * _U(8) + (bit >> _U(6))).astype(np.int64), _U(1) << (bit & _U(63))


def bloom(keys: DataFrame, blocks: int) -> np.ndarray:
    """Words of the filter for keys(h). Each of at most blocks * 8 words comes back once."""

    @F.pandas_udf("array<struct<word:long,bits:long>>")
    def probes(h: pd.Series) -> pd.Series:
        word, bits = _places(h.to_numpy(), blocks)
        return pd.Series([[{"word": int(w), "bits": int(b)} for w, b in zip(x, y, strict=True)] for x, y in zip(word, bits.view(np.int64), strict=True)])

    words = keys.select(F.explode(probes("h")).alias("p")).groupBy("p.word").agg(F.bit_or("p.bits").alias("bits"))
    out = np.zeros(blocks * 8, _U)
    for r in words.toLocalIterator():
        out[r["word"]] = np.int64(r["bits"]).view(_U)
    return out


def judge(pages: DataFrame, rules: DataFrame, bits_per_key: int = BITS_PER_KEY, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(host, path, rule, verdict) for every different host and path of pages.url that a rule fits. A host is never empty here."""
    sc = pages.sparkSession.sparkContext
    host, path = url_parts(F.col("url").cast("string"))
    urls = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").distinct()
    # A null verdict or part makes no rule. Where one is listed with both verdicts, block wins.
    listed = rules.where("host <> '' and path is not null and verdict is not null").groupBy(F.concat("host", "path").alias("key"), F.length("host").alias("cut_at")).agg(F.max("verdict").alias("verdict"))
    h = F.xxhash64("key", "cut_at").alias("h")
    stats = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("key") - F.col("cut_at"))).alias("lengths")).first()
    blocks = max(1, min(most_bytes // 64, -(-stats["n"] * bits_per_key // 512)))
    shared = sc.broadcast(bloom(listed.select(h), blocks))

    @F.pandas_udf("array<boolean>")
    def possible(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes]) if sizes.sum() else np.zeros(0, np.int64)
        word, bits = _places(flat, blocks)
        hit = ((shared.value[word] & bits) == bits).all(axis=1)
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1])).map(list)

    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    begins = F.filter(F.array(*[F.lit(n) for n in stats["lengths"]]).cast("array<int>"), lambda n: n <= F.length("path"))
    ways = F.flatten(F.transform(ends, lambda e: F.transform(begins, lambda n: F.struct(F.concat(e, F.left("path", n)).alias("key"), F.length(e).alias("cut_at")))))
    tried = urls.withColumn("ways", ways).withColumn("hit", possible(F.transform("ways", lambda w: F.xxhash64(w["key"], w["cut_at"]))))
    hits = tried.select("host", "path", F.explode(F.filter(F.arrays_zip("ways", "hit"), lambda z: z["hit"])).alias("z")).select("host", "path", "z.ways.*")
    exact = hits.join(listed, ["key", "cut_at"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("size"), "cut_at", "key", "verdict")).alias("b"))
    return best.select("host", "path", F.col("b.key").alias("rule"), F.col("b.verdict").alias("verdict"))


def filtered(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    Only hosts and paths that a rule fits come back, as a table of their own, and URLs without a host don't look for them:
    so one busy host and path may hold any share of the rows, and its partition is split by adaptive execution.
    """
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = cut(judge(pages, rules))
    found = rows.where("host <> ''").join(ruled, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    return found.unionByName(rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))

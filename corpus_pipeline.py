"""A training corpus from raw documents: language, lines, near copies, benchmarks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontam_prefix, langid, line_dedup, simhash_vp, sp_tokens
from folioscope.llm.common import cut, cuts_so_far, drop_all_but


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier, trained on docs, is sure enough of."""
    return langid.accepted(docs, langid.train(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller doc_id holds; n_chars follows the text."""
    out = line_dedup.without_repeats(docs)
    return out.select(*[F.length("text").cast(f.dataType).alias("n_chars") if f.name == "n_chars" else F.col(f.name) for f in docs.schema])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document of smallest doc_id."""
    copies = simhash_vp.near_copies(docs, size=5, similarity=0.8).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam_prefix.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return sp_tokens.encode(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash", simhash_stage), ("decontamination", decontamination), ("sentencepiece", tokens)]

#: A model, fingerprints and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of the documents that all stages keep.

    Defined results, as of the stages: documents with a null or empty text, or without a letter, are rejected by the first
    stage; of rows with equal doc_id none is a near copy of another, and they keep their lines among themselves;
    extra columns of documents stay to the last stage; an empty table gives an empty result. What a stage read and wrote
    on its way is deleted once its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), cuts_so_far(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
            drop_all_but(spark, before, docs)
    return docs

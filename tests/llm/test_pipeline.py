"""The pipeline: each stage against what it must keep, and odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.llm import common
from tests.oracle import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] and sizes[4] == sizes[5]
    before = common.cuts_so_far(spark)
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]
    assert len(common.cuts_so_far(spark) - before) == 1  # what the last stage reads
    assert corpus_pipeline.run.__module__ == "corpus_pipeline" and sizes[-1] > 0.6 * sizes[0]


def _run(spark, folder, rows, schema, bench=((1, "a benchmark of ten words or more stands here for all to see"),)):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


WORDS = "the river runs slowly past old houses where people wait for spring and talk about ships that never came home again".split()


def test_odd_rows(spark, tmp_path):
    own = [" ".join(f"{w}{i}" for w in WORDS) for i in range(8)]
    rows = [
        (1, None, "en", "s", 5, 0, "x"), (2, "", None, None, None, 0, "x"), (3, "12 34", "en", "s", 5, 0, "x"), (None, own[0], "en", "s", 5, 0, "x"),
        (5, own[1], "en", "s", 5, 0, "x"), (5, own[1], "en", "s", 5, 0, "x"), (6, own[1] + " tail", "en", "s", 5, 0, "x"), (7, own[2] + "\n" + own[3], "en", "s", 5, 0, "x"),
        (8, own[4] + "\n" + own[3], "en", "s", 5, 0, "x"), (9, own[5] + " a benchmark of ten words or more stands here for all to see", "en", "s", 5, 0, "x"), (10, "long " * 60_000 + own[6], "en", "s", 5, 0, "x"),
    ]
    got = _run(spark, tmp_path, rows, "doc_id long, text string, lang string, source string, n_chars long, tk int, ids string").collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 5, 5, 7, 8, 10]
    # Document 8 lost the line that 7 holds.
    n = {r.doc_id: r.n_tokens for r in got}
    assert n[8] < 0.7 * n[7] and n[10] > 60_000 and all(len(r.ids) == r.n_tokens for r in got)


def test_empty_table(spark, tmp_path):
    assert _run(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long").count() == 0


def test_stages_keep_extra_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, " ".join(WORDS), "en", 1.5)], "doc_id long, text string, lang string, Score double")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "Score"] and docs.select(F.sum("Score")).first()[0] == 1.5

"""Every query that SQL can say, against DuckDB; the others give rows."""

import duckdb
import pytest

import folioscope.plans.analysis_queries
import folioscope.plans.library_queries
import folioscope.plans.text_queries  # noqa: F401
from folioscope.plans.registry import QUERIES, SQL
from tests.oracle import SF, duck, spark_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.fixture(scope="module")
def odd_documents(tmp_path_factory):
    """Summaries that hold no word of three letters, beyond 1900 characters or of three blocks, and generic ones."""
    texts = ["Ción ñta " * 280, "\n".join(["la le ch " * 30] * 10), "\n".join(f"Main meaning of the long line {i}: " + f"word{i} " * 90 for i in range(10)), "This section discusses the sea."]
    out = tmp_path_factory.mktemp("odd")
    duckdb.connect().execute(f"copy (select unnest(range(len($t))) as doc_id, unnest($t) as text) to '{out}/documents.parquet'", {"t": texts})
    return str(out)


@pytest.mark.parametrize("name", ["theme_summaries", "theme_hierarchy", "map_theme_texts"])
def test_equals_sql_on_odd_documents(spark, odd_documents, name):
    names, rows = spark_rows(QUERIES[name](spark, odd_documents))
    assert (names, rows) == duck(SQL[name], odd_documents) and len(rows) >= 8

"""The SQL text depends on nothing but the package."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.ml.feature import StopWordsRemover

from penmark.plans.oracle import sql_queries
from penmark.plans.queries import QUERIES
from penmark.sources.words import LANGUAGES, function_word_list

SF = "/root/testdata/sf0.001"


def test_sql_needs_no_spark_installation():
    code = (
        "import sys; sys.modules['glob'] = None; sys.modules['zipfile'] = None\n"
        "from penmark.plans.oracle import sql_queries; print(len(sql_queries()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) == len(sql_queries())


@pytest.mark.parametrize("lang", sorted(LANGUAGES))
def test_word_lists_equal_the_shipped_ones(spark, lang):
    assert function_word_list(lang) == StopWordsRemover.loadDefaultStopWords(LANGUAGES[lang])


def _kind(name: str) -> str:
    """DuckDB and Spark type names under one name."""
    name = name.lower().split("(")[0]
    return {"integer": "int", "varchar": "string", "long": "bigint", "hugeint": "bigint"}.get(name, name)


@pytest.mark.parametrize("name", sorted(sql_queries()))
def test_query_equals_its_sql(spark, name):
    """Same columns, types and values at the smallest scale."""
    from check import TABLES, _rows

    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = QUERIES[name](spark, SF)
    sql = sql_queries()[name]
    kinds = {row[0]: _kind(row[1]) for row in db.execute(f"DESCRIBE {sql}").fetchall()}
    want = db.execute(sql).fetchdf()
    assert sorted(frame.columns) == sorted(want.columns)
    assert _rows(frame.toPandas()) == _rows(want)
    assert {c: _kind(t) for c, t in frame.dtypes} == kinds

"""Every registered query against its SQL answer on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
ANSWERS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i] + 0.0 if isinstance(row[i], float) else row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_query_matches_sql(spark, duck, name):
    frame = queries()[name](spark, FOLDER)
    result = duck.execute(ANSWERS[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert canonical(frame.columns, frame.collect()) == canonical(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ANSWERS)))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0

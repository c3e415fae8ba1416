"""Every registered query against its SQL, as the gate compares them."""

import duckdb
import pytest

from __spark_entry__ import entry
from catalore.registry.duck_sql import oracle_sql
from catalore.registry.spark_queries import queries

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "BIGINT": "bigint", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DOUBLE": "double",
    "BOOLEAN": "boolean", "INTEGER": "int",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows(spark, duck, name):
    frame = queries()[name](spark, SF)
    relation = duck.sql(oracle_sql()[name])
    types = {n: KINDS[str(t)] for n, t in zip(relation.columns, relation.types)}
    assert types == {f.name: f.dataType.simpleString() for f in frame.schema}
    found = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert found == rows_of(relation.columns, relation.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 200

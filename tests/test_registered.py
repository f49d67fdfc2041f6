"""Every registered query against its SQL oracle."""

import math

import duckdb
import pytest

import __spark_entry__ as spark_entry
from millrace.plans.tools import TABLES

DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def duck(tables):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return f"{type(value).__name__}:{value}"


def canonical(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in values)


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_matches_oracle(spark, duck, tables, name):
    frame = spark_entry.queries()[name](spark, tables)
    expected = duck.sql(spark_entry.oracle_sql()[name])
    found = frame.collect()
    assert found, "no rows"
    kinds = {field.name: field.dataType.simpleString() for field in frame.schema}
    assert {n: DUCK_TYPES.get(k, k.upper()) for n, k in kinds.items()} == dict(
        zip(expected.columns, map(str, expected.types))
    )
    assert canonical(frame.columns, found) == canonical(expected.columns, expected.fetchall())


def test_every_query_has_an_oracle():
    for module in spark_entry.MODULES:
        if module.__name__.startswith("millrace.plans."):
            assert set(module.QUERIES) == set(module.ORACLES)


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["cluster_id", "project_id", "cost", "n_lines", "fan_out"]

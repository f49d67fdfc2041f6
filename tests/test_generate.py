import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from millrace.functions.distinct import (
    distinct_report,
    error_check,
    merged_estimate,
    sketch_cardinality,
    sketch_init_agg,
    sketch_size,
    sketches_by,
)
from millrace.operators.aggregates import distinct_row_count
from millrace.sources import generate


def test_wide_rows_first_row(spark):
    row = generate.wide_rows(spark, 2, 3).where("part_id = 1 AND val = 1").first().asDict()
    assert row["int_1"] == 21 and row["int_6"] == 2000000001 and row["long_6"] == 4500000001
    assert row["double_1"] == 2000000001 / 8 and row["double_2"] == 2000000001 / 10
    assert row["decimal_1"] == Decimal("20000000.01") and row["decimal_2"] == Decimal("0.34")
    assert row["str_1"] == row["str_4"] == "009d30980aa408f62a12e0e7e7acbd17"
    assert len(row) == 23


def test_every_value_once_per_part(spark):
    counts = generate.wide_rows(spark, 4, 5).groupBy("val").agg(F.count_distinct("part_id").alias("n"), F.count("*").alias("m"))
    assert sorted(tuple(r) for r in counts.collect()) == [(v, 4, 4) for v in range(5)]


def test_variants(spark):
    second = generate.wide_rows(spark, 1, 3, start=1, decimal_divisor=10)
    assert [r.val for r in second.orderBy("val").collect()] == [1, 2, 3]
    assert [r.decimal_1 for r in second.collect()] == [None] * 3
    assert second.first().decimal_2 == Decimal("3.40")
    named = generate.wide_rows(spark, 1, 1, start=1, number="value")
    assert named.first().value == 1 and named.first().int_1 == 21


def test_one_task_per_part_and_no_python(spark):
    df = generate.wide_rows(spark, 7, 10)
    assert df.rdd.getNumPartitions() == 7
    text = plan_text(df)
    assert "Range" in text and "Python" not in text and "Exchange" not in text


def test_physical_partition_id(spark):
    df = generate.with_partition_id(spark.range(0, 8, numPartitions=4))
    assert df.select("spark_partition_id").distinct().count() == 4


def test_number_and_time_series(spark):
    numbers = generate.number_series(spark, 1000)
    assert numbers.agg(F.min("num"), F.max("num"), F.count("*")).first() == (1, 1000, 1000)
    assert "Cartesian" not in plan_text(numbers) and "NestedLoop" not in plan_text(numbers)
    anchor = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:01'")
    series = generate.time_series(generate.number_series(spark, 2), anchor)
    assert [tuple(r) for r in series.orderBy("num").collect()] == [
        (1, dt.datetime(2024, 1, 1, 0, 0, 0), 2024, 1, 1),
        (2, dt.datetime(2023, 12, 31, 23, 59, 59), 2023, 12, 31),
    ]
    assert generate.time_series(numbers).where("tv > localtimestamp()").isEmpty()


def test_scalar_anchor_needs_no_join(spark, tables):
    events = spark.read.parquet(f"{tables}/events.parquet")
    series = generate.time_series(generate.number_series(spark, 10), events.agg(F.max("ts")).scalar())
    assert "Join" not in plan_text(series)


def test_uuid_columns_are_distinct(spark):
    ids = generate.uuid_columns(generate.number_series(spark, 500))
    assert ids.columns == ["num", "a", "b", "c", "d"]
    assert distinct_row_count(ids, "d").first()[0] == 500
    assert ids.where("length(a) = 36 AND a <> b").count() == 500


def test_neighbour_array(spark):
    assert generate.neighbour_array(spark.range(1), "id").first().secondary_ids == [1, 2, 3]


def test_sketch_sizes():
    assert [sketch_size(e) for e in (0.005, 0.02, 0.05, 0.1)] == [16, 12, 9, 7]


def test_distinct_report(spark):
    ids = spark.range(100000)
    for method in ("builtin", "sketch"):
        report = distinct_report(ids, "id", method=method, sketched=[0.005])
        row = report.first()
        assert row.exact == 100000
        assert abs(row.approx_default - 100000) < 15000 and abs(row.sketch_default - 100000) < 15000
        assert [str(e) for e in sorted(row.by_error)] == ["0.005", "0.020", "0.050", "0.100"]
        checks = error_check(report).collect()
        assert len(checks) == 6 and all(r.within_bound and r.estimated for r in checks)


def test_the_column_is_read_once(spark, tables):
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    for method in ("builtin", "sketch"):
        report = distinct_report(orders, "o_custkey", method=method, sketched=[0.005])
        report.collect()
        final = plan_text(report).split("Initial Plan")[0]
        by_value = [line for line in plan_text(report).splitlines() if "Aggregate(keys=[o_custkey" in line]
        assert by_value and all("functions=[]" in line for line in by_value)
        assert "ReusedExchange" in plan_text(report) or final.count("FileScan parquet") == 1


def test_errors_are_as_asked_or_refused(spark):
    with pytest.raises(ValueError):
        sketch_size(0.0001)
    report = distinct_report(spark.range(100), "id", errors=[0.3], method="builtin").first()
    assert report.exact == 100 and list(report.by_error) == [Decimal("0.300")]


def test_sketch_wrappers(spark):
    ids = spark.range(1000)
    estimate = ids.agg(sketch_cardinality(sketch_init_agg("id", 0.02)).alias("n")).first().n
    assert abs(estimate - 1000) < 60


def test_wide_rows_of_large_keys(spark):
    """Keys are numbered within their part, so the largest offset of an INT column still fits."""
    keys = spark.createDataFrame([(0,), (199_999_999,), (200_000_000,), (5_000_000_001,)], "k BIGINT")
    found = generate.wide_rows_of(keys, "k", 1_000_000, start=1).orderBy("long_1", "part_id")
    assert [(r.part_id, r.val, r.int_6) for r in found.orderBy("part_id").collect()] == [
        (1, 1, 2000000001), (200, 1000000, 2001000000), (201, 1, 2000000001), (5001, 2, 2000000002)
    ]


def test_stored_sketches_answer_for_any_period(spark, tmp_path):
    path = str(tmp_path / "sketches")
    seen = spark.range(40000).selectExpr("CAST(id % 10 AS INT) AS day", "id % 7000 AS user", "id AS n")
    sketches_by(seen, ["day"], "user", 0.02).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 10
    for days in ([3], [1, 2, 5], list(range(10))):
        row = merged_estimate(stored.where(F.col("day").isin(days))).first()
        wanted = seen.where(F.col("day").isin(days))
        exact = wanted.select("user").distinct().count()
        assert row.n_rows == wanted.count() and abs(row.estimate - exact) <= 0.06 * exact
    assert tuple(merged_estimate(stored.where("day > 99")).first()) == (0, 0)
    assert merged_estimate(stored, ["day"]).count() == 10

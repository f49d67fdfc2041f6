"""Generators. ``spark.range`` supplies the rows, so they are split over all tasks and
no Python worker is started."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import date_parts, md5_of_int

# Offsets added to the running number, by column.
INT_OFFSETS = {
    "int_1": 20,
    "int_2": 30,
    "int_3": 33,
    "int_4": 37,
    "int_5": 1000000000,
    "int_6": 2000000000,
}
LONG_OFFSETS = {
    "long_1": 3000000000,
    "long_2": 4100000000,
    "long_3": 4200000000,
    "long_4": 4300000000,
    "long_5": 4400000000,
    "long_6": 4500000000,
}
DOUBLE_SOURCES = {"double_1": ("int_6", 8), "double_2": ("int_6", 10)}
DECIMAL_SOURCES = {"decimal_1": "int_6", "decimal_2": "int_3", "decimal_3": "int_2"}
TEXT_COLUMNS = ("str_1", "str_2", "str_3", "str_4")


def number_series(spark: SparkSession, count: int, partitions: int | None = None) -> DataFrame:
    """``num`` = 1..count."""
    return spark.range(1, count + 1, numPartitions=partitions).toDF("num")


def time_series(numbers: DataFrame, anchor: Column | None = None) -> DataFrame:
    """``num`` seconds before the anchor, with year, month and day.

    The anchor is a literal or a scalar subquery; without one it is the current time.
    """
    start = F.localtimestamp() if anchor is None else anchor
    moments = numbers.select("num", (start - F.make_dt_interval(secs=F.col("num"))).alias("tv"))
    return moments.select("num", "tv", *date_parts(F.col("tv"), "tv"))


def uuid_columns(df: DataFrame, names: tuple[str, ...] = ("a", "b", "c", "d")) -> DataFrame:
    """Random identifiers, one per row and column. Spark fixes their seed when the query is
    analysed, so a task that runs again gives the same values."""
    return df.select("*", *[F.expr("uuid()").alias(name) for name in names])


def wide_columns(df: DataFrame, decimal_divisor: int = 100, number: str = "val") -> DataFrame:
    """Add the 21 derived columns of the wide table to a frame with an INT running number.

    All are inlined over the number, so one projection computes them. With divisor 10 the
    first decimal does not fit DECIMAL(10,2) and becomes NULL. The number must leave room
    for the largest INT offset (below 147,483,648).
    """
    base = F.col(number)
    ints = {name: base + F.lit(offset) for name, offset in INT_OFFSETS.items()}
    longs = {name: base + F.lit(offset).cast("bigint") for name, offset in LONG_OFFSETS.items()}
    doubles = {name: (ints[source] / F.lit(by)).cast("double") for name, (source, by) in DOUBLE_SOURCES.items()}
    decimals = {name: _decimal_or_null(ints[source] / F.lit(decimal_divisor)) for name, source in DECIMAL_SOURCES.items()}
    digest = md5_of_int(ints["int_1"])
    texts = {name: digest for name in TEXT_COLUMNS}
    derived = {**ints, **longs, **doubles, **decimals, **texts}
    return df.select("*", *[column.alias(name) for name, column in derived.items()])


def _decimal_or_null(value: Column) -> Column:
    """DOUBLE -> DECIMAL(10,2), NULL where it does not fit. The bound is tested first, as
    ``try_cast`` raises and catches an exception for each value out of range."""
    return F.when(F.abs(value) < 99_999_999.995, value).cast("decimal(10,2)")


def wide_rows(
    spark: SparkSession,
    parts: int,
    rows_per_part: int,
    start: int = 0,
    decimal_divisor: int = 100,
    number: str = "val",
) -> DataFrame:
    """The wide table: ``rows_per_part`` running numbers from ``start``, once per part.

    One task makes one part. ``part_id`` (1..parts) is computed from the row, unlike a
    physical partition number, and so is the same after a retry.
    """
    rows = spark.range(0, parts * rows_per_part, numPartitions=parts)
    numbered = rows.select(
        (F.expr(f"id div {rows_per_part}") + 1).cast("int").alias("part_id"),
        (F.col("id") % rows_per_part + start).cast("int").alias(number),
    )
    return wide_columns(numbered, decimal_divisor, number)


def wide_rows_of(
    df: DataFrame,
    key: str,
    rows_per_part: int,
    start: int = 0,
    decimal_divisor: int = 100,
    number: str = "val",
    tasks: int | None = None,
) -> DataFrame:
    """The wide table over the keys of a table, which are running numbers from 0: one row for
    each of its rows, in parts of ``rows_per_part`` keys, numbered from ``start`` in each part, so that
    keys of any size fit. ``tasks`` deals the keys, which are small, to that many tasks before
    they become wide rows, which are not."""
    keys = df.select(key) if tasks is None else df.select(key).repartition(tasks)
    numbered = keys.select(
        (F.floor(F.col(key) / rows_per_part) + 1).cast("int").alias("part_id"),
        (F.col(key) % rows_per_part + start).cast("int").alias(number),
    )
    return wide_columns(numbered, decimal_divisor, number)


def numbers_from(df: DataFrame, key: str, count: Column) -> DataFrame:
    """``num``: for each row the ``count`` numbers (a small one) that follow its key."""
    return df.select(F.explode(F.sequence(F.col(key) + 1, F.col(key) + count)).alias("num"))


def with_partition_id(df: DataFrame, name: str = "spark_partition_id") -> DataFrame:
    """Add the number of the physical partition a row is in. Not stable across runs."""
    return df.withColumn(name, F.spark_partition_id())


def neighbour_array(df: DataFrame, number: str, count: int = 3, name: str = "secondary_ids") -> DataFrame:
    """Add an array of the ``count`` numbers that follow."""
    return df.withColumn(name, F.array(*[F.col(number) + step for step in range(1, count + 1)]))

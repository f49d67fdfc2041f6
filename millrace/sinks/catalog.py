"""Databases, tables, views and partition registration."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sinks.partitions import clustered


def create_database(spark: SparkSession, name: str, path: str) -> str:
    """Create a database whose managed tables live under ``path``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{path}'")
    return name


def use_database(spark: SparkSession, name: str) -> None:
    """Make a database the current one."""
    spark.sql(f"USE {name}")


def list_databases(spark: SparkSession) -> DataFrame:
    """Names of the databases in the catalog."""
    return spark.sql("SHOW DATABASES").toDF("name")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Names of the tables and views of a database."""
    return spark.sql(f"SHOW TABLES IN {database}").where(~F.col("isTemporary")).select(F.col("tableName").alias("name"))


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table if it exists."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_view(spark: SparkSession, name: str, query: str) -> str:
    """Create or replace a catalog view. Views may use other views."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
    return name


def create_series_views(spark: SparkSession, database: str, count: int = 1_000_000_000) -> list[str]:
    """Three views: numbers 0..999, numbers 1..count, and the second ones as seconds before
    now with date parts and four random identifiers per row.

    The numbers come from ``range``, which Spark splits over tasks; the same rows as a
    three-way product of the first view when ``count`` is 1000 ** 3.
    """
    thousand = create_view(spark, f"{database}.numbers_1k", "SELECT id AS num FROM range(0, 1000)")
    numbers = create_view(spark, f"{database}.numbers", f"SELECT id AS num FROM range(1, {count + 1})")
    dated = [f"{part}(tv) AS tv_{part}" for part in ("year", "month", "day")]
    random = [f"uuid() AS {name}" for name in ("a", "b", "c", "d")]
    times = f"SELECT num, now() - make_dt_interval(0, 0, 0, num) AS tv FROM {numbers}"
    moments = create_view(spark, f"{database}.uuid_series", f"SELECT {', '.join(['num', 'tv', *dated, *random])} FROM ({times})")
    return [thousand, numbers, moments]


def create_table_as(
    spark: SparkSession, name: str, df: DataFrame, path: str | None = None, file_format: str = "parquet"
) -> DataFrame:
    """CREATE TABLE … AS SELECT; returns the new table."""
    writer = df.write.format(file_format).mode("errorifexists")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return spark.table(name)


def create_partitioned_table(
    spark: SparkSession,
    name: str,
    columns: str,
    partition_columns: Sequence[str],
    path: str,
    file_format: str = "parquet",
) -> str:
    """An empty table; the partition columns are among the declared ones."""
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING {file_format} "
        f"PARTITIONED BY ({', '.join(partition_columns)}) LOCATION '{path}'"
    )
    return name


def insert_rows(
    df: DataFrame, name: str, cluster_by: Sequence[str] = (), tasks: int | None = None, spread: int = 1
) -> DataFrame:
    """INSERT INTO … SELECT, columns matched by name. ``cluster_by`` gathers rows of a
    partition before the write, as ``clustered`` does. Returns the table."""
    table = df.sparkSession.table(name)
    rows = df.select(*table.columns)
    if cluster_by:
        rows = clustered(rows, cluster_by, tasks, spread)
    rows.write.insertInto(name)
    return df.sparkSession.table(name)


def insert_values(spark: SparkSession, name: str, rows: Sequence[tuple]) -> DataFrame:
    """INSERT INTO … VALUES for a few literal rows."""
    table = spark.table(name)
    spark.createDataFrame(list(rows), table.schema).write.insertInto(name)
    return spark.table(name)


def register_partitions(spark: SparkSession, name: str) -> DataFrame:
    """Add partition directories that were loaded without the catalog, and list them.

    Spark adds them in batches of ``spark.sql.addPartitionInBatch.size``.
    """
    spark.catalog.recoverPartitions(name)
    return spark.sql(f"SHOW PARTITIONS {name}")


def missing_partitions(spark: SparkSession, name: str, path: str, keys: Sequence[str]) -> DataFrame:
    """``spec``, one row for each partition folder under ``path`` that the table does not know.

    Both sides are listings of names, the folders' and the catalog's; no file is opened.
    """
    inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(inference)
    spark.conf.set(inference, "false")  # folder names as they are
    try:
        listed = spark.read.format("binaryFile").load(path)
    finally:
        spark.conf.set(inference, before)
    folders = listed.select(*keys).distinct()
    known = spark.sql(f"SHOW PARTITIONS {name}").select(F.split("partition", "/").alias("parts"))
    values = [F.element_at("parts", place) for place in range(1, len(keys) + 1)]
    stored = known.select(*[_unescaped(F.substr(value, F.length(F.lit(key)) + 2)).alias(key) for key, value in zip(keys, values)])
    return folders.join(stored, list(keys), "left_anti").orderBy(*keys)


def _unescaped(text: Column) -> Column:
    """A value of a partition name, in which special characters are %XX. A plus sign is itself."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def add_missing_partitions(
    spark: SparkSession, name: str, path: str, keys: Sequence[str], log: str, batch: int = 1000, limit: int | None = None
) -> int:
    """Register the partitions that are under ``path`` and not in the catalog, ``batch`` at a time;
    returns how many batches were added. ``limit`` ends after so many.

    Every batch is one statement, so it is in the catalog whole or not at all, and leaves the two
    log lines that ``diagnostics.registration_batches`` reads in the text dataset ``log``. A run that breaks off has
    registered its batches; the next one finds only the others missing. Names come to the driver
    batch by batch.
    """
    names = [F.col(f"`{key}`") for key in keys]
    done, held = 0, []
    missing = missing_partitions(spark, name, path, keys).select(*names)

    def add(rows: list) -> None:
        specs = [", ".join(f"`{key}` = {_literal(row[key])}" for key in keys) for row in rows]
        begin = time.monotonic_ns()
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION ({spec})" for spec in specs))
        spent = (time.monotonic_ns() - begin) // 1_000_000
        lines = [f"total partitions to be created: {len(rows)}", f"total method time: {spent}, push=0, fetch=0, addParts={spent}"]
        spark.createDataFrame([(line,) for line in lines], "value STRING").coalesce(1).write.mode("append").text(log)

    for row in missing.toLocalIterator():
        held.append(row)
        if len(held) == batch:
            add(held)
            done, held = done + 1, []
            if done == limit:
                return done
    if held:
        add(held)
        done += 1
    return done


def _literal(value: str | None) -> str:
    if value is None:
        return "NULL"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"

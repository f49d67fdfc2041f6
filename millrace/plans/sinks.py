"""Datasets written and read back: codecs, formats, partition conflicts, layouts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.diagnostics import dataset_inventory, registration_batches
from millrace.plans.series import ROWS_PER_PART, orders_by_day, wide_datagen
from millrace.plans.tools import catalog_name, database, file_tasks
from millrace.sinks.catalog import (
    add_missing_partitions,
    create_view,
    insert_rows,
    insert_values,
    list_databases,
    list_tables,
    register_partitions,
    use_database,
)
from millrace.sinks.files import append, content_sums, overwrite, recompress, write_csv, write_once
from millrace.sinks.partitions import PartitionConflict, conflicting_partitions, write_partitions
from millrace.sources.tables import external_table, read_csv, read_glob, table
from millrace.workspace import fresh_path


def _line_sums(lines: DataFrame) -> DataFrame:
    sums = content_sums(
        lines,
        {
            "order_sum": F.col("l_orderkey"),
            "part_sum": F.col("l_partkey"),
            "price_sum": F.col("l_extendedprice").cast("decimal(18,2)"),
            "flag_sum": F.ascii("l_returnflag").cast("bigint"),
        },
    )
    return sums.withColumn("price_sum", F.col("price_sum").cast("decimal(28,2)"))


def wide_write(spark: SparkSession, directory: str) -> DataFrame:
    """The wide table written with gzip, then summed from the files."""
    path = overwrite(wide_datagen(spark, directory), fresh_path(spark, "wide"), codec="gzip")
    columns = {name: F.col(name) for name in ("int_6", "long_6", "decimal_1", "decimal_3")}
    sums = content_sums(spark.read.parquet(path), columns)
    return sums.select("n_rows", "int_6", "long_6", *[F.col(d).cast("decimal(28,2)").alias(d) for d in ("decimal_1", "decimal_3")])


def recompress_copy(spark: SparkSession, directory: str) -> DataFrame:
    """Two copies: each scan task writes what it read, and the rows dealt out to four files."""
    source = f"{directory}/lineitem.parquet"
    plain = read_glob(spark, recompress(spark, source, fresh_path(spark, "gzip")), "part-*")
    dealt = read_glob(spark, recompress(spark, source, fresh_path(spark, "gzip"), files=4), "part-*")
    files = dealt.agg(F.count_distinct(F.col("_metadata.file_path"))).scalar()
    return _line_sums(plain).withColumn("files", F.lit(None).cast("bigint")).unionByName(_line_sums(dealt).withColumn("files", files))


def overwrite_copy(spark: SparkSession, directory: str) -> DataFrame:
    """Write, append the same rows, then overwrite the whole directory: one copy is left."""
    lines = table(spark, directory, "lineitem")
    path = write_once(lines, fresh_path(spark, "lines"))
    append(lines, path)
    overwrite(lines, path)
    return _line_sums(spark.read.parquet(path))


def append_copy(spark: SparkSession, directory: str) -> DataFrame:
    """The same rows written once and appended once: every row is there twice."""
    lines = table(spark, directory, "lineitem")
    path = write_once(lines, fresh_path(spark, "lines"))
    append(lines, path)
    return _line_sums(spark.read.parquet(path))


def _stored_and_incoming(spark: SparkSession, directory: str) -> tuple[str, DataFrame]:
    """Orders up to 1998 are stored by year; orders from 1998 on come in: 1998 overlaps."""
    orders = orders_by_day(spark, directory).select("o_orderkey", "o_totalprice", "o_year")
    path = write_partitions(orders.where("o_year <= 1998"), fresh_path(spark, "orders"), ["o_year"], "append")
    return path, orders.where("o_year >= 1998")


def _by_year(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema("o_orderkey BIGINT, o_totalprice DOUBLE, o_year INT").parquet(path)
    return stored.groupBy("o_year").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def partition_fail(spark: SparkSession, directory: str) -> DataFrame:
    """The partitions that make mode ``fail`` stop, and that it wrote none of the others."""
    path, incoming = _stored_and_incoming(spark, directory)
    try:
        write_partitions(incoming, path, ["o_year"], "fail")
        refused = False
    except PartitionConflict:
        refused = True
    years = _by_year(spark, path).agg(F.max("o_year")).scalar()
    conflicts = conflicting_partitions(incoming, path, ["o_year"])
    return conflicts.select("o_year", F.lit(refused).alias("refused"), years.alias("last_stored"))


def partition_replace(spark: SparkSession, directory: str) -> DataFrame:
    path, incoming = _stored_and_incoming(spark, directory)
    return _by_year(spark, write_partitions(incoming, path, ["o_year"], "replace"))


def partition_append(spark: SparkSession, directory: str) -> DataFrame:
    path, incoming = _stored_and_incoming(spark, directory)
    return _by_year(spark, write_partitions(incoming, path, ["o_year"], "append"))


def partition_race(spark: SparkSession, directory: str) -> DataFrame:
    """Two writers bring the same orders by year at the same time, in mode ``fail`` and with claims:
    one is refused and has written nothing."""
    orders = orders_by_day(spark, directory).select("o_orderkey", "o_totalprice", "o_year")
    path = fresh_path(spark, "orders")

    def write(_: int) -> bool:
        try:
            write_partitions(orders, path, ["o_year"], "fail", exclusive=True)
            return False
        except PartitionConflict:
            return True

    with ThreadPoolExecutor(2) as pool:
        refused = sum(pool.map(write, range(2)))
    return _by_year(spark, path).withColumn("refused", F.lit(refused).cast("bigint"))


def batched_registration(spark: SparkSession, directory: str) -> DataFrame:
    """Orders by day, written as plain files, registered in batches: a first run is broken off after two
    batches, a second one goes on. Statistics of the batches, from their log lines."""
    orders = table(spark, directory, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("o_day"))
    path = write_partitions(orders, fresh_path(spark, "orders"), ["o_day"], "append", tasks=file_tasks(spark))
    name, log = catalog_name(spark, "daily"), fresh_path(spark, "registration")
    external_table(spark, name, "o_orderkey BIGINT, o_day STRING", path, partitioned_by="o_day")
    add_missing_partitions(spark, name, path, ["o_day"], log, batch=REGISTERED, limit=2)
    add_missing_partitions(spark, name, path, ["o_day"], log, batch=REGISTERED)
    batches = registration_batches(spark.read.text(log)).select("batches", "partitions", "n_other")
    loaded = spark.table(name).agg(F.count("*").alias("n_rows"), F.count_distinct("o_day").alias("n_days"))
    return batches.join(loaded)


# Partitions of a batch.
REGISTERED = 500


def catalog_views(spark: SparkSession, directory: str) -> DataFrame:
    """A table over the orders' file, a view of it and a view of that view, in the database in use, counted
    by bare names; with whether database and views are listed."""
    current, name = spark.catalog.currentDatabase(), database(spark)
    base, dated, yearly = (catalog_name(spark, label).split(".")[1] for label in ("orders", "dated", "yearly"))
    external_table(spark, f"{name}.{base}", None, f"{directory}/orders.parquet")
    use_database(spark, name)
    try:
        create_view(spark, dated, f"SELECT o_orderkey, o_totalprice, YEAR(o_orderdate) AS o_year FROM {base}")
        create_view(spark, yearly, f"SELECT o_year, COUNT(*) AS n, SUM(o_orderkey) AS key_sum FROM {dated} GROUP BY o_year")
        tables = list_tables(spark, name).where(F.col("name").isin(dated, yearly)).agg(F.count("*")).scalar()
        databases = list_databases(spark).where(F.col("name") == name).agg(F.count("*")).scalar()
        return spark.table(yearly).select("*", tables.alias("n_views"), databases.alias("n_databases"))
    finally:
        use_database(spark, current)


def partition_registration(spark: SparkSession, directory: str) -> DataFrame:
    """Partitions loaded as plain files become visible in the catalog once registered."""
    orders = orders_by_day(spark, directory).select("o_orderkey", "o_year", "o_month")
    path = write_partitions(orders, fresh_path(spark, "orders"), ["o_year", "o_month"])
    name = catalog_name(spark, "loaded")
    external_table(spark, name, "o_orderkey BIGINT, o_year INT, o_month INT", path, partitioned_by="o_year, o_month")
    return register_partitions(spark, name)


def partition_inventory(spark: SparkSession, directory: str) -> DataFrame:
    orders = orders_by_day(spark, directory).select("o_orderkey", "o_year")
    path = write_partitions(orders, fresh_path(spark, "orders"), ["o_year"])
    layout = dataset_inventory(spark, path, ["o_year"])
    return layout.select("o_year", "n_rows", (F.col("n_files") >= 1).alias("has_files"), (F.col("n_bytes") > 0).alias("has_bytes"))


def csv_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    customers = table(spark, directory, "customer")
    path = write_csv(customers, fresh_path(spark, "customers"))
    return read_csv(spark, path, customers.schema)


def orc_varchar_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    name = catalog_name(spark, "customers")
    spark.sql(f"CREATE TABLE {name} (a BIGINT NOT NULL, b VARCHAR(100)) USING orc")
    rows = table(spark, directory, "customer").select(F.col("c_custkey").alias("a"), F.col("c_name").alias("b"))
    insert_rows(rows, name)
    return insert_values(spark, name, VALUES)


# Rows that are inserted as values.
VALUES = [(-1, "One"), (-2, "Two"), (-3, None)]

QUERIES = {
    "wide_write": wide_write,
    "recompress_copy": recompress_copy,
    "overwrite_copy": overwrite_copy,
    "append_copy": append_copy,
    "partition_fail": partition_fail,
    "partition_replace": partition_replace,
    "partition_append": partition_append,
    "partition_race": partition_race,
    "partition_registration": partition_registration,
    "batched_registration": batched_registration,
    "catalog_views": catalog_views,
    "partition_inventory": partition_inventory,
    "csv_roundtrip": csv_roundtrip,
    "orc_varchar_roundtrip": orc_varchar_roundtrip,
}


def _line_sums_sql(times: int) -> str:
    return f"""
        SELECT {times} * COUNT(*) AS n_rows, CAST({times} * SUM(l_orderkey) AS BIGINT) AS order_sum,
               CAST({times} * SUM(l_partkey) AS BIGINT) AS part_sum,
               CAST({times} * SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS price_sum,
               CAST({times} * SUM(ascii(l_returnflag)) AS BIGINT) AS flag_sum
        FROM lineitem"""


def _by_year_sql(times_1998: int) -> str:
    return f"""
        SELECT o_year, COUNT(*) * MAX(times) AS n, CAST(SUM(o_orderkey) * MAX(times) AS BIGINT) AS key_sum
        FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_year,
                     CASE WHEN year(o_orderdate) = 1998 THEN {times_1998} ELSE 1 END AS times
              FROM orders) x
        GROUP BY o_year"""


ORACLES = {
    "wide_write": f"""
        SELECT COUNT(*) AS n_rows, CAST(SUM(val + 2000000000) AS BIGINT) AS int_6,
               CAST(SUM(val + 4500000000) AS BIGINT) AS long_6,
               CAST(SUM(CAST((val + 2000000000) / 100 AS DECIMAL(10,2))) AS DECIMAL(28,2)) AS decimal_1,
               CAST(SUM(CAST((val + 30) / 100 AS DECIMAL(10,2))) AS DECIMAL(28,2)) AS decimal_3
        FROM (SELECT l_orderkey % {ROWS_PER_PART} AS val FROM lineitem) v""",
    "recompress_copy": f"""
        SELECT *, CAST(NULL AS BIGINT) AS files FROM ({_line_sums_sql(1)}) a
        UNION ALL SELECT *, CAST(4 AS BIGINT) FROM ({_line_sums_sql(1)}) b""",
    "overwrite_copy": _line_sums_sql(1),
    "append_copy": _line_sums_sql(2),
    "partition_fail": """
        SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS o_year, TRUE AS refused, CAST(1998 AS INTEGER) AS last_stored
        FROM orders WHERE year(o_orderdate) = 1998""",
    "partition_replace": _by_year_sql(1),
    "partition_append": _by_year_sql(2),
    "partition_race": f"SELECT *, CAST(1 AS BIGINT) AS refused FROM ({_by_year_sql(1)}) y",
    "batched_registration": f"""
        SELECT CASE WHEN days <= 2 * {REGISTERED} THEN ceil(days / {REGISTERED}) ELSE 2 + ceil((days - 2 * {REGISTERED}) / {REGISTERED}) END::BIGINT AS batches,
               days AS partitions, CAST(0 AS BIGINT) AS n_other, n_rows, days AS n_days
        FROM (SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) + MAX((o_orderdate IS NULL)::INT) AS days, COUNT(*) AS n_rows FROM orders) x""",
    "catalog_views": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS key_sum,
               CAST(2 AS BIGINT) AS n_views, CAST(1 AS BIGINT) AS n_databases
        FROM orders GROUP BY 1""",
    "partition_registration": """
        SELECT DISTINCT 'o_year=' || year(o_orderdate) || '/o_month=' || month(o_orderdate) AS partition
        FROM orders""",
    "partition_inventory": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, COUNT(*) AS n_rows, TRUE AS has_files,
               TRUE AS has_bytes
        FROM orders GROUP BY 1""",
    "csv_roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "orc_varchar_roundtrip": "SELECT c_custkey AS a, c_name AS b FROM customer UNION ALL VALUES "
    + ", ".join(f"({a}, {'NULL' if b is None else repr(b)})" for a, b in VALUES),
}

"""Interactive SQL: limits, counts, sums, top-k, declared tables, filtered export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import date_parts, timestamp_text
from millrace.operators import aggregates
from millrace.plans.tools import TABLES, catalog_name, directory_database
from millrace.sinks.catalog import create_table_as, list_tables
from millrace.sources.tables import external_table, first_rows, table, temp_views

STORED_LINE_COLUMNS = """
    l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
    l_returnflag BINARY, l_linestatus STRING
"""


def scan_limit(spark: SparkSession, directory: str) -> DataFrame:
    """Which rows a limit without an order gives is undefined; their number is not, nor that all
    of them are in the table. The rows are few, and so are sent to the table instead of moving it."""
    path = f"{directory}/lineitem.parquet"
    some = spark.createDataFrame(first_rows(spark, path, 100).toArrow())
    lines = table(spark, directory, "lineitem")
    same = [F.col(f"l.`{name}`").eqNullSafe(F.col(f"s.`{name}`")) for name in lines.columns]
    known = lines.alias("l").join(F.broadcast(some.distinct().alias("s")), reduce(Column.__and__, same)).select("s.*").distinct()
    strangers = some.distinct().exceptAll(known)
    return aggregates.row_count(some).withColumn("strangers", aggregates.row_count(strangers).scalar())


def scan_limit_count(spark: SparkSession, directory: str) -> DataFrame:
    return aggregates.row_count(first_rows(spark, f"{directory}/lineitem.parquet", 100))


def count_all(spark: SparkSession, directory: str) -> DataFrame:
    return aggregates.row_count(table(spark, directory, "lineitem"))


def external_table_scan(spark: SparkSession, directory: str) -> DataFrame:
    """A declared table over the file: fewer columns, one text column declared as BINARY."""
    path = f"{directory}/lineitem.parquet"
    declared = external_table(spark, catalog_name(spark, "lines"), STORED_LINE_COLUMNS, path)
    return declared.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.col("l_quantity").cast("decimal(10,2)").alias("quantity"),
        F.hex("l_returnflag").alias("flag_hex"),
        "l_linestatus",
    )


def topk_count(spark: SparkSession, directory: str) -> DataFrame:
    return aggregates.top_keys(table(spark, directory, "lineitem"), "l_partkey", 10)


def topk_sql(spark: SparkSession, directory: str) -> DataFrame:
    """The same report as a user types it, over a temporary view."""
    (lines,) = temp_views(spark, directory, ["lineitem"], "millrace_")
    return spark.sql(f"""
        SELECT l_suppkey, COUNT(*) AS n FROM {lines} GROUP BY l_suppkey
        ORDER BY COUNT(*) DESC, l_suppkey LIMIT 10""")


def sum_by_key(spark: SparkSession, directory: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    sums = aggregates.sum_by_key(table(spark, directory, "lineitem"), "l_suppkey", price, "total")
    return sums.select("l_suppkey", F.col("total").cast("decimal(28,2)").alias("total"))


def distinct_count(spark: SparkSession, directory: str) -> DataFrame:
    return aggregates.distinct_row_count(table(spark, directory, "lineitem"), "l_partkey")


def ctas_rename(spark: SparkSession, directory: str) -> DataFrame:
    renamed = table(spark, directory, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_returnflag").alias("b"))
    return create_table_as(spark, catalog_name(spark, "renamed"), renamed)


def export_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of one month and one first character, time as text: what goes out over JDBC.

    The month is a range of the stored column and the first character a prefix, so both
    reach the Parquet scan, which functions of the columns would not.
    """
    events = table(spark, directory, "events")
    start, end = F.expr("TIMESTAMP_NTZ '2024-01-01'"), F.expr("TIMESTAMP_NTZ '2024-02-01'")
    wanted = events.where((F.col("ts") >= start) & (F.col("ts") < end) & F.col("event_type").startswith("p"))
    return wanted.select(
        "event_id",
        timestamp_text(F.col("ts")).alias("tv"),
        "user_id",
        "event_type",
        "props",
        *date_parts(F.col("ts"), "tv"),
    )


def catalog_list(spark: SparkSession, directory: str) -> DataFrame:
    """Declare every table of the directory in the catalog, list the database, count the rows."""
    name = directory_database(spark, directory)
    counts = []
    for entry in TABLES:
        stored = external_table(spark, f"{name}.{entry}", None, f"{directory}/{entry}.parquet")
        counts.append(stored.agg(F.lit(entry).alias("name"), F.count("*").alias("n_rows")))
    rows = counts[0]
    for other in counts[1:]:
        rows = rows.unionByName(other)
    return list_tables(spark, name).join(rows, "name")


QUERIES = {
    "scan_limit": scan_limit,
    "scan_limit_count": scan_limit_count,
    "count_all": count_all,
    "external_table_scan": external_table_scan,
    "topk_count": topk_count,
    "topk_sql": topk_sql,
    "sum_by_key": sum_by_key,
    "distinct_count": distinct_count,
    "ctas_rename": ctas_rename,
    "filtered_export": export_rows,
    "catalog_list": catalog_list,
}

ORACLES = {
    "scan_limit": "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS strangers FROM (SELECT * FROM lineitem LIMIT 100) x",
    "scan_limit_count": "SELECT COUNT(*) AS n FROM (SELECT * FROM lineitem LIMIT 100) x",
    "count_all": "SELECT COUNT(*) AS n FROM lineitem",
    "external_table_scan": """
        SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS DECIMAL(10,2)) AS quantity,
               hex(l_returnflag) AS flag_hex, l_linestatus
        FROM lineitem""",
    "topk_count": """
        SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey
        ORDER BY n DESC, l_partkey LIMIT 10""",
    "topk_sql": """
        SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey
        ORDER BY n DESC, l_suppkey LIMIT 10""",
    "sum_by_key": """
        SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
        FROM lineitem GROUP BY l_suppkey""",
    "distinct_count": "SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem) x",
    "ctas_rename": "SELECT l_orderkey AS a, l_returnflag AS b FROM lineitem",
    "filtered_export": """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS tv, user_id, event_type, props,
               CAST(year(ts) AS INTEGER) AS tv_year, CAST(month(ts) AS INTEGER) AS tv_month,
               CAST(day(ts) AS INTEGER) AS tv_day
        FROM events
        WHERE year(ts) = 2024 AND month(ts) = 1 AND substr(event_type, 1, 1) = 'p'""",
    "catalog_list": " UNION ALL ".join(f"SELECT '{name}' AS name, COUNT(*) AS n_rows FROM {name}" for name in TABLES),
}

"""Generated series and wide tables, sized by the given tables; loads and distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.distinct import distinct_report, error_check, merged_estimate, sketches_by
from millrace.functions.scalars import business_day, check_not_null, date_parts
from millrace.operators.aggregates import prefix_average_range
from millrace.plans.tools import catalog_name, file_tasks
from millrace.sinks.catalog import create_partitioned_table, insert_rows
from millrace.sources import generate
from millrace.sources.tables import table
from millrace.workspace import fresh_path


# Rows that one part of a generated table holds.
ROWS_PER_PART = 10_000


def number_series(spark: SparkSession, directory: str) -> DataFrame:
    """Each order's line numbers, and from them numbers that run on from its key."""
    lines = table(spark, directory, "lineitem")
    return generate.numbers_from(lines, "l_orderkey", F.col("l_linenumber"))


def time_series(spark: SparkSession, directory: str) -> DataFrame:
    events = table(spark, directory, "events")
    return generate.time_series(events.select(F.col("event_id").alias("num")), events.agg(F.max("ts")).scalar())


def uuid_distinct(spark: SparkSession, directory: str) -> DataFrame:
    """Every identifier given to an order is different."""
    orders = table(spark, directory, "orders").select("o_orderkey")
    return generate.uuid_columns(orders, ("d",)).select("d").distinct().agg(F.count("*").alias("n"))


def wide_datagen(spark: SparkSession, directory: str) -> DataFrame:
    """The wide table over the keys of the line items."""
    lines = table(spark, directory, "lineitem")
    return generate.wide_rows_of(lines, "l_orderkey", ROWS_PER_PART, tasks=file_tasks(spark))


def wide_datagen_overflow(spark: SparkSession, directory: str) -> DataFrame:
    """The variant that starts at 1 and whose first decimal overflows to NULL."""
    return generate.wide_rows_of(table(spark, directory, "orders"), "o_orderkey", ROWS_PER_PART, start=1, decimal_divisor=10)


def wide_datagen_tenths(spark: SparkSession, directory: str) -> DataFrame:
    """The variant that starts at 0 and divides by 10."""
    return generate.wide_rows_of(table(spark, directory, "customer"), "c_custkey", ROWS_PER_PART, decimal_divisor=10)


def array_column(spark: SparkSession, directory: str) -> DataFrame:
    orders = table(spark, directory, "orders").select("o_orderkey")
    return generate.neighbour_array(orders, "o_orderkey").select("o_orderkey", F.explode("secondary_ids").alias("id"))


def business_days(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").select("event_id", business_day(F.col("ts")).alias("crdate"))


def orders_by_day(spark: SparkSession, directory: str) -> DataFrame:
    orders = table(spark, directory, "orders")
    dated = orders.withColumn("o_orderdate", F.coalesce("o_orderdate", F.expr("TIMESTAMP_NTZ '1980-01-01 00:00:00'")))
    checked = check_not_null(dated, ["o_orderkey", "o_orderdate"])
    return checked.select("*", *date_parts(F.col("o_orderdate"), "o"))


def events_by_day(spark: SparkSession, directory: str) -> DataFrame:
    events = table(spark, directory, "events")
    return events.select("event_id", "user_id", "ts", *date_parts(F.col("ts"), "e"))


def partitioned_load(spark: SparkSession, directory: str) -> DataFrame:
    """Load orders into a table partitioned by year and month, and events into one partitioned by
    day as well; count rows by partition."""
    counts = []
    dated = [(orders_by_day(spark, directory).drop("o_day"), "o", "o_orderkey"), (events_by_day(spark, directory), "e", "event_id")]
    for rows, prefix, key in dated:
        keys = [f"{prefix}_{part}" for part in ("year", "month", "day") if f"{prefix}_{part}" in rows.columns]
        name = create_partitioned_table(spark, catalog_name(spark, "dated"), rows.schema.toDDL(), keys, fresh_path(spark, "dated"))
        loaded = insert_rows(rows, name, cluster_by=keys)
        parts = [F.col(k) for k in keys] + [F.lit(None).cast("int")] * (3 - len(keys))
        named = [part.alias(name) for part, name in zip(parts, ("year", "month", "day"))]
        counts.append(loaded.groupBy(*named).agg(F.count("*").alias("n"), F.sum(key).alias("key_sum")))
    return counts[0].unionByName(counts[1])


def prefix_avg_range(spark: SparkSession, directory: str) -> DataFrame:
    """Years 1995 to 2010, as a range of the stored column that the scan can use."""
    start, end = F.expr("TIMESTAMP_NTZ '1995-01-01'"), F.expr("TIMESTAMP_NTZ '2011-01-01'")
    orders = table(spark, directory, "orders").where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))
    digest = F.md5(F.col("o_orderkey").cast("string"))
    spread = prefix_average_range(orders, digest, 2, F.col("o_orderkey"))
    return spread.select(F.round("rng", 6).alias("rng"))


def approx_distinct(spark: SparkSession, directory: str) -> DataFrame:
    return error_check(distinct_report(table(spark, directory, "orders"), "o_custkey", method="builtin", sketched=[0.005]))


def sketch_distinct(spark: SparkSession, directory: str) -> DataFrame:
    return error_check(distinct_report(table(spark, directory, "orders"), "o_custkey", method="sketch"))


# Periods that are asked for, as half-open ranges of days, and the error of the stored sketches.
PERIODS = {"all": ("1900-01-01", "2100-01-01"), "year": ("1995-01-01", "1996-01-01"), "quarter": ("1996-04-01", "1996-07-01")}
SKETCH_ERROR = 0.02


def stored_sketches(spark: SparkSession, directory: str) -> DataFrame:
    """Customers of each day's orders as stored sketches, merged for three periods."""
    orders = table(spark, directory, "orders").withColumn("day", F.to_date("o_orderdate"))
    path = fresh_path(spark, "sketches")
    sketches_by(orders, ["day"], "o_custkey", SKETCH_ERROR).write.parquet(path)
    stored, answers = spark.read.schema("day DATE, n_rows BIGINT, sketch BINARY").parquet(path), []
    for name, (start, end) in PERIODS.items():
        within = (F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date"))
        exact = orders.where(within).agg(F.count_distinct("o_custkey")).scalar()
        merged = merged_estimate(stored.where(within)).withColumn("exact", exact)
        off = F.abs(F.col("estimate") - F.col("exact"))
        answers.append(merged.select(F.lit(name).alias("period"), "n_rows", "exact", (off <= 3 * SKETCH_ERROR * F.col("exact")).alias("within_bound")))
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


QUERIES = {
    "number_series": number_series,
    "time_series": time_series,
    "uuid_distinct": uuid_distinct,
    "wide_datagen": wide_datagen,
    "wide_datagen_overflow": wide_datagen_overflow,
    "wide_datagen_tenths": wide_datagen_tenths,
    "array_column": array_column,
    "business_day": business_days,
    "partitioned_load": partitioned_load,
    "prefix_avg_range": prefix_avg_range,
    "approx_distinct": approx_distinct,
    "sketch_distinct": sketch_distinct,
    "stored_sketches": stored_sketches,
}


def _wide_sql(total: str, key: str, start: int, divisor: int) -> str:
    ints = ", ".join(f"CAST(val + {by} AS INTEGER) AS {name}" for name, by in generate.INT_OFFSETS.items())
    longs = ", ".join(f"CAST(val + {by} AS BIGINT) AS {name}" for name, by in generate.LONG_OFFSETS.items())
    offsets = generate.INT_OFFSETS
    doubles = ", ".join(
        f"CAST((val + {offsets[source]}) / {by} AS DOUBLE) AS {name}"
        for name, (source, by) in generate.DOUBLE_SOURCES.items()
    )
    decimals = ", ".join(
        f"TRY_CAST((val + {offsets[source]}) / {divisor} AS DECIMAL(10,2)) AS {name}"
        for name, source in generate.DECIMAL_SOURCES.items()
    )
    digest = f"md5(unhex(lpad(to_hex(val + {offsets['int_1']}), 8, '0')))"
    texts = ", ".join(f"{digest} AS {name}" for name in generate.TEXT_COLUMNS)
    return f"""
        SELECT part_id, CAST(val AS INTEGER) AS val, {ints}, {longs}, {doubles}, {decimals}, {texts}
        FROM (SELECT CAST({key} // {ROWS_PER_PART} + 1 AS INTEGER) AS part_id, {key} % {ROWS_PER_PART} + {start} AS val FROM {total}) v"""


_ERRORS_SQL = """
    SELECT name, CAST(e AS DECIMAL(5,3)) AS error, (SELECT COUNT(DISTINCT o_custkey) FROM orders) AS exact,
           TRUE AS estimated, TRUE AS within_bound
    FROM (VALUES ('0.005', 0.005), ('0.020', 0.02), ('0.050', 0.05), ('0.100', 0.1),
                 ('approx_default', 0.05), ('sketch_default', 0.05)) t(name, e)"""

ORACLES = {
    "number_series": """
        SELECT l_orderkey + unnest(range(1, 1 + l_linenumber)) AS num FROM lineitem""",
    "time_series": """
        SELECT num, tv, CAST(year(tv) AS INTEGER) AS tv_year, CAST(month(tv) AS INTEGER) AS tv_month,
               CAST(day(tv) AS INTEGER) AS tv_day
        FROM (SELECT event_id AS num, (SELECT MAX(ts) FROM events) - to_seconds(event_id) AS tv FROM events) x""",
    "uuid_distinct": "SELECT COUNT(*) AS n FROM orders",
    "wide_datagen": _wide_sql("lineitem", "l_orderkey", 0, 100),
    "wide_datagen_overflow": _wide_sql("orders", "o_orderkey", 1, 10),
    "wide_datagen_tenths": _wide_sql("customer", "c_custkey", 0, 10),
    "array_column": "SELECT o_orderkey, unnest([o_orderkey + 1, o_orderkey + 2, o_orderkey + 3]) AS id FROM orders",
    "business_day": """
        SELECT event_id,
               CAST(strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Moscow', '%Y%m%d') AS INTEGER) AS crdate
        FROM events""",
    "partitioned_load": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
               CAST(NULL AS INTEGER) AS day, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS key_sum
        FROM orders GROUP BY ALL
        UNION ALL
        SELECT CAST(year(ts) AS INTEGER), CAST(month(ts) AS INTEGER), CAST(day(ts) AS INTEGER), COUNT(*),
               CAST(SUM(event_id) AS BIGINT)
        FROM events GROUP BY ALL""",
    "prefix_avg_range": """
        SELECT ROUND(MAX(a) - MIN(a), 6) AS rng FROM (
          SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) AS p, AVG(o_orderkey) AS a
          FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2010 GROUP BY 1) x""",
    "approx_distinct": _ERRORS_SQL,
    "sketch_distinct": _ERRORS_SQL,
    "stored_sketches": " UNION ALL ".join(
        f"""SELECT '{name}' AS period, COUNT(*) AS n_rows, COUNT(DISTINCT o_custkey) AS exact, TRUE AS within_bound
        FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{start}' AND CAST(o_orderdate AS DATE) < DATE '{end}'"""
        for name, (start, end) in PERIODS.items()
    ),
}

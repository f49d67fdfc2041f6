"""Diagnostics over the given tables: events as log records, events and orders as log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diagnostics
from millrace.operators.phases import phase_durations
from millrace.sources.logs import read_logs, read_records
from millrace.sources.tables import table
from millrace.workspace import fresh_path

TESTS = ("F", "O")
CONFIGS = ("A", "N", "R")


def log_filter(spark: SparkSession, directory: str) -> DataFrame:
    """Events exported as log records, JSON lines, and searched there."""
    events = table(spark, directory, "events")
    exported = events.select(
        _text(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), "Z").alias("ts"),
        F.col("event_type").alias("log_type"),
        F.col("user_id").cast("string").alias("application_id"),
        F.col("event_id").cast("string").alias("container_id"),
        F.col("props").alias("message"),
    )
    path = fresh_path(spark, "logs")
    exported.write.json(path)
    found = diagnostics.search_logs(
        read_logs(spark, path),
        any_of={"log_type": ["error", "view"]},
        since="2024-01-05 00:00:00",
        until="2024-01-25 00:00:00",
    )
    return found.select(
        F.col("container_id").cast("bigint").alias("event_id"),
        F.col("application_id").cast("bigint").alias("user_id"),
        F.col("log_type").alias("event_type"),
        F.unix_micros("ts").alias("micros"),
        F.col("message").alias("props"),
    )


def event_durations(spark: SparkSession, directory: str) -> DataFrame:
    """Events of a user as the phases of a run."""
    events = table(spark, directory, "events").select("user_id", "event_id", "event_type", "ts")
    return phase_durations(events, run="user_id", order=["event_id"])


def event_durations_dense(spark: SparkSession, directory: str) -> DataFrame:
    """The same with runs being event types, each of which has a fifth of all rows."""
    events = table(spark, directory, "events").select("event_type", "event_id", "ts")
    return phase_durations(events, run="event_type", order=["event_id"])


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])


def _task_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Error events as lost-executor messages among other lines."""
    lost = _text(
        "24/01/01 00:00:00 WARN TaskSetManager: Lost task ", F.col("event_id") % 5000, ".0 in stage ", F.col("user_id") % 1000,
        ".0 (TID ", F.col("event_id") + 1000, ") (host-", F.col("user_id"), " executor ", F.col("user_id") % 40,
        "): ExecutorLostFailure (executor ", F.col("user_id") % 40,
        " exited caused by one of the running tasks) Reason: Executor heartbeat timed out after ",
        F.col("event_id") + 120000, " ms",
    )
    other = _text("24/01/01 00:00:00 INFO TaskSetManager: Finished task ", F.col("event_id"), ".0")
    return table(spark, directory, "events").select(
        F.when(F.col("event_type") == "error", lost).otherwise(other).alias("value")
    )


def lost_executors(spark: SparkSession, directory: str) -> DataFrame:
    return diagnostics.losses_by_executor(diagnostics.lost_executors(_task_lines(spark, directory)))


def lost_executors_wrapped(spark: SparkSession, directory: str) -> DataFrame:
    """The same from log files in which each message goes over three lines; with the number of records."""
    path = fresh_path(spark, "wrapped")
    wrapped = F.regexp_replace("value", r" (executor|Reason:|task) ", "\n$1\n")
    _task_lines(spark, directory).select(wrapped.alias("value")).write.text(path)
    records = read_records(spark, path)
    # The pattern of a loss is of one line.
    lines = records.select(F.replace("value", F.lit("\n"), F.lit(" ")).alias("value"))
    losses = diagnostics.losses_by_executor(diagnostics.lost_executors(lines))
    return losses.withColumn("n_records", records.agg(F.count("*")).scalar())


def registration_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Orders as registration batches: one line for the size and one for the times, per status."""
    line = F.explode(
        F.array(
            _text("INFO total partitions to be created: ", F.col("o_custkey")),
            _text(
                "INFO total method time: ", F.col("o_orderkey") * 6, ", push=", F.col("o_orderkey"),
                ", fetch=", F.col("o_orderkey") * 2, ", addParts=", F.col("o_orderkey") * 3,
            ),
            _text("INFO order ", F.col("o_orderkey")),
        )
    ).alias("value")
    lines = table(spark, directory, "orders").select(F.col("o_orderstatus").alias("run"), line)
    return diagnostics.registration_batches(lines, by=["run"])


def throughput(spark: SparkSession, directory: str) -> DataFrame:
    """Line status as test and return flag as configuration; quantity stands for the time."""
    runs = table(spark, directory, "lineitem").select(
        F.col("l_linestatus").alias("test"), F.col("l_returnflag").alias("config"), F.col("l_extendedprice").alias("seconds")
    )
    return diagnostics.throughput_report(runs, configs=CONFIGS)


QUERIES = {
    "log_filter": log_filter,
    "phase_durations": event_durations,
    "phase_durations_sliced": event_durations_dense,
    "lost_executors": lost_executors,
    "lost_executors_wrapped": lost_executors_wrapped,
    "registration_batches": registration_batches,
    "throughput_report": throughput,
}

def _durations_sql(run: str, columns: str) -> str:
    following = f"lead(ts) OVER (PARTITION BY {run} ORDER BY ts, event_id)"
    return f"SELECT {columns}, date_diff('microsecond', ts, {following}) AS micros FROM events"


_LOST_SQL = """
        SELECT CAST(user_id % 40 AS VARCHAR) AS executor, COUNT(*) AS n_lost, MAX(event_id + 120000) AS max_timeout_ms,
               CAST(0 AS BIGINT) AS n_unread
        FROM events WHERE event_type = 'error' GROUP BY 1"""

ORACLES = {
    "log_filter": """
        SELECT event_id, user_id, event_type, epoch_us(ts) AS micros, props
        FROM events WHERE event_type IN ('error', 'view')
          AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00'""",
    "phase_durations": _durations_sql("user_id", "user_id, event_id, event_type, ts"),
    "phase_durations_sliced": _durations_sql("event_type", "event_type, event_id, ts"),
    "lost_executors": _LOST_SQL,
    "lost_executors_wrapped": f"SELECT *, (SELECT COUNT(*) FROM events) AS n_records FROM ({_LOST_SQL}) x",
    "registration_batches": """
        SELECT o_orderstatus AS run, COUNT(*) AS batches, CAST(SUM(o_custkey) AS BIGINT) AS partitions,
               CAST(SUM(o_orderkey) * 6 AS BIGINT) AS total_ms, CAST(SUM(o_orderkey) AS BIGINT) AS push_ms,
               CAST(SUM(o_orderkey) * 2 AS BIGINT) AS fetch_ms, CAST(SUM(o_orderkey) * 3 AS BIGINT) AS add_ms,
               COUNT(*) AS n_other
        FROM orders GROUP BY 1""",
    "throughput_report": """
        SELECT l_linestatus AS test, MIN(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS "A",
               MIN(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS "N",
               MIN(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS "R"
        FROM lineitem GROUP BY 1""",
}

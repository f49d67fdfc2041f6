"""Diagnostics over logs, event logs, load timings and dataset layouts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from millrace.sources.logs import read_event_log

# Patterns of the log lines.
LOST_TASK = (
    r"Lost task (\d+)\.\d+ in stage (\d+)\.\d+ \(TID (\d+)\).*?executor (\w+)\): "
    r"ExecutorLostFailure.*?Reason: (.*)"
)
TIMED_OUT = r"heartbeat timed out after (\d+) ms"
BATCH_SIZE = r"total partitions to be created: (\d+)"
BATCH_TIMES = r"total method time: (\d+), push=(\d+), fetch=(\d+), addParts=(\d+)"

# Fixed value: how event logs name the start and end of SQL executions.
SQL_EVENTS = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"


def search_logs(
    logs: DataFrame,
    equals: Mapping[str, object] | None = None,
    any_of: Mapping[str, Sequence] | None = None,
    since: Column | str | None = None,
    until: Column | str | None = None,
    limit: int | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Log records by attribute values and UTC time range (``since`` <= time < ``until``).

    The bounds are columns or ISO texts: a date with or without a time, or a time of day
    (with a colon), which is today's. All conditions are plain comparisons and are pushed into
    the scan. ``limit`` gives the earliest records that match; of equally late ones any.
    """
    ts_type = logs.schema[ts].dataType

    def moment(value: Column | str) -> Column:
        return _utc_literal(value, ts_type) if isinstance(value, str) else value

    def every(conditions: list[Column]) -> Column:
        return reduce(Column.__and__, conditions, F.lit(True))

    period = []
    if since is not None:
        period.append(F.col(ts) >= moment(since))
    if until is not None:
        period.append(F.col(ts) < moment(until))
    attributes = [F.col(name) == value for name, value in (equals or {}).items()]
    attributes += [F.col(name).isin(list(values)) for name, values in (any_of or {}).items()]

    found = logs.where(every(period)).where(every(attributes))
    return found if limit is None else found.orderBy(ts).limit(limit)


def _utc_literal(text: str, ts_type: DataType) -> Column:
    """A moment given in UTC, as a literal of either timestamp type in any session zone."""
    utc = dt.timezone.utc
    # Without a colon, eight digits are a date, though they could be a time of day.
    if ":" in text and "-" not in text.split(":")[0] and len(text.split(":")[0]) <= 3:
        moment = dt.datetime.combine(dt.datetime.now(utc).date(), dt.time.fromisoformat(text))
    else:
        moment = dt.datetime.fromisoformat(text)
    moment = moment.astimezone(utc) if moment.tzinfo else moment.replace(tzinfo=utc)
    without_zone = isinstance(ts_type, TimestampNTZType)
    return F.lit((moment.replace(tzinfo=None) if without_zone else moment).isoformat(" ")).cast(ts_type)


def _matched(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern, NULL where it does not match. Casting the empty string with
    ``try_cast`` instead would raise and catch an exception per line."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def lost_executors(lines: DataFrame, line: str = "value") -> DataFrame:
    """Task, stage, task attempt, executor, reason and time-out (ms) of each line that names a
    lost executor; all columns but ``unread`` are NULL for one that cannot be parsed. Other lines
    are left out. A record broken over several lines must come as one value."""
    def group(number: int) -> Column:
        return _matched(F.col(line), f"(?s){LOST_TASK}", number)

    return (
        lines.where(F.col(line).contains("ExecutorLostFailure"))
        .select(
            group(1).cast("int").alias("task"),
            group(2).cast("int").alias("stage"),
            group(3).cast("bigint").alias("tid"),
            group(4).alias("executor"),
            F.trim(group(5)).alias("reason"),
        )
        .withColumn("timeout_ms", _matched(F.col("reason"), TIMED_OUT, 1).cast("bigint"))
        .withColumn("unread", F.col("task").isNull())
    )


def losses_by_executor(losses: DataFrame) -> DataFrame:
    """Number of losses, longest time-out and number of lines that could not be parsed, per
    executor; such lines are under the NULL executor."""
    return losses.groupBy("executor").agg(
        F.count_if(~F.col("unread")).alias("n_lost"),
        F.max("timeout_ms").alias("max_timeout_ms"),
        F.count_if("unread").alias("n_unread"),
    )


def registration_batches(lines: DataFrame, line: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Batches, partitions and milliseconds by phase over partition-registration lines;
    ``n_other`` counts the lines that are neither of the two kinds."""
    def number(pattern: str, group: int) -> Column:
        return _matched(F.col(line), pattern, group).cast("bigint")

    parsed = lines.select(
        *by,
        number(BATCH_SIZE, 1).alias("partitions"),
        number(BATCH_TIMES, 1).alias("total_ms"),
        number(BATCH_TIMES, 2).alias("push_ms"),
        number(BATCH_TIMES, 3).alias("fetch_ms"),
        number(BATCH_TIMES, 4).alias("add_ms"),
    )
    sums = ["partitions", "total_ms", "push_ms", "fetch_ms", "add_ms"]
    return parsed.groupBy(*by).agg(
        F.count("total_ms").alias("batches"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums],
        F.count_if(F.col("partitions").isNull() & F.col("total_ms").isNull()).alias("n_other"),
    )


def _of_kind(events: DataFrame, *kinds: str) -> DataFrame:
    """Compared by full name, so the JSON reader drops other events before it converts them."""
    return events.where(F.col("Event").isin(list(kinds)))


def job_report(events: DataFrame) -> DataFrame:
    """Duration (ms) and result of each job."""
    ends = _of_kind(events, "SparkListenerJobStart", "SparkListenerJobEnd")
    return ends.groupBy("app", F.col("Job ID").alias("job_id")).agg(
        (F.max("Completion Time") - F.min("Submission Time")).alias("duration_ms"),
        F.max("Job Result.Result").alias("result"),
    )


def stage_report(events: DataFrame) -> DataFrame:
    """Tasks and duration (ms) of each stage attempt."""
    info = F.col("Stage Info")
    return _of_kind(events, "SparkListenerStageCompleted").select(
        "app",
        info["Stage ID"].alias("stage_id"),
        info["Stage Attempt ID"].alias("attempt"),
        info["Stage Name"].alias("stage_name"),
        info["Number of Tasks"].alias("n_tasks"),
        (info["Completion Time"] - info["Submission Time"]).alias("duration_ms"),
    )


def _task_sums(events: DataFrame, *by: Column) -> DataFrame:
    metrics = F.col("Task Metrics")
    return (
        _of_kind(events, "SparkListenerTaskEnd")
        .groupBy("app", *by)
        .agg(
            F.count("*").alias("n_tasks"),
            F.count_if(F.col("Task Info.Failed")).alias("n_failed"),
            F.sum(metrics["Executor Run Time"]).alias("run_ms"),
            F.sum(metrics["JVM GC Time"]).alias("gc_ms"),
        )
        .withColumn("gc_share", F.try_divide(F.col("gc_ms"), F.col("run_ms")))
    )


def executor_report(events: DataFrame) -> DataFrame:
    """Tasks, run time and share of garbage collection by executor. A high share means the
    executor is short of memory."""
    return _task_sums(events, F.col("Task Info.Executor ID").alias("executor_id"))


def executor_states(events: DataFrame) -> DataFrame:
    """Host, cores, start, end and reason of the end of each executor; the end is NULL for
    one that was there to the last event."""
    changes = _of_kind(events, "SparkListenerExecutorAdded", "SparkListenerExecutorRemoved")
    removed = F.col("Event") == "SparkListenerExecutorRemoved"
    return changes.groupBy("app", F.col("Executor ID").alias("executor_id")).agg(
        F.max("Executor Info.Host").alias("host"),
        F.max("Executor Info.Total Cores").alias("cores"),
        F.min(F.when(~removed, F.col("Timestamp"))).alias("added_ms"),
        F.max(F.when(removed, F.col("Timestamp"))).alias("removed_ms"),
        F.max("Removed Reason").alias("reason"),
    )


def settings_report(events: DataFrame) -> DataFrame:
    """Spark settings of each application."""
    return _of_kind(events, "SparkListenerEnvironmentUpdate").select(
        "app", F.explode("Spark Properties").alias("setting", "value")
    )


def stage_task_report(events: DataFrame) -> DataFrame:
    """Tasks, run time and share of garbage collection by stage."""
    return _task_sums(events, F.col("Stage ID").alias("stage_id"))


def sql_report(events: DataFrame) -> DataFrame:
    """Description and duration (ms) of each SQL execution."""
    ends = _of_kind(events, f"{SQL_EVENTS}Start", f"{SQL_EVENTS}End")
    return ends.groupBy("app", F.col("executionId").alias("execution_id")).agg(
        F.max("description").alias("description"),
        (F.max("time") - F.min("time")).alias("duration_ms"),
    )


def sql_plans(events: DataFrame) -> DataFrame:
    """Physical plan, as text, that each SQL execution started with."""
    return _of_kind(events, f"{SQL_EVENTS}Start").select(
        "app", F.col("executionId").alias("execution_id"), F.col("physicalPlanDescription").alias("plan")
    )


def event_log_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All reports over an event log or a directory of logs."""
    return event_reports(read_event_log(spark, path))


def event_reports(events: DataFrame) -> dict[str, DataFrame]:
    """All reports over events that are read already."""
    return {
        "jobs": job_report(events),
        "stages": stage_report(events),
        "stage_tasks": stage_task_report(events),
        "executors": executor_report(events),
        "executor_states": executor_states(events),
        "sql": sql_report(events),
        "sql_plans": sql_plans(events),
        "settings": settings_report(events),
    }


def dataset_inventory(spark: SparkSession, path: str, partition_columns: Sequence[str]) -> DataFrame:
    """Files, bytes and rows per partition of a Parquet dataset.

    No data column is read: rows come from the file footers, and are summed per file before
    the shuffle.
    """
    files = (
        spark.read.parquet(path)
        .groupBy(*partition_columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        .agg(F.count("*").alias("n"))
    )
    return files.groupBy(*partition_columns).agg(
        F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.sum("n").alias("n_rows")
    )


def throughput_report(
    runs: DataFrame, tests: str = "test", config: str = "config", value: str = "seconds", configs: Sequence[str] = ()
) -> DataFrame:
    """One row per test, one column per configuration, the best time of each.

    Naming the configurations saves the pass that would look for them.
    """
    pivoted = runs.groupBy(tests).pivot(config, list(configs) or None)
    return pivoted.agg(F.min(value))

"""Log records and Spark event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.workspace import fresh_path

# Attributes of a log record.
LOG_SCHEMA = """
    ts TIMESTAMP, log_type STRING, application_id STRING, container_id STRING, hostname STRING,
    yarn_log_type STRING, message STRING
"""

# The fields of a Spark event log that the reports use.
EVENT_SCHEMA = """
    `Event` STRING,
    `Job ID` BIGINT, `Submission Time` BIGINT, `Completion Time` BIGINT,
    `Job Result` STRUCT<`Result`: STRING>,
    `Stage ID` BIGINT, `Stage Attempt ID` BIGINT,
    `Stage Info` STRUCT<`Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT, `Stage Name`: STRING,
        `Number of Tasks`: BIGINT, `Submission Time`: BIGINT, `Completion Time`: BIGINT>,
    `Task Info` STRUCT<`Executor ID`: STRING, `Host`: STRING, `Failed`: BOOLEAN>,
    `Task Metrics` STRUCT<`Executor Run Time`: BIGINT, `JVM GC Time`: BIGINT>,
    `executionId` BIGINT, `description` STRING, `time` BIGINT, `physicalPlanDescription` STRING,
    `Timestamp` BIGINT, `Executor ID` STRING, `Removed Reason` STRING,
    `Executor Info` STRUCT<`Host`: STRING, `Total Cores`: INT>,
    `Spark Properties` MAP<STRING, STRING>
"""
# Fixed value: a log line begins with a day and a time.
RECORD_HEAD = r"^\d{2,4}[-/]\d\d[-/]\d\d[ T]\d\d:\d\d:\d\d"
APPLICATION_ID = r"((?:application|app|local)[-_]\d+(?:[-_]\d+)?)"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log records exported as JSON lines; times are UTC."""
    return spark.read.schema(LOG_SCHEMA).option("timeZone", "UTC").json(path)


def read_records(spark: SparkSession, path: str, head: str = RECORD_HEAD) -> DataFrame:
    """file, value: log records of text files, of which one may go over several lines. ``head`` is the
    pattern of a line that begins a record; other lines continue the record before them.

    Files are read in splits, and lines keep their order by split and place. Inside a split heads are
    counted; lines before its first head belong to the last head of an earlier split, found from one
    row per split. So no file is read whole by one task. Lines before the first head of a file
    are a record without a head. The counted lines are written once, as another scan (with a
    condition on files, say) may cut files elsewhere.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),  # grows along a split
    )
    so_far = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.sum(F.col("value").rlike(head).cast("bigint")).over(so_far)
    staged = fresh_path(spark, "log-lines")
    lines.withColumn("heads", heads).write.option("compression", "zstd").parquet(staged)
    counted = spark.read.parquet(staged)
    splits = counted.groupBy("file", "split").agg(F.max("heads").alias("n_heads"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    with_heads = F.when(F.col("n_heads") > 0, F.struct("split", F.col("n_heads").alias("heads")))
    carried = splits.select("file", "split", F.last(with_heads, ignorenulls=True).over(earlier).alias("carried"))
    joined = counted.join(carried, ["file", "split"])
    record = F.when(F.col("heads") > 0, F.struct("split", "heads")).otherwise(F.col("carried")).alias("record")
    pieces = joined.select("file", record, F.struct("split", "place", "value").alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda line: line["value"]), "\n")
    return pieces.groupBy("file", "record").agg(text.alias("value")).select("file", "value")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of one log, or of a whole directory of logs, with the application they are from.

    Declared fields only, so one parse and no inference pass. Uncompressed logs are split
    over tasks by blocks. The application is in the name of the file or of its folder.
    """
    events = spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").json(path)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -2)
    return events.withColumn("app", F.regexp_extract(name, APPLICATION_ID, 1))

"""Queue records: JSON parsing by batch and stream, record generation, a queue sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table
from millrace.streaming import records
from millrace.workspace import fresh_path

PROPS_SCHEMA = "k BIGINT"
QUEUE_SCHEMA = "key BINARY, value BINARY"


def _as_queue(events: DataFrame) -> DataFrame:
    """Events as a queue delivers them: binary key and value."""
    return events.select(
        F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value")
    )


def _table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of the directory as a file stream."""
    schema = table(spark, directory, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def json_flatten_batch(spark: SparkSession, directory: str) -> DataFrame:
    queue = _as_queue(table(spark, directory, "events"))
    return spark.read.parquet(records.run_batch(queue, fresh_path(spark, "records"), PROPS_SCHEMA))


def json_flatten_stream(spark: SparkSession, directory: str) -> DataFrame:
    queue = _as_queue(_table_stream(spark, directory, "events"))
    path = fresh_path(spark, "records")
    checkpoint = fresh_path(spark, "records-checkpoint")
    records.run_stream(queue, path, checkpoint, PROPS_SCHEMA, {"availableNow": True}).awaitTermination()
    return spark.read.parquet(path)


def _order_records(orders: DataFrame) -> DataFrame:
    key = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    return records.record_rows(orders, F.col("o_orderkey"), key, F.col("o_orderpriority"))


def json_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    return records.parse_records(_order_records(table(spark, directory, "orders")))


def queue_sink(spark: SparkSession, directory: str) -> DataFrame:
    """Generated records streamed out as key and value, then read as a queue is."""
    path = fresh_path(spark, "queue")
    checkpoint = fresh_path(spark, "queue-checkpoint")
    generated = _order_records(_table_stream(spark, directory, "orders"))
    sending = records.send_records(generated, checkpoint, {"path": path}, "parquet", {"availableNow": True})
    sending.awaitTermination()
    received = records.read_queue(spark, {"path": path}, source="parquet")
    return records.parse_records(received).select("key", "b", "c")


# Files the events are split into, files of a micro-batch, and micro-batches before each stop.
EVENT_FILES, FILES_PER_BATCH, STOPS = 12, 2, (2, 1)


def stream_restart(spark: SparkSession, directory: str) -> DataFrame:
    """The parsing stream over events in several files, some of them admitted at a time, stopped twice
    and started again from its checkpoint. Every record is there once, and so is every batch."""
    source, path, checkpoint = (fresh_path(spark, label) for label in ("events", "records", "records-checkpoint"))
    _as_queue(table(spark, directory, "events")).repartition(EVENT_FILES, "key").write.parquet(source)

    def start():
        queue = records.read_queue(
            spark, {"path": source, "maxFilesPerTrigger": str(FILES_PER_BATCH)}, stream=True, source="parquet", schema=QUEUE_SCHEMA
        )
        return records.run_stream(queue, path, checkpoint, PROPS_SCHEMA, {"availableNow": True})

    for batches in STOPS:
        records.stop_after(start(), batches)
    start().awaitTermination()
    found = spark.read.parquet(path)
    return found.withColumn("batches", F.lit(records.committed_batches(spark, checkpoint)).cast("bigint"))


# Micro-batches that all orders are sent in.
RATE_BATCHES = 8


def rate_stream(spark: SparkSession, directory: str) -> DataFrame:
    """Orders sent at a limited rate, read from the queue by the parsing stream; with whether
    the batch a record came in is within the limit."""
    queue, sent, path, checkpoint = (fresh_path(spark, label) for label in ("queue", "sent", "records", "records-checkpoint"))
    orders = table(spark, directory, "orders")
    first, last = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    rate = -(-(last - first + 1) // RATE_BATCHES)
    counter, key = F.col("o_orderkey"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    records.send_stored(spark, orders, "o_orderkey", queue, sent, rate, counter, key, F.col("o_orderpriority"))
    options, schema = {"path": queue, "recursiveFileLookup": "true"}, "key STRING, value STRING"
    received = records.read_queue(spark, options, stream=True, source="parquet", schema=schema)
    records.run_stream(received, path, checkpoint, trigger={"availableNow": True}).awaitTermination()
    batches = records.read_queue(spark, options, source="parquet", schema=schema)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    largest = batches.groupBy(folder).count().agg(F.max("count")).scalar()
    return spark.read.parquet(path).withColumn("within_rate", largest <= rate)


QUERIES = {
    "json_flatten_batch": json_flatten_batch,
    "json_flatten_stream": json_flatten_stream,
    "json_roundtrip": json_roundtrip,
    "queue_sink": queue_sink,
    "stream_restart": stream_restart,
    "rate_stream": rate_stream,
}

_FLATTEN_SQL = """
    SELECT CAST(event_id AS VARCHAR) AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"""

ORACLES = {
    "json_flatten_batch": _FLATTEN_SQL,
    "json_flatten_stream": _FLATTEN_SQL,
    "json_roundtrip": """
        SELECT 'order-' || o_orderkey AS key, 'order-' || o_orderkey AS a, o_orderkey % 10000 AS b,
               CAST(o_orderkey % 763 + 512 AS INTEGER) AS c, o_orderpriority AS d
        FROM orders""",
    "queue_sink": """
        SELECT 'order-' || o_orderkey AS key, o_orderkey % 10000 AS b,
               CAST(o_orderkey % 763 + 512 AS INTEGER) AS c
        FROM orders""",
    "stream_restart": f"SELECT *, CAST({-(-EVENT_FILES // FILES_PER_BATCH)} AS BIGINT) AS batches FROM ({_FLATTEN_SQL}) e",
    "rate_stream": """
        SELECT 'order-' || o_orderkey AS key, 'order-' || o_orderkey AS a, o_orderkey % 10000 AS b,
               CAST(o_orderkey % 763 + 512 AS INTEGER) AS c, o_orderpriority AS d, TRUE AS within_rate
        FROM orders""",
}

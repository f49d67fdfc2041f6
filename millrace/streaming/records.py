"""Queue records: JSON text -> typed columns -> files, by batch or by stream, and a
generator of such records."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.sinks.files import write_once
from millrace.workspace import dated_path

# The record's fields, and the setting that selects the mode.
RECORD_SCHEMA = "a STRING, b BIGINT, c INT, d STRING"
MODE_SETTING = "spark.millrace.records.mode"
MODES = ("BATCH", "STREAM")


def queue_options(
    servers: str,
    topic: str,
    user: str | None = None,
    password: str | None = None,
    mechanism: str = "SCRAM-SHA-512",
    protocol: str = "SASL_SSL",
    **extra: str,
) -> dict[str, str]:
    """Source options for a Kafka topic, with a login when a user is given. Offsets keep
    Spark's defaults: everything in batch mode, new records in a new stream."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    if user is not None:
        options |= {
            "kafka.security.protocol": protocol,
            "kafka.sasl.mechanism": mechanism,
            "kafka.sasl.jaas.config": (
                "org.apache.kafka.common.security.scram.ScramLoginModule required "
                f'username="{user}" password="{password}";'
            ),
        }
    return {**options, **extra}


def read_queue(
    spark: SparkSession, options: dict[str, str], stream: bool = False, source: str = "kafka", schema: str | None = None
) -> DataFrame:
    """Key and value columns of a topic. Needs the Kafka connector on the class path.

    A ``source`` of files needs their ``schema`` in a stream.
    """
    reader = spark.readStream if stream else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(source).options(**options).load()


def parse_records(df: DataFrame, schema: StructType | str = RECORD_SCHEMA) -> DataFrame:
    """``key``, ``value`` -> ``key`` and one column per schema field.

    One projection for both modes. A malformed or missing value gives NULL fields; the key stays.
    """
    parsed = df.select(
        F.col("key").cast("string").alias("key"),
        F.from_json(F.col("value").cast("string"), schema).alias("value"),
    )
    return parsed.select("key", "value.*")


def run_batch(df: DataFrame, path: str, schema: StructType | str = RECORD_SCHEMA) -> str:
    """Parse what is there now and write it to a new directory."""
    return write_once(parse_records(df, schema), path)


def run_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    schema: StructType | str = RECORD_SCHEMA,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the parsing stream into a Parquet directory.

    Path and checkpoint belong together and stay the same over restarts: offsets in the
    checkpoint and the sink's log of committed files then give each record once.
    """
    writer = parse_records(df, schema).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stop_after(query: StreamingQuery, batches: int, poll_seconds: float = 0.05) -> int:
    """Stop a running stream once it has finished so many more micro-batches, or has ended by itself;
    returns how many it reported.

    A batch that is under way is given up: its offsets are in the checkpoint without a commit, so
    the next start runs it again, and the sink takes each batch once.
    """
    finished: set[int] = set()
    ended = False
    while not ended and len(finished) < batches:
        ended = query.awaitTermination(poll_seconds)
        finished |= {progress["batchId"] for progress in query.recentProgress if progress["numInputRows"]}
    query.stop()
    return len(finished)


def committed_batches(spark: SparkSession, checkpoint: str) -> int:
    """Micro-batches that a stream has committed under its checkpoint."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0
    return sum(entry.getPath().getName().isdigit() for entry in files.listStatus(folder))


def run_records(
    spark: SparkSession,
    options: dict[str, str],
    path: str,
    checkpoint: str,
    schema: StructType | str = RECORD_SCHEMA,
    source: str = "kafka",
) -> StreamingQuery | str:
    """The whole job; the session setting chooses BATCH (default) or STREAM.

    A batch run writes to a new dated directory under ``path`` and returns its name. A stream
    always writes to ``path`` itself, as its checkpoint refers to it.
    """
    mode = spark.conf.get(MODE_SETTING, "BATCH").upper()
    if mode not in MODES:
        raise ValueError(f"{MODE_SETTING} must be one of {MODES}, not {mode!r}")
    stream = mode == "STREAM"
    incoming = read_queue(spark, options, stream=stream, source=source)
    if stream:
        return run_stream(incoming, path, checkpoint, schema)
    return run_batch(incoming, dated_path(f"{path}/"), schema)


def record_rows(df: DataFrame, counter: Column, key: Column | None = None, extra: Column | None = None) -> DataFrame:
    """Queue records made from a running number: ``key`` and the JSON text ``value``.

    Key and last field are random identifiers unless given.
    """
    keyed = df.select(
        (F.expr("uuid()") if key is None else key).alias("key"),
        counter.cast("bigint").alias("counter"),
        (F.expr("uuid()") if extra is None else extra).alias("d"),
    )
    # The moduli and the offset of the two number fields.
    record = F.struct(
        F.col("key").alias("a"),
        (F.col("counter") % 10000).alias("b"),
        (F.col("counter") % 763 + 512).cast("int").alias("c"),
        F.col("d"),
    )
    return keyed.select("key", F.to_json(record).alias("value"))


def record_stream(spark: SparkSession, rows_per_second: float = 10) -> DataFrame:
    """An endless stream of generated records at a steady rate, at least one per second."""
    rate = max(1, int(rows_per_second))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return record_rows(ticks, F.col("value"))


def send_stored(
    spark: SparkSession,
    stored: DataFrame,
    position: str,
    path: str,
    checkpoint: str,
    rows_per_batch: int,
    counter: Column,
    key: Column | None = None,
    extra: Column | None = None,
    seconds: float = 0,
) -> None:
    """Send a stored table to a queue of files at a steady rate: at most ``rows_per_batch`` rows every
    ``seconds`` (0: without a pause), in the order of ``position``, a column of different whole numbers.

    The offset of the stream is the position: a trigger admits the next ``rows_per_batch`` positions,
    and the stored rows there, a range that the scan prunes by, become one folder of records. A
    batch that is repeated after a failure has the same positions and replaces its folder, so
    each record is sent once. The stream ends when a trigger finds nothing beyond the last
    position; one that is stopped before goes on from its checkpoint.
    """
    first, last = stored.agg(F.min(position), F.max(position)).first()
    if first is None:
        return
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    all_sent = threading.Event()

    def send(batch: DataFrame, number: int) -> None:
        begin, end = batch.agg(F.min("value"), F.max("value")).first()
        if begin is None:
            return
        if first + begin > last:
            all_sent.set()
            return
        due = stored.where((F.col(position) >= first + begin) & (F.col(position) <= first + end))
        record_rows(due, counter, key, extra).write.mode("overwrite").parquet(f"{path}/{number:012}")

    writer = ticks.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime=f"{seconds} seconds").start()
    while not all_sent.is_set() and not query.awaitTermination(0.05):
        pass
    query.stop()


def send_records(
    records: DataFrame,
    checkpoint: str,
    options: dict[str, str],
    sink: str = "kafka",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Stream ``key`` and ``value`` to a queue topic, or to files with another ``sink``."""
    writer = records.select("key", "value").writeStream.format(sink).outputMode("append")
    writer = writer.options(**options).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

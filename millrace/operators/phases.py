"""Durations between successive timestamps of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.workspace import discard, fresh_path


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from one timestamp to another as BIGINT, independent of the time zone."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("bigint")


def phase_durations(
    events: DataFrame,
    run: str = "run",
    ts: str = "ts",
    order: Sequence[str] = (),
    name: str = "micros",
) -> DataFrame:
    """Add the time to the next event of the same run, in microseconds; NULL for the last.

    ``order`` breaks ties between equal timestamps; of events it leaves equal any may be the
    last. NULL is a run like any other; rows without a timestamp have no duration and no place
    in the order.

    An event is followed by its own timestamp unless it is the last of those at that moment, and
    then by the next moment of the run. So only moments are put in order, one row for each run
    and timestamp, counted together before they are shuffled. They are cut into ranges of equal
    size by run and moment, wherever a run begins or ends, and the first moment of each range is
    carried to the range before. The events meet the moments in a join that adaptive execution
    can split, so neither a run nor a moment that holds most of the events is one task, however
    dense it is. Events are written once, with a number that tells the last.
    """
    numbered = _numbered(events)
    timed = numbered.where(F.col(f"event.{ts}").isNotNull())
    last = F.struct(*[F.col(f"event.`{column}`") for column in order], "number")
    moments = timed.groupBy(F.col(f"event.`{run}`").alias("run"), F.col(f"event.`{ts}`").alias("ts")).agg(F.max(last).alias("last"))
    following = followed_moments(moments)
    event_run, event_ts = F.col(f"event.`{run}`"), F.col(f"event.`{ts}`")
    joined = numbered.join(following, event_run.eqNullSafe(F.col("run")) & (event_ts == F.col("ts")), "left")
    is_last = F.col("number") == F.col("last.number")
    next_ts = F.when(is_last, F.col("next_ts")).when(event_ts.isNotNull(), event_ts)
    return joined.select("event.*", micros_between(event_ts, next_ts).alias(name))


def _numbered(events: DataFrame) -> DataFrame:
    """event (a struct of all columns) and number, different for every row. Numbers are read
    twice, and depend on how the rows came: so they are written out once."""
    path = fresh_path(events.sparkSession, "events")
    record = F.struct(*[F.col(f"`{column}`") for column in events.columns]).alias("event")
    events.select(record, F.monotonically_increasing_id().alias("number")).write.parquet(path)
    return events.sparkSession.read.parquet(path)


def in_ranges(moments: DataFrame) -> DataFrame:
    """``moments`` with piece, the number of the range by (run, ts) a row is in, as a stored dataset.

    Ranges are made by Spark from a sample of the moments. Each but the last ends with a moment of
    the sample and so is not empty: what follows a range is in the range with the next number.
    """
    spark = moments.sparkSession
    plain, ranged = fresh_path(spark, "moments"), fresh_path(spark, "moment-ranges")
    moments.write.parquet(plain)  # taking the sample reads them once more
    stored = spark.read.schema(moments.schema).parquet(plain)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored.repartitionByRange(pieces, "run", "ts").withColumn("piece", F.spark_partition_id())
    dealt.write.parquet(ranged)
    discard(spark, plain)
    return spark.read.schema(dealt.schema).parquet(ranged)


def followed_moments(moments: DataFrame) -> DataFrame:
    """run, ts, last, next_ts of every moment (run and ts are unique)."""
    placed = in_ranges(moments)
    following = F.lead(F.struct("run", "ts")).over(Window.partitionBy("piece").orderBy("run", "ts"))
    # One row per range, so small that Spark sends it to the moments.
    first = placed.groupBy("piece").agg(F.min(F.struct("run", "ts")).alias("carried"))
    carried = first.select((F.col("piece") - 1).alias("piece"), "carried")
    joined = placed.withColumn("following", following).join(carried, "piece", "left")
    after = F.coalesce("following", "carried")
    next_ts = F.when(after["run"].eqNullSafe(F.col("run")), after["ts"]).alias("next_ts")
    return joined.select("run", "ts", "last", next_ts)

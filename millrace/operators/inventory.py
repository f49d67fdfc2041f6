"""Resource inventory: build it, merge changes into the stored state, extract changed days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import BUSINESS_ZONE, day_text
from millrace.operators.joins import splittable_join
from millrace.sinks.partitions import clustered, write_partitions
from millrace.workspace import discard, fresh_path

# Names of the state's columns, the marker for a NULL stored value, the header
# of the daily extract.
STATE_KEYS = ("crdate", "obj_id")
STATE_VALUES = ("vm_id", "cluster_id", "otype")
NULL_MARKER = "-"
STATE_SCHEMA = "crdate INT, obj_id STRING, vm_id STRING, cluster_id STRING, otype STRING, upd_tv BIGINT"
MARK_SCHEMA = "crdate INT, upd_tv BIGINT"

EXTRACT_COLUMNS = ("dt", "obj_id", "obj_type", "vm_id", "cluster_id")


def one_per_key(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest values, compared from left to right.

    An aggregate, combined on the map side, so many copies of one key are no hot spot.
    """
    best = F.max(F.struct(*values)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")


def build_inventory(hosts: DataFrame, disks: DataFrame, crdate: Column | int) -> DataFrame:
    """``hosts[vm_id, cluster_id]``, ``disks[disk_id, instance_ids]`` -> inventory rows.

    A host is listed as itself. A disk is listed under the greatest instance it is attached
    to that is a known host; disks without one are left out. A host reported by several
    clusters belongs to the greatest.
    """
    known = hosts.groupBy("vm_id").agg(F.max("cluster_id").alias("cluster_id"))
    host_rows = known.select(F.col("vm_id").alias("obj_id"), "vm_id", "cluster_id", F.lit("vm").alias("otype"))
    attached = disks.select(F.col("disk_id").alias("obj_id"), F.explode("instance_ids").alias("vm_id"))
    # One host may have a large share of the disks. Repeated attachments need no step of their
    # own: the aggregate below merges them before its shuffle.
    found = splittable_join(attached, known, ["vm_id"])
    disk_rows = found.withColumn("otype", F.lit("disk"))
    day = F.lit(crdate) if isinstance(crdate, int) else crdate
    listed = host_rows.unionByName(disk_rows).withColumn("crdate", day)
    return one_per_key(listed, STATE_KEYS, STATE_VALUES)


def upsert_changed(
    state: DataFrame,
    incoming: DataFrame,
    stamp: Column | int,
    keys: Sequence[str] = STATE_KEYS,
    compare: Sequence[str] = STATE_VALUES,
    stamp_column: str = "upd_tv",
    null_safe: bool = False,
    flag: str | None = None,
) -> DataFrame:
    """Merge a batch into the state and stamp what is new or changed; returns the new state.

    A stored NULL compares as ``-`` and an incoming NULL never counts as a change, so a key
    whose columns differ only that way keeps its row and its stamp. ``null_safe`` compares
    NULL as a value instead.

    State and batch are stacked and grouped by key: one shuffle removes duplicates within
    the batch, finds the partner in the state and decides, where a join for the comparison
    and another for the merge would take three. At most two rows per key and map task are
    shuffled. Of several rows for one key in a batch the greatest wins. ``flag`` names a further
    column that tells which rows are new or changed.
    """
    stored = state.select(
        *keys, F.struct(*compare, stamp_column).alias("old"), F.lit(None).cast(_struct_type(state, compare)).alias("new")
    )
    batch = incoming.select(
        *keys,
        F.lit(None).cast(_struct_type(state, [*compare, stamp_column])).alias("old"),
        F.struct(*[F.col(name).cast(state.schema[name].dataType).alias(name) for name in compare]).alias("new"),
    )
    merged = stored.unionByName(batch).groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    if null_safe:
        differs = [~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}")) for name in compare]
    else:
        differs = [
            F.coalesce(F.col(f"old.{name}"), F.lit(NULL_MARKER)) != F.col(f"new.{name}") for name in compare
        ]
    is_listed = F.col("new").isNotNull()
    changed = F.coalesce(is_listed & (F.col("old").isNull() | reduce(Column.__or__, differs)), F.lit(False))
    stamp_type = state.schema[stamp_column].dataType
    return merged.select(
        *keys,
        *[F.when(changed, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name) for name in compare],
        F.when(changed, F.lit(stamp).cast(stamp_type)).otherwise(F.col(f"old.{stamp_column}")).alias(stamp_column),
        *([changed.alias(flag)] if flag else []),
    )


def _struct_type(df: DataFrame, names: Sequence[str]) -> str:
    fields = ", ".join(f"{name}: {df.schema[name].dataType.simpleString()}" for name in names)
    return f"struct<{fields}>"


def merge_day(spark: SparkSession, path: str, incoming: DataFrame, crdate: int, stamp: int, **options) -> str:
    """Merge one day's batch into the state stored under ``path``, partitioned by ``crdate``.

    Only that day's partition is read and rewritten. The new content is staged in the shared
    folder first, as a partition cannot be replaced by a plan that reads it; if the swap is
    interrupted the staged copy is complete and the job can run again.
    """
    state = spark.read.schema(state_schema(incoming)).parquet(path).where(F.col("crdate") == crdate)
    batch = incoming.where(F.col("crdate") == crdate)
    staged = fresh_path(spark, "state")
    upsert_changed(state, batch, stamp, **options).write.parquet(staged)
    write_partitions(spark.read.parquet(staged), path, ["crdate"], conflict="replace", cluster=False)
    discard(spark, staged)
    return path


def merge_days(
    spark: SparkSession, path: str, incoming: DataFrame, stamp: int, tasks: int | None = None, **options
) -> DataFrame:
    """Merge a batch of any number of days into the state stored under ``path``, partitioned by
    ``crdate``; returns the days that were replaced, with ``n_changed`` rows each.

    Of the state only the days of the batch are read: they are a small table that prunes the
    partitions when the scan starts, whatever their number. Of these only days with a new or
    changed row are replaced, so a batch that says what is known already rewrites nothing. The
    new content is staged first, as partitions cannot be replaced by a plan that reads them; a
    run that dies leaves every day either old or new, and can be run again. Rows without a day
    belong to none and take no part. ``tasks`` deals many small days to that many tasks.
    """
    columns = [*STATE_KEYS, *STATE_VALUES]
    listed, staged, counted = (fresh_path(spark, label) for label in ("days", "state", "changed-days"))
    batch = incoming.where("crdate IS NOT NULL").select(*columns)
    batch.select("crdate").distinct().coalesce(1).write.parquet(listed)
    days = spark.read.schema(batch.select("crdate").schema).parquet(listed)
    state = days_of(spark.read.schema(state_schema(incoming)).parquet(path), days)
    upsert_changed(state, batch, stamp, flag="changed", **options).write.parquet(staged)
    merged = spark.read.parquet(staged)
    changes = merged.groupBy("crdate").agg(F.count_if("changed").alias("n_changed"))
    changes.where("n_changed > 0").coalesce(1).write.parquet(counted)
    replaced = spark.read.schema("crdate INT, n_changed BIGINT").parquet(counted)
    # One day may hold most of the state.
    rows = splittable_join(merged.drop("changed"), replaced.select("crdate"), ["crdate"])
    write_partitions(rows, path, ["crdate"], conflict="replace", tasks=tasks)
    for path_of_copy in (listed, staged):
        discard(spark, path_of_copy)
    return replaced


def days_of(state: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of ``state`` on the given days, one row each. On a state partitioned by ``crdate`` the
    days prune the partitions read; stating their range tells Spark that it is worth it."""
    first, last = days.agg(F.min("crdate")).scalar(), days.agg(F.max("crdate")).scalar()
    return state.join(days.where((F.col("crdate") >= first) & (F.col("crdate") <= last)), "crdate", "left_semi")


def create_state(spark: SparkSession, path: str, schema: str = STATE_SCHEMA) -> str:
    """An empty state, before the first batch."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("crdate").parquet(path)
    return path


def state_schema(inventory: DataFrame, stamp_column: str = "upd_tv") -> str:
    """Declared columns of a stored state that holds such inventory rows."""
    columns = [f"{name} {inventory.schema[name].dataType.simpleString()}" for name in (*STATE_KEYS, *STATE_VALUES)]
    return ", ".join([*columns, f"{stamp_column} bigint"])


def changed_days(state: DataFrame, marks: DataFrame) -> DataFrame:
    """Days whose newest stamp is later than the mark saved by the last extract.

    Both sides are one row per day before they meet.
    """
    newest = state.groupBy("crdate").agg(F.max("upd_tv").alias("upd_tv"))
    saved = marks.groupBy("crdate").agg(F.max("upd_tv").alias("mark"))
    return (
        newest.join(saved, "crdate", "left")
        .where(F.coalesce("mark", F.lit(0)) < F.coalesce("upd_tv", F.lit(0)))
        .select("crdate", "upd_tv")
    )


def daily_extract(state: DataFrame, days: DataFrame) -> DataFrame:
    """Dictionary rows of the given days.

    ``days`` is one row per day, so the semi-join side is small; on a state partitioned by
    ``crdate`` it also prunes the partitions read.
    """
    return state.join(days.select("crdate"), "crdate", "left_semi").select(
        day_text(F.col("crdate")).alias("dt"), "obj_id", F.col("otype").alias("obj_type"), "vm_id", "cluster_id"
    )


def write_extract(extract: DataFrame, path: str, tasks: int | None = None) -> str:
    """Replace the days of an extract under ``path``: one folder per day, CSV with a header,
    each file ordered by object.

    Days are gathered and, where one holds most of the objects, split by adaptive execution; so
    the extract is computed once, with no sample for ranges. ``tasks`` deals the days to that
    many instead, for many small days, whose files take longer to open than to fill. The folder is named by a copy of
    the day, as partition columns are not written into the files and ``dt`` is part of the format.
    """
    dated = clustered(extract.withColumn("day", F.regexp_replace("dt", "-", "")), ["day"], tasks)
    # The sort starts with the folder, as a partitioned write asks for and would sort by again.
    dated = dated.sortWithinPartitions("day", "dt", "obj_id")
    writer = dated.write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("header", "true").csv(path)
    return path


def order_inside_files(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of each file of a dataset that is read with CSV or text, and how many of them are less by
    ``order`` than the row before them in the file.

    The place of a row is the split of its file, and how many rows the task has read before it.
    Rows are compared within splits; between splits, one row each, the last key is carried on.
    """
    placed = rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("begin"),
        F.monotonically_increasing_id().alias("place"),
        F.struct(*order).alias("key"),
    )
    inside = Window.partitionBy("file", "begin").orderBy("place")
    steps = placed.withColumn("less", F.col("key") < F.lag("key").over(inside))
    splits = steps.groupBy("file", "begin").agg(
        F.count("*").alias("n_rows"), F.count_if("less").alias("less"),
        F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"),
    )
    along = Window.partitionBy("file").orderBy("begin")
    joint = F.coalesce((F.col("first") < F.lag("last").over(along)).cast("bigint"), F.lit(0))
    return splits.withColumn("joint", joint).groupBy("file").agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.col("less") + F.col("joint")).alias("out_of_order")
    )


def recent_days(now: dt.datetime | None = None) -> list[int]:
    """Yesterday and today as the business counts days, the days a regular extract looks at."""
    now = now or dt.datetime.now(dt.timezone.utc)
    local = (now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)).astimezone(ZoneInfo(BUSINESS_ZONE))
    return [int((local - dt.timedelta(days=back)).strftime("%Y%m%d")) for back in (1, 0)]


def extract_changed(
    spark: SparkSession,
    state: DataFrame,
    marks_path: str,
    path: str,
    only: Sequence[int] | None = None,
    tasks: int | None = None,
) -> str:
    """Extract the changed days, then save their marks.

    ``only`` limits the run to some days, such as ``recent_days()``; on a state partitioned
    by ``crdate`` nothing else is read. ``tasks`` is as in ``write_extract``. The days and stamps are fixed before the extract starts and saved after it ends: a job
    that dies in between extracts the same days again and overwrites them.
    """
    if only is not None:
        state = state.where(F.col("crdate").isin(list(only)))
    staged = fresh_path(spark, "days")
    changed_days(state, read_marks(spark, marks_path)).repartition(1).write.parquet(staged)
    days = spark.read.schema(MARK_SCHEMA).parquet(staged)
    write_extract(daily_extract(state, days), path, tasks)
    save_marks(days, marks_path)
    discard(spark, staged)
    return path


def save_marks(marks: DataFrame, path: str) -> str:
    """Replace the marks of the given days, one row each, and keep those of other days.

    The store is one small dataset, written anew under the next version and freed of the earlier
    ones; a run that dies in between leaves both, which say the same, as stamps only grow.
    """
    spark = marks.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    known = [entry.getPath() for entry in files.listStatus(folder)] if files.exists(folder) else []
    earlier = {int(entry.getName().removeprefix("version=")): entry for entry in known if entry.getName().startswith("version=")}
    new = marks.select("crdate", "upd_tv")
    merged = read_marks(spark, path).unionByName(new) if earlier else new
    latest = merged.groupBy("crdate").agg(F.max("upd_tv").alias("upd_tv"))
    latest.coalesce(1).write.parquet(f"{path}/version={max(earlier, default=0) + 1}")
    for entry in earlier.values():
        files.delete(entry, True)
    return path


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """The saved marks, ``crdate`` and ``upd_tv``. Create the store with ``create_marks``."""
    stored = spark.read.schema(f"{MARK_SCHEMA}, version INT").parquet(path)
    return stored.groupBy("crdate").agg(F.max("upd_tv").alias("upd_tv"))


def create_marks(spark: SparkSession, path: str) -> str:
    """An empty store of marks, before the first extract."""
    spark.createDataFrame([], MARK_SCHEMA).coalesce(1).write.mode("ignore").parquet(f"{path}/version=0")
    return path

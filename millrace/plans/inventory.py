"""Inventory jobs over the given tables: suppliers as hosts, line items as disks, orders as
observations of resources by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import day_number
from millrace.operators import inventory
from millrace.plans.tools import file_tasks
from millrace.sinks.partitions import write_partitions
from millrace.sources.tables import literal_rows, read_csv, table
from millrace.workspace import fresh_path


def inventory_build(spark: SparkSession, directory: str) -> DataFrame:
    """Suppliers are hosts; each line item attaches a part, as a disk, to its supplier and the
    next one, which for the last supplier is no known host."""
    hosts = table(spark, directory, "supplier").select(
        F.concat(F.lit("vm-"), F.col("s_suppkey").cast("string")).alias("vm_id"),
        F.concat(F.lit("c-"), F.col("s_nationkey").cast("string")).alias("cluster_id"),
    )
    disks = table(spark, directory, "lineitem").select(
        F.concat(F.lit("disk-"), F.col("l_partkey").cast("string")).alias("disk_id"),
        F.array(
            F.concat(F.lit("vm-"), F.col("l_suppkey").cast("string")),
            F.concat(F.lit("vm-"), (F.col("l_suppkey") + 1).cast("string")),
        ).alias("instance_ids"),
    )
    return inventory.build_inventory(hosts, disks, 20240131)


def _observations(spark: SparkSession, directory: str) -> DataFrame:
    """Orders as resources seen on a day; one priority stands for an unknown cluster."""
    return table(spark, directory, "orders").select(
        day_number(F.col("o_orderdate")).alias("crdate"),
        F.col("o_custkey").cast("string").alias("obj_id"),
        F.concat(F.lit("vm-"), F.col("o_orderkey").cast("string")).alias("vm_id"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("cluster_id"),
        F.lit("vm").alias("otype"),
        "o_orderstatus",
        F.col("o_orderkey").alias("upd_tv"),
    )


def _event_observations(spark: SparkSession, directory: str) -> DataFrame:
    """Events as resources seen on a day, in the form of the above: users, whose kind of event
    stands for the cluster. Few days with many resources each."""
    return table(spark, directory, "events").select(
        day_number(F.col("ts")).alias("crdate"),
        F.col("user_id").cast("string").alias("obj_id"),
        F.concat(F.lit("vm-"), F.col("event_id").cast("string")).alias("vm_id"),
        F.nullif(F.col("event_type"), F.lit("view")).alias("cluster_id"),
        F.lit("vm").alias("otype"),
        F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("event_id") % 3 + 1).cast("int")).alias("o_orderstatus"),
        F.col("event_id").alias("upd_tv"),
    )


def _state(spark: SparkSession, directory: str, observations=_observations) -> DataFrame:
    """What an earlier run stored: finished and pending orders, clusters unknown for the latter."""
    seen = observations(spark, directory).where("o_orderstatus <> 'O'")
    stored = seen.withColumn("cluster_id", F.when(F.col("o_orderstatus") == "F", F.col("cluster_id")))
    return inventory.one_per_key(stored, inventory.STATE_KEYS, inventory.STATE_VALUES).withColumn(
        "upd_tv", F.lit(1).cast("bigint")
    )


def inventory_upsert(spark: SparkSession, directory: str) -> DataFrame:
    """All orders come in: open ones are new, pending ones have changed their cluster."""
    incoming = _observations(spark, directory)
    return inventory.upsert_changed(_state(spark, directory), incoming, 2)


def inventory_upsert_null_safe(spark: SparkSession, directory: str) -> DataFrame:
    incoming = _observations(spark, directory)
    return inventory.upsert_changed(_state(spark, directory), incoming, 2, null_safe=True)


# Days that the stored upserts below merge, and rows that come in as values.
MERGED_DAY, MERGED_EVENT_DAY = 19960115, 20240115


def _literals(day: int) -> list[tuple]:
    return [(day, "new-1", "vm-new", "c-new", "vm"), (day, "new-2", "vm-new", None, "disk"), (1, "x", "vm-new", "c", "vm")]


def _merged_day(spark: SparkSession, directory: str, day: int, observations) -> DataFrame:
    """One day's observations and some literal rows merged into the stored state, all of it read back."""
    path = _stored_state(spark, directory, observations)
    seen = observations(spark, directory).select(*inventory.STATE_KEYS, *inventory.STATE_VALUES)
    incoming = seen.unionByName(literal_rows(spark, _literals(day), seen.schema))
    inventory.merge_day(spark, path, incoming, day, 2)
    return _read_state(spark, path, seen)


def _stored_state(spark: SparkSession, directory: str, observations=_observations) -> str:
    state = _state(spark, directory, observations)
    return write_partitions(state, fresh_path(spark, "state"), ["crdate"], "append", tasks=file_tasks(spark))


def _read_state(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    stored = spark.read.schema(inventory.state_schema(seen)).parquet(path)
    return stored.select(*inventory.STATE_KEYS, *inventory.STATE_VALUES, "upd_tv")


def inventory_merge(spark: SparkSession, directory: str) -> DataFrame:
    return _merged_day(spark, directory, MERGED_DAY, _observations)


def inventory_merge_events(spark: SparkSession, directory: str) -> DataFrame:
    return _merged_day(spark, directory, MERGED_EVENT_DAY, _event_observations)


def merge_days(spark: SparkSession, directory: str) -> DataFrame:
    """All orders and one new day come into the stored state at once; all of it read back, with
    whether the files of the row's day were replaced."""
    path = _stored_state(spark, directory)
    seen = _observations(spark, directory).select(*inventory.STATE_KEYS, *inventory.STATE_VALUES)
    incoming = seen.unionByName(literal_rows(spark, _literals(MERGED_DAY), seen.schema))
    before, columns = fresh_path(spark, "files"), [F.col("crdate"), F.col("_metadata.file_name").alias("file")]
    spark.read.schema(inventory.state_schema(seen)).parquet(path).select(*columns).distinct().write.parquet(before)
    inventory.merge_days(spark, path, incoming, 2, tasks=file_tasks(spark))
    old = spark.read.parquet(before).withColumn("kept", F.lit(True))
    stored = spark.read.schema(inventory.state_schema(seen)).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    replaced = F.col("kept").isNull().alias("replaced")
    return stored.join(old, ["crdate", "file"], "left").select(*inventory.STATE_KEYS, *inventory.STATE_VALUES, "upd_tv", replaced)


def _days(spark: SparkSession, directory: str, observations=_observations) -> tuple[DataFrame, DataFrame]:
    """State, and the marks an extract would have saved before the open orders arrived."""
    state = observations(spark, directory)
    marks = state.where("o_orderstatus <> 'O'").groupBy("crdate").agg(F.max("upd_tv").alias("upd_tv"))
    return state, marks


def changed_days(spark: SparkSession, directory: str) -> DataFrame:
    return inventory.changed_days(*_days(spark, directory))


def _extracted(spark: SparkSession, state: DataFrame, marks: DataFrame) -> DataFrame:
    """The extract of the changed days of a stored state, written as CSV by day and read back."""
    latest = inventory.one_per_key(state, inventory.STATE_KEYS, ("upd_tv", "vm_id", "cluster_id", "otype"))
    tasks = file_tasks(spark)
    state_path = write_partitions(latest, fresh_path(spark, "state"), ["crdate"], "append", tasks=tasks)
    stored = spark.read.schema(inventory.state_schema(latest)).parquet(state_path)
    marks_path = inventory.save_marks(marks, fresh_path(spark, "marks"))
    path = inventory.extract_changed(spark, stored, marks_path, fresh_path(spark, "extract"), tasks=tasks)
    columns = ", ".join(f"{name} STRING" for name in inventory.EXTRACT_COLUMNS)
    return read_csv(spark, path, columns)


def daily_extract(spark: SparkSession, directory: str) -> DataFrame:
    return _extracted(spark, *_days(spark, directory)).select(*inventory.EXTRACT_COLUMNS)


def daily_extract_events(spark: SparkSession, directory: str) -> DataFrame:
    """Few days, of which those with an odd number were extracted before."""
    state, marks = _days(spark, directory, _event_observations)
    marks = marks.where("crdate % 2 = 0").unionByName(state.groupBy("crdate").agg(F.max("upd_tv").alias("upd_tv")).where("crdate % 2 = 1"))
    return _extracted(spark, state, marks).select(*inventory.EXTRACT_COLUMNS)


def extract_order(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of the extract of days with many resources, and those that come before a smaller one in their file."""
    extract = _extracted(spark, *_days(spark, directory, _event_observations))
    return inventory.order_inside_files(extract, ["dt", "obj_id"]).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("out_of_order").alias("out_of_order")
    )


QUERIES = {
    "inventory_build": inventory_build,
    "inventory_upsert": inventory_upsert,
    "inventory_upsert_null_safe": inventory_upsert_null_safe,
    "inventory_merge": inventory_merge,
    "inventory_merge_events": inventory_merge_events,
    "merge_days": merge_days,
    "changed_days": changed_days,
    "daily_extract": daily_extract,
    "daily_extract_events": daily_extract_events,
    "extract_order": extract_order,
}

_OBSERVATIONS = """
    SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS crdate, CAST(o_custkey AS VARCHAR) AS obj_id,
           'vm-' || o_orderkey AS vm_id, nullif(o_orderpriority, '4-NOT SPECIFIED') AS cluster_id,
           'vm' AS otype, o_orderstatus, o_orderkey AS upd_tv
    FROM orders"""


_EVENT_OBSERVATIONS = """
    SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS crdate, CAST(user_id AS VARCHAR) AS obj_id,
           'vm-' || event_id AS vm_id, nullif(event_type, 'view') AS cluster_id, 'vm' AS otype,
           ['F', 'O', 'P'][event_id % 3 + 1] AS o_orderstatus, event_id AS upd_tv
    FROM events"""


def _upsert_sql(differs: str, more: str = "", listed: str = "TRUE", observations: str = _OBSERVATIONS) -> str:
    """``more`` rows come in besides the observations, and only those that ``listed`` names."""
    return f"""
        WITH seen AS ({observations}),
        base AS (
            SELECT crdate, obj_id, vm_id, cluster_id, otype, 1 AS upd_tv FROM (
                SELECT crdate, obj_id, vm_id, otype,
                       CASE WHEN o_orderstatus = 'F' THEN cluster_id END AS cluster_id,
                       row_number() OVER (PARTITION BY crdate, obj_id ORDER BY vm_id DESC) AS rn
                FROM seen WHERE o_orderstatus <> 'O') x
            WHERE rn = 1),
        inc AS (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY crdate, obj_id ORDER BY vm_id DESC) AS rn
                FROM (SELECT crdate, obj_id, vm_id, cluster_id, otype FROM seen {more}) y WHERE {listed}) x
            WHERE rn = 1),
        chg AS (
            SELECT i.* FROM inc i LEFT JOIN base r ON r.crdate = i.crdate AND r.obj_id = i.obj_id
            WHERE r.crdate IS NULL OR {differs})
        SELECT COALESCE(c.crdate, b.crdate) AS crdate, COALESCE(c.obj_id, b.obj_id) AS obj_id,
               CASE WHEN c.obj_id IS NOT NULL THEN c.vm_id ELSE b.vm_id END AS vm_id,
               CASE WHEN c.obj_id IS NOT NULL THEN c.cluster_id ELSE b.cluster_id END AS cluster_id,
               CASE WHEN c.obj_id IS NOT NULL THEN c.otype ELSE b.otype END AS otype,
               CAST(CASE WHEN c.obj_id IS NOT NULL THEN 2 ELSE b.upd_tv END AS BIGINT) AS upd_tv
        FROM base b FULL OUTER JOIN chg c ON b.crdate = c.crdate AND b.obj_id = c.obj_id"""


def _changed_sql(observations: str, marked: str = "o_orderstatus <> 'O'") -> str:
    """``marked`` rows were there before the last extract."""
    return f"""
    seen AS ({observations}),
    marks AS (SELECT crdate, MAX(upd_tv) AS mark FROM seen WHERE {marked} GROUP BY crdate),
    changed AS (
        SELECT s.crdate, s.upd_tv FROM (SELECT crdate, MAX(upd_tv) AS upd_tv FROM seen GROUP BY crdate) s
        LEFT JOIN marks m ON m.crdate = s.crdate
        WHERE COALESCE(m.mark, 0) < COALESCE(s.upd_tv, 0))"""


# Something came in, and it is not what is stored or the marker for nothing stored.
_MARKED = " OR ".join(
    f"i.{name} IS NOT NULL AND i.{name} <> COALESCE(r.{name}, '{inventory.NULL_MARKER}')" for name in inventory.STATE_VALUES
)


def _literals_sql(day: int) -> str:
    rows = ", ".join(f"({', '.join('NULL' if v is None else repr(v) for v in row)})" for row in _literals(day))
    return f"UNION ALL VALUES {rows}"


def _extract_sql(observations: str, marked: str = "o_orderstatus <> 'O'") -> str:
    return f"""
        WITH {_changed_sql(observations, marked)}
        SELECT dt, obj_id, obj_type, vm_id, cluster_id FROM (
            SELECT strftime(strptime(CAST(s.crdate AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS dt, s.obj_id,
                   s.otype AS obj_type, s.vm_id, s.cluster_id,
                   row_number() OVER (PARTITION BY s.crdate, s.obj_id ORDER BY s.upd_tv DESC) AS rn
            FROM seen s JOIN changed c ON c.crdate = s.crdate) x
        WHERE rn = 1"""


_MERGED_SQL = _upsert_sql(_MARKED, _literals_sql(MERGED_DAY))


ORACLES = {
    "inventory_build": """
        WITH hosts AS (
            SELECT 'vm-' || s_suppkey AS vm_id, 'c-' || s_nationkey AS cluster_id
            FROM supplier),
        disks AS (
            SELECT 'disk-' || l_partkey AS obj_id, unnest(['vm-' || l_suppkey, 'vm-' || (l_suppkey + 1)]) AS vm_id
            FROM lineitem),
        best AS (
            SELECT d.obj_id, MAX(d.vm_id) AS vm_id FROM disks d JOIN hosts h ON h.vm_id = d.vm_id GROUP BY 1)
        SELECT CAST(20240131 AS INTEGER) AS crdate, vm_id AS obj_id, vm_id, cluster_id, 'vm' AS otype FROM hosts
        UNION ALL
        SELECT CAST(20240131 AS INTEGER), b.obj_id, b.vm_id, h.cluster_id, 'disk'
        FROM best b JOIN hosts h ON h.vm_id = b.vm_id""",
    "inventory_upsert": _upsert_sql(_MARKED),
    "inventory_upsert_null_safe": _upsert_sql(" OR ".join(f"i.{name} IS DISTINCT FROM r.{name}" for name in inventory.STATE_VALUES)),
    "inventory_merge": _upsert_sql(_MARKED, _literals_sql(MERGED_DAY), f"crdate = {MERGED_DAY}"),
    "inventory_merge_events": _upsert_sql(
        _MARKED, _literals_sql(MERGED_EVENT_DAY), f"crdate = {MERGED_EVENT_DAY}", _EVENT_OBSERVATIONS
    ),
    "merge_days": f"""
        SELECT *, max(upd_tv = 2) OVER (PARTITION BY crdate) AS replaced FROM ({_MERGED_SQL}) m""",
    "changed_days": f"WITH {_changed_sql(_OBSERVATIONS)} SELECT crdate, upd_tv FROM changed",
    "daily_extract": _extract_sql(_OBSERVATIONS),
    "daily_extract_events": _extract_sql(_EVENT_OBSERVATIONS, "o_orderstatus <> 'O' OR crdate % 2 = 1"),
    "extract_order": f"""
        SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS out_of_order FROM ({_extract_sql(_EVENT_OBSERVATIONS)}) e""",
}

"""Cost lines -> clusters and projects, and their rollup."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from millrace.functions.scalars import non_empty, quoted
from millrace.operators.joins import splittable_join
from millrace.sources.tables import read_csv, read_declared
from millrace.workspace import fresh_path

# Names of the label columns in a billing export, the text for "no match",
# and the columns of a cost line that the attributed output keeps.
CLUSTER_LABEL = "label.user_labels.cluster_id"
PROJECT_LABEL = "label.user_labels.project_id"
UNMATCHED = "-"
COST_COLUMNS = (
    "cloud_name",
    "folder_name",
    "resource_id",
    "service_name",
    "sku_name",
    "date",
    "currency",
    "pricing_quantity",
    "pricing_unit",
    "cost",
    "credit",
    "monetary_grant_credit",
    "volume_incentive_credit",
    "cud_credit",
    "misc_credit",
)

# The columns of the two CSV inputs and their types.
BILLING_SCHEMA = f"""
    cloud_name STRING, folder_name STRING, resource_id STRING, service_name STRING, sku_name STRING,
    date DATE, currency STRING, pricing_quantity DECIMAL(28,10), pricing_unit STRING,
    cost DECIMAL(28,10), credit DECIMAL(28,10), monetary_grant_credit DECIMAL(28,10),
    volume_incentive_credit DECIMAL(28,10), cud_credit DECIMAL(28,10), misc_credit DECIMAL(28,10),
    `{CLUSTER_LABEL}` STRING, `{PROJECT_LABEL}` STRING
"""
DICTIONARY_SCHEMA = "dt DATE, obj_id STRING, obj_type STRING, vm_id STRING, cluster_id STRING"


def read_billing(spark: SparkSession, path: str) -> DataFrame:
    """Billing exports: CSV files with a header. Columns are found by name in each file, as an
    export may hold more of them in any order; a label no resource has is absent and reads as NULL.

    All files are one scan, by place of the column. Which place a field has in a file comes from the
    table of headers, which meets the rows by file; where all files have one header nothing is
    joined and only the columns asked for are parsed.
    """
    headers = file_headers(spark, path)
    known = [row.header for row in headers.select("header").distinct().orderBy("header").collect()]
    fields = StructType.fromDDL(BILLING_SCHEMA)
    if not known:
        return spark.createDataFrame([], fields)
    layouts = {header: next(csv.reader([header.removeprefix("\ufeff")])) for header in known}
    width = max(map(len, layouts.values()))
    declared = ", ".join(f"`{place}` STRING" for place in range(width))
    raw = read_declared(spark, path, declared, "csv", header="true", enforceSchema="true")
    places = {header: [names.index(f.name) if f.name in names else None for f in fields] for header, names in layouts.items()}
    if len(known) == 1:
        cells = [F.lit(None) if place is None else F.col(f"`{place}`") for place in places[known[0]]]
        return raw.select(*[cell.cast(field.dataType).alias(field.name) for cell, field in zip(cells, fields)])
    table = spark.createDataFrame(list(places.items()), "header STRING, places ARRAY<INT>")
    by_file = headers.join(table, "header").select("file", "places")
    cells = raw.select(F.array(*[F.col(f"`{place}`") for place in range(width)]).alias("cells"), F.col("_metadata.file_path").alias("file"))
    placed = splittable_join(cells, by_file, ["file"])  # one file may hold most of the lines
    return placed.select(
        *[F.get("cells", F.get("places", F.lit(i))).cast(field.dataType).alias(field.name) for i, field in enumerate(fields)]
    )


# Files whose headers are read before they are written down, and how many at a time.
HEADER_FILES, HEADER_THREADS = 1_000, 16


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, header: the first line of each text file under ``path`` that is not empty, as a stored table.

    Of every file only its beginning is read, through Hadoop's file system: a scan would read all
    of it. The names come to the driver some at a time, and go with the headers into the table.
    """
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    stored, schema = fresh_path(spark, "headers"), "file STRING, header STRING"
    spark.createDataFrame([], schema).write.parquet(stored)
    files = (row.file for row in names.toLocalIterator())
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        while some := list(islice(files, HEADER_FILES)):
            found = [pair for pair in zip(some, pool.map(lambda file: _first_line(spark, file), some)) if pair[1] is not None]
            spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(stored)
    return spark.read.schema(schema).parquet(stored)


def _first_line(spark: SparkSession, file: str) -> str | None:
    java, configuration = spark._jvm.java, spark._jsc.hadoopConfiguration()
    place = spark._jvm.org.apache.hadoop.fs.Path(java.net.URI(file))
    stream = place.getFileSystem(configuration).open(place)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(configuration).getCodec(place)
        plain = codec.createInputStream(stream) if codec is not None else stream
        return java.io.BufferedReader(java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Daily dictionary written by the inventory extract."""
    return read_csv(spark, path, DICTIONARY_SCHEMA)


def in_period(day: Column, start: str, end: str) -> Column:
    """Half-open date range; pushed into the scan and, on a partition column, prunes it."""
    return (day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))


def project_labels(
    costs: DataFrame,
    start: str,
    end: str,
    cluster_label: str = CLUSTER_LABEL,
    project_label: str = PROJECT_LABEL,
) -> DataFrame:
    """``dt, cluster_id, project_id`` once each, from the labels on the cost lines.

    Reads three columns; duplicates are dropped on the map side.
    """
    labelled = costs.where(
        in_period(F.col("date"), start, end) & non_empty(quoted(cluster_label)) & non_empty(quoted(project_label))
    )
    return labelled.select(
        F.col("date").alias("dt"),
        quoted(cluster_label).alias("cluster_id"),
        quoted(project_label).alias("project_id"),
    ).distinct()


def attribute_costs(
    costs: DataFrame,
    inventory: DataFrame,
    labels: DataFrame,
    start: str,
    end: str,
    keep: Sequence[str] = COST_COLUMNS,
    with_fan_out: bool = False,
) -> DataFrame:
    """Cost lines of a period with ``cluster_id`` and ``project_id``, ``-`` where unmatched.

    A cluster with several projects on a day yields one row per project for each of its
    lines; ``with_fan_out`` adds how many. ``inventory`` holds one row per (dt, obj_id).

    Two left joins in a row would shuffle the cost lines twice, the second time with every
    unmatched line in one partition under a NULL key. The second join depends on the
    inventory only, so inventory and labels are joined first (one cluster may have most of the
    resources) and the cost lines are shuffled once, by (date, resource). Both
    inputs of that join are plain shuffles, which is the shape adaptive execution can split
    when one resource holds a large share of the lines.
    """
    names = labels
    if with_fan_out:
        # The projects of one cluster and day, not its cost lines.
        names = labels.withColumn("fan_out", F.count("*").over(Window.partitionBy("dt", "cluster_id")))
    wanted = inventory.where(in_period(F.col("dt"), start, end)).select("dt", "obj_id", "cluster_id")
    resources = splittable_join(wanted, names, ["dt", "cluster_id"], "left")
    lines = costs.where(in_period(F.col("date"), start, end)).select(*[quoted(name) for name in keep])
    matched = lines.join(
        resources, (lines["date"] == resources["dt"]) & (lines["resource_id"] == resources["obj_id"]), "left"
    )
    fan_out = [F.coalesce("fan_out", F.lit(1)).alias("fan_out")] if with_fan_out else []
    return matched.select(
        F.coalesce("cluster_id", F.lit(UNMATCHED)).alias("cluster_id"),
        F.coalesce("project_id", F.lit(UNMATCHED)).alias("project_id"),
        *[lines[name] for name in keep],
        *fan_out,
    )


def line_fan_out(attributed: DataFrame, line_key: Sequence[str]) -> DataFrame:
    """Add ``fan_out``, the number of rows a cost line became, by counting its key.

    For frames attributed elsewhere: every line is shuffled once by its key, which must be
    unique among the cost lines. ``attribute_costs`` with ``with_fan_out`` gives the same
    from the labels alone.

    The shuffle is explicit. Left to itself, Spark would count within the coarser partitions
    of the attribution's join, and then could not split that join for a hot resource.
    """
    by_line = attributed.repartition(*line_key)
    return by_line.withColumn("fan_out", F.count("*").over(Window.partitionBy(*line_key)))


def cost_rollup(
    attributed: DataFrame,
    by: Sequence[str],
    line_key: Sequence[str] | None = None,
    sums: Sequence[str] = ("cost",),
) -> DataFrame:
    """Decimal sums by the given columns, the number of rows, and the number of rows that
    are one of several copies of a cost line (0 when nothing is counted twice).

    ``line_key`` is only needed when ``attributed`` has no ``fan_out`` column. Decimal
    columns are summed as they are, others as DECIMAL(28,6).
    """
    rows = line_fan_out(attributed, line_key) if line_key else attributed
    return rows.groupBy(*by).agg(
        *[F.sum(_exact(rows, name)).alias(name) for name in sums],
        F.count("*").alias("n_lines"),
        F.count_if(F.col("fan_out") > 1).alias("fan_out"),
    )


def _exact(df: DataFrame, name: str) -> Column:
    is_decimal = isinstance(df.schema[name].dataType, DecimalType)
    return quoted(name) if is_decimal else quoted(name).cast("decimal(28,6)")


def map_projects(costs: DataFrame, mapping: DataFrame, name: str = "project_id") -> DataFrame:
    """Add the project of ``cluster_id`` on ``date``.

    ``mapping`` is a table of ``valid_on, cluster_id, project_id``; a row without a date is
    valid always, and a row for the very day wins over it. Spark broadcasts a mapping below
    its size threshold, and shuffles a larger one. One cluster may have a large share of the
    costs: both joins can be split, which they could not if Spark ran them in one stage, as it
    would for the costs of a single day.
    """
    dated = F.col("valid_on").isNotNull()
    daily = mapping.where(dated).select(
        "cluster_id", F.col("valid_on").cast("date").alias("date"), F.col("project_id").alias("daily_project")
    )
    always = mapping.where(~dated).select("cluster_id", F.col("project_id").alias("usual_project"))
    by_day = splittable_join(costs, daily, ["cluster_id", "date"], "left")
    found = splittable_join(by_day, always, ["cluster_id"], "left")
    project = F.coalesce("daily_project", "usual_project").alias(name)
    return found.select(*[quoted(column) for column in costs.columns], project)

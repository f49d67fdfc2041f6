"""Readers over files and the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a directory of tables."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def temp_views(spark: SparkSession, directory: str, names: Sequence[str], prefix: str = "") -> list[str]:
    """Register tables of a directory as temporary views, for queries in SQL."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in names]


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A few rows given as values, as a table with a declared schema."""
    return spark.createDataFrame(list(rows), schema)


def first_rows(spark: SparkSession, path: str, count: int) -> DataFrame:
    """SQL straight over a Parquet path, any ``count`` rows."""
    return spark.sql(f"SELECT * FROM parquet.`{path}` LIMIT {int(count)}")


def read_glob(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """Parquet files of a directory whose names match a pattern."""
    return spark.read.option("pathGlobFilter", pattern).parquet(directory)


def read_declared(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str,
    file_format: str = "parquet",
    **options: str,
) -> DataFrame:
    """Files read with a declared schema: no inference pass, columns outside it are not read."""
    return spark.read.schema(schema).options(**options).format(file_format).load(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header line and declared columns."""
    return read_declared(spark, path, schema, "csv", header="true")


def external_table(
    spark: SparkSession,
    name: str,
    columns: str | None,
    path: str,
    file_format: str = "parquet",
    partitioned_by: str | None = None,
) -> DataFrame:
    """Declare a catalog table over existing files and open it.

    The declared columns may be fewer than the stored ones; without them they are inferred
    from the files. Dropping the table leaves the files. An external table of that name is
    declared anew; anything else of that name is left alone, and refused.
    """
    if spark.catalog.tableExists(name):
        kind = spark.catalog.getTable(name).tableType
        if kind != "EXTERNAL":
            raise ValueError(f"{name} exists and is {kind}, not EXTERNAL")
        spark.sql(f"DROP TABLE {name}")
    partitions = f"PARTITIONED BY ({partitioned_by})" if partitioned_by else ""
    declared = f"({columns})" if columns else ""
    spark.sql(f"CREATE TABLE {name} {declared} USING {file_format} {partitions} LOCATION '{path}'")
    return spark.table(name)

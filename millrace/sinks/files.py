"""Whole-directory writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.workspace import discard, fresh_path


# Pieces at least that rows are dealt into for a given number of files.
PIECES = 64


def write_once(df: DataFrame, path: str, file_format: str = "parquet") -> str:
    """Write to a directory that must not exist yet."""
    df.write.format(file_format).mode("errorifexists").save(path)
    return path


def overwrite(df: DataFrame, path: str, file_format: str = "parquet", codec: str | None = None) -> str:
    """Replace the whole directory, whatever partitions it holds."""
    writer = df.write.format(file_format).mode("overwrite").option("partitionOverwriteMode", "static")
    if codec:
        writer = writer.option("compression", codec)
    writer.save(path)
    return path


def append(df: DataFrame, path: str, file_format: str = "parquet") -> str:
    """Add files to the directory."""
    df.write.format(file_format).mode("append").save(path)
    return path


def recompress(
    spark: SparkSession, source: str, target: str, codec: str = "gzip", files: int | None = None
) -> str:
    """Copy a Parquet dataset under another codec.

    Without ``files`` there is no shuffle: each scan task writes what it read, and the scan
    already packs small files and splits large ones by ``spark.sql.files.maxPartitionBytes``.
    ``files`` deals the rows out evenly to that many output files, at the price of one shuffle, into
    pieces as many as a shuffle of the session has, or ``PIECES`` if that is more. They are staged, as a file is written by one
    task: it streams the compressed columns of its pieces, instead of a shuffle of whole rows.
    """
    rows = spark.read.parquet(source)
    if files is None:
        return overwrite(rows, target, "parquet", codec)
    pieces = max(PIECES, int(spark.conf.get("spark.sql.shuffle.partitions"))) // files
    if pieces < 2:
        return overwrite(rows.repartition(files), target, "parquet", codec)
    folder = fresh_path(spark, "pieces")
    try:
        overwrite(rows.repartition(pieces * files), folder, "parquet", "zstd")
        found = spark.read.schema(rows.schema).parquet(folder).inputFiles()
        names = sorted(f"{folder}/{name.rsplit('/', 1)[1]}" for name in found)
        reader = _whole_reads(spark).read.schema(rows.schema)
        dealt = [reader.parquet(*names[k::files]) for k in range(min(files, len(names)))]
        return overwrite(reduce(DataFrame.unionAll, dealt), target, "parquet", codec)
    finally:
        discard(spark, folder)


def _whole_reads(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which each scan is one task."""
    session = spark.newSession()
    whole = {"maxPartitionBytes": 2**62, "openCostInBytes": 0, "minPartitionNum": 1}
    for key, value in {**spark.conf.getAll, **{f"spark.sql.files.{name}": str(n) for name, n in whole.items()}}.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def content_sums(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Row count and named sums over the rows, to compare two copies of a dataset."""
    return df.agg(F.count("*").alias("n_rows"), *[F.sum(expression).alias(name) for name, expression in columns.items()])


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header line in each file."""
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from millrace.workspace import discard, fresh_path

# Words of the corpus operators: runs of bytes that are none of these six.
SPACES = r"\x20\x09-\x0D"


# The folder of every staged frame.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read back: its lineage ends at files that
    every executor reaches, so that the loss of an executor repeats nothing before them."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def drop_staged(*frames: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``frames`` (as it returned them), once nothing reads it any more."""
    for frame in frames:
        discard(frame.sparkSession, _FOLDERS.pop(frame))

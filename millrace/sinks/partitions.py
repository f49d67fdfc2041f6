"""Writers into partitioned datasets, with a choice of what to do about partitions that
already hold data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from millrace.workspace import discard, fresh_path

CONFLICT_MODES = ("fail", "replace", "append")


# The folder of claims beside the partitions; readers skip names that begin like this.
CLAIMS = "_claims"


class PartitionConflict(RuntimeError):
    """Raised by mode ``fail``; nothing was written."""


def clustered(df: DataFrame, keys: Sequence[str], tasks: int | None = None, spread: int = 1) -> DataFrame:
    """Bring rows of a partition together before a partitioned write, to avoid a small file
    per task and partition.

    By default the REBALANCE hint: adaptive execution merges small partitions and splits a
    partition that is far larger than the others, so a month that holds a third of all rows
    is written by many tasks. With ``tasks`` it is a plain REPARTITION by the keys; ``spread``
    is how many of these tasks a partition is dealt to, so that a hot one is not written by one.
    """
    if tasks is not None:
        dealt = [F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in df.columns]), F.lit(spread))] if spread > 1 else []
        return df.repartition(tasks, *keys, *dealt)
    return df.hint("rebalance", *keys)


def conflicting_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Partition keys of ``df`` that already exist under ``path``.

    Both sides are reduced to distinct keys first. The stored side is the listing of the
    directory: no file is opened. NULL is a partition like any other.
    """
    incoming = df.select(*keys).distinct()
    existing = _listed_partitions(df, path, keys)
    if existing is None:
        return incoming.where(F.lit(False))
    same = reduce(Column.__and__, [incoming[key].eqNullSafe(existing[f"_{key}"]) for key in keys])
    return incoming.join(existing, same, "left_semi")


def _listed_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The partitions under ``path`` as ``_key`` columns of the types they have in ``df``; None
    if there is no such directory or nothing in it."""
    spark, inference = df.sparkSession, "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(inference)
    spark.conf.set(inference, "false")  # or a text such as 01 would be listed as a number
    try:
        listed = spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    finally:
        spark.conf.set(inference, before)
    # Without a partition there is no folder to take the keys from.
    if not set(keys) <= set(listed.columns):
        return None
    return listed.select(*[F.col(key).cast(df.schema[key].dataType).alias(f"_{key}") for key in keys]).distinct()


def write_partitions(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    conflict: str = "fail",
    file_format: str = "parquet",
    tasks: int | None = None,
    cluster: bool = True,
    spread: int = 1,
    exclusive: bool = False,
    **options: str,
) -> str:
    """Write into a dataset partitioned by ``keys``.

    Rows of a partition are gathered first; ``cluster=False`` saves that shuffle when every
    task holds few partitions anyway.

    ``fail``     stop before writing if any incoming partition exists (checked once, before
                 the write); if there is any partition yet, incoming rows are computed once, into
                 the shared folder, and checked and written from there;
    ``replace``  swap the content of incoming partitions, leave the others;
    ``append``   add to whatever is there.

    ``exclusive`` claims the incoming partitions for the time of the check and the write, against
    other exclusive writers: whoever finds one claimed is refused and has written nothing.
    """
    if conflict not in CONFLICT_MODES:
        raise ValueError(f"conflict must be one of {CONFLICT_MODES}, not {conflict!r}")
    if exclusive:
        staged = fresh_path(df.sparkSession, "incoming")
        df.write.parquet(staged)
        stored = df.sparkSession.read.schema(df.schema).parquet(staged)
        try:
            with claimed(stored, path, keys):
                if conflict == "fail":
                    _refuse_conflicts(stored, path, keys)
                write = "append" if conflict == "fail" else conflict
                return write_partitions(stored, path, keys, write, file_format, tasks, cluster, spread, **options)
        finally:
            discard(df.sparkSession, staged)
    if conflict == "fail" and _listed_partitions(df, path, keys) is not None:
        staged = fresh_path(df.sparkSession, "incoming")
        df.write.parquet(staged)
        try:
            stored = df.sparkSession.read.schema(df.schema).parquet(staged)
            _refuse_conflicts(stored, path, keys)
            return write_partitions(stored, path, keys, "append", file_format, tasks, cluster, spread, **options)
        finally:
            discard(df.sparkSession, staged)
    rows = clustered(df, keys, tasks, spread) if cluster else df
    writer = rows.write.partitionBy(*keys).format(file_format).options(**options)
    if conflict == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        writer.mode("append").save(path)
    return path


@contextmanager
def claimed(df: DataFrame, path: str, keys: Sequence[str]) -> Iterator[list[str]]:
    """Hold a claim on every partition of ``df`` under ``path``; gives their names.

    A claim is a file that is made only if there is none of its name. Claims are taken in the order of their names, so of two writers that want some of the same
    partitions one always gets all of its own. All are given back at the end, also after a
    failure; those of a writer that was killed stay, and ``drop_claims`` removes them. The names
    come to the driver one by one, as they do when the write is committed.
    """
    spark, held = df.sparkSession, []
    parts = [F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("__NULL__"))) for key in keys]
    names = df.select(*keys).distinct().select(F.url_encode(F.concat_ws("/", *parts)).alias("name")).orderBy("name")
    try:
        for row in names.toLocalIterator():
            if not _claim(spark, f"{path}/{CLAIMS}/{row.name}"):
                raise PartitionConflict(f"{row.name} under {path} is being written by another job")
            held.append(row.name)
        yield held
    finally:
        for name in held:
            _delete(spark, f"{path}/{CLAIMS}/{name}")


def _files(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str) -> bool:
    """Create a claim; False if another writer holds it. Hadoop's local file system looks first and
    creates then, which two writers can do at once; there Java's own call is used."""
    place, files = _files(spark, path)
    if files.getScheme() == "file":
        file = spark._jvm.java.io.File(place.toUri().getPath())
        file.getParentFile().mkdirs()
        return file.createNewFile()
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    return True


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)


def drop_claims(spark: SparkSession, path: str) -> None:
    """Remove all claims under ``path``, after a writer was killed and no other is at work."""
    _delete(spark, f"{path}/{CLAIMS}")


def _refuse_conflicts(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Raise if partitions of ``df`` exist: how many, and from which to which."""
    found = conflicting_partitions(df, path, keys)
    names = F.concat_ws(", ", *[F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))) for key in keys])
    row = found.select(names.alias("name")).agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last")).first()
    if row.n:
        raise PartitionConflict(f"{path} already has {row.n} of the incoming partitions, from {row.first} to {row.last}")

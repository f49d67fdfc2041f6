"""Where jobs put datasets they write and read again."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one process, may fall back
    to a folder of this machine.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a dataset that ``fresh_path`` named, once nothing reads it any more."""
    if "/millrace/" not in path:
        raise ValueError(f"{path} is not under the shared folder")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dated_path(prefix: str, now: dt.datetime | None = None) -> str:
    """A new output path for one run: prefix, day, time and a random part."""
    moment = now or dt.datetime.now(dt.timezone.utc)
    return f"{prefix}{moment:%Y-%m-%d/%H-%M-%S}_{uuid.uuid4()}"

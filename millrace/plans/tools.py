"""Small helpers of the registered queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession

from millrace.sinks.catalog import create_database
from millrace.workspace import shared_dir

DATABASE = "millrace"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(spark: SparkSession) -> str:
    """The database of the registered queries, kept in the shared folder."""
    return create_database(spark, DATABASE, f"{shared_dir(spark)}/millrace/{DATABASE}.db")


def file_tasks(spark: SparkSession) -> int:
    """Tasks that write many small partitions: as many as a shuffle of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def catalog_name(spark: SparkSession, label: str) -> str:
    """A new table name."""
    return f"{database(spark)}.{label}_{uuid.uuid4().hex}"


def directory_database(spark: SparkSession, directory: str) -> str:
    """A database for the tables of one directory."""
    digest = hashlib.md5(directory.encode()).hexdigest()[:12]
    return create_database(spark, f"tables_{digest}", f"{shared_dir(spark)}/millrace/tables_{digest}.db")

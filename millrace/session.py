"""Session settings shared by the jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# One table for every job. Sizes are per task, so they hold at any data volume;
# adaptive execution turns them into a partition count at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Run-time re-planning: merge small shuffle partitions, split hot join keys.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # A side is broadcast only when its estimated size is below this bound (20 MiB).
    "spark.sql.autoBroadcastJoinThreshold": "20971520",
    "spark.sql.broadcastTimeout": "36000",
    # Scans.
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.mergeSchema": "false",
    "spark.sql.orc.filterPushdown": "true",
    "spark.sql.hive.metastorePartitionPruning": "true",
    # Folders are listed by tasks, each of which takes several (by default one task a folder).
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # Partition registration after a load.
    "spark.sql.addPartitionInBatch.size": "1000",
}


# Bytes of shuffled data that one task should sort without spilling much.
SHUFFLE_BYTES_PER_TASK = 256 * 1024**2


def shuffle_settings(shuffle_bytes: int) -> dict[str, str]:
    """How many pieces a shuffle of this size starts with.

    Adaptive execution merges pieces that turn out small but does not cut all of them
    smaller, so the number must suit the largest shuffle of the job: the default of 200 would
    put 500 GB of a 100 TB shuffle into each task.
    """
    pieces = max(200, -(-shuffle_bytes // SHUFFLE_BYTES_PER_TASK))
    return {
        "spark.sql.shuffle.partitions": str(pieces),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(pieces),
    }


def build_session(
    app_name: str, extra: dict[str, str] | None = None, shuffle_bytes: int | None = None
) -> SparkSession:
    """A session with the settings above, sized for the largest shuffle if that is known;
    ``extra`` overrides everything."""
    builder = SparkSession.builder.appName(app_name)
    sized = shuffle_settings(shuffle_bytes) if shuffle_bytes else {}
    for key, value in {**SETTINGS, **sized, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

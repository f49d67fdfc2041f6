"""Export over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame


def jdbc_options(
    url: str,
    dbtable: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partitions: int = 45,
    batch_size: int = 10_000,
) -> dict[str, str]:
    """Writer options. ``partitions`` bounds the connections open at once."""
    options = {"url": url, "dbtable": dbtable, "numPartitions": str(partitions), "batchsize": str(batch_size)}
    optional = {"user": user, "password": password, "driver": driver}
    return {**options, **{name: value for name, value in optional.items() if value is not None}}


def export_jdbc(df: DataFrame, mode: str = "overwrite", **options) -> str:
    """Write a frame into a database table. The JDBC driver must be on the class path.

    The rows are dealt out to the writing tasks by a shuffle. Without it Spark would merge the
    tasks of the query itself down to that number, and scan with as few. A task that is retried inserts its rows again, as JDBC writes have no job commit; load
    into a staging table and rename it when the target must never show duplicates.
    """
    settings = jdbc_options(**options)
    rows = df.repartition(int(settings["numPartitions"]))
    rows.write.format("jdbc").options(**settings).mode(mode).save()
    return settings["dbtable"]

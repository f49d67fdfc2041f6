"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

Pass 1 scatters the records over buckets of a size that fits in memory, by a seeded hash.
Pass 2 shuffles every bucket (Fisher-Yates, seeded) and writes it. Buckets laid end to end are
one uniformly shuffled sequence; dealing it out in turn gives shards whose row counts differ
by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import staged

BUCKET_BYTES = 16 * 1024**2


def text_bytes(text: str = "text"):
    """UTF-8 bytes of a text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shuffled(records: DataFrame, seed: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` (with a text column) in buckets: bucket, place (gapless from 0), record.

    ``record`` is a struct of all columns, so none of them can clash with the two others. A
    bucket holds about ``bucket_bytes`` of text; the hash covers the place of a record in its
    input partition next to its text, so neither copies nor equal keys meet in one bucket.
    ``records`` should be a stored table, whose partitions read the same rows in the same order
    when a lost task runs again. A text longer than a bucket makes a longer bucket.
    """
    total = records.agg(F.sum(text_bytes())).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    scattered = records.select(
        F.pmod(
            F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))),
            F.lit(buckets),
        ).alias("bucket"),
        F.struct(*[F.col(f"`{name}`") for name in records.columns]).alias("record"),
    )
    dealt = scattered.groupBy("bucket").agg(F.shuffle(F.collect_list("record"), F.lit(seed)).alias("records"))
    return dealt.select("bucket", F.posexplode("records").alias("place", "record"))


def shard(records: DataFrame, shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` dealt into ``shards`` shards in random order: shard, slot, record.

    Slots of a shard are gapless from 0; row counts of the shards differ by one at most. Every
    row is one record: null columns, empty texts and repeated rows stay as they are. An empty
    table gives no rows. Records are shuffled once and written once, to the shared folder; what
    joins them afterwards is one small row per bucket.
    """
    written = staged(shuffled(records, seed, bucket_bytes), "shard-buckets")
    sizes = written.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known and the records need not move to meet it.
    offsets = staged(sizes.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "shard-offsets")
    at = F.col("offset") + F.col("place")
    return written.join(offsets, "bucket").select(
        F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"), "record"
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard under ``path``; files hold the records in the order of their slots."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)

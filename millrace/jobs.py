"""Command line of the jobs: ``spark-submit … -m``-style entry with one command per job.

    python -m millrace.jobs generate /data/wide --parts 200 --rows-per-part 1000000
    python -m millrace.jobs extract /data/state /data/marks /data/dictionary --recent

Passwords are read from an environment variable named on the command line.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.operators import attribution, diagnostics, inventory
from millrace.operators.aggregates import top_keys
from millrace.session import build_session
from millrace.sinks.catalog import add_missing_partitions
from millrace.sinks.files import overwrite, recompress
from millrace.sinks.jdbc import export_jdbc
from millrace.sinks.partitions import CONFLICT_MODES, write_partitions
from millrace.sources import generate
from millrace.sources.logs import read_event_log, read_records
from millrace.streaming import records

Args = argparse.Namespace

# The shuffle that commands are made for unless told otherwise: 2,000 pieces of 256 MiB.
SHUFFLE_BYTES = 500 * 1024**3


def generate_wide(spark: SparkSession, args: Args) -> None:
    rows = generate.wide_rows(spark, args.parts, args.rows_per_part, args.start, args.decimal_divisor)
    overwrite(rows, args.path, codec=args.codec)


def copy(spark: SparkSession, args: Args) -> None:
    recompress(spark, args.source, args.path, args.codec, args.files)


def load_series(spark: SparkSession, args: Args) -> None:
    """Numbers, times and random identifiers into day partitions."""
    anchor = F.lit(args.anchor).cast("timestamp_ntz") if args.anchor else None
    series = generate.uuid_columns(generate.time_series(generate.number_series(spark, args.count), anchor))
    write_partitions(series, args.path, ["tv_year", "tv_month", "tv_day"], args.conflict, exclusive=args.exclusive)


def top(spark: SparkSession, args: Args) -> None:
    top_keys(spark.read.parquet(args.source), args.key, args.k).show(args.k, truncate=False)


def export(spark: SparkSession, args: Args) -> None:
    """The rows of a SELECT into a database table."""
    export_jdbc(
        spark.sql(args.query),
        url=args.url,
        dbtable=args.table,
        user=args.user,
        password=_secret(args.password_variable),
        driver=args.driver,
        partitions=args.partitions,
    )


def receive(spark: SparkSession, args: Args) -> None:
    """Queue records into files, by batch or stream as the session setting says."""
    options = records.queue_options(args.servers, args.topic, args.user, _secret(args.password_variable))
    started = records.run_records(spark, options, args.path, args.checkpoint)
    if not isinstance(started, str):
        started.awaitTermination()


def send(spark: SparkSession, args: Args) -> None:
    """Generated records into a queue topic."""
    options = records.queue_options(args.servers, args.topic, args.user, _secret(args.password_variable))
    options["topic"] = options.pop("subscribe")
    records.send_records(records.record_stream(spark, args.rate), args.checkpoint, options).awaitTermination()


def scan(spark: SparkSession, args: Args) -> None:
    """Merge the current hosts and disks into the state of a day, today unless given."""
    day = args.day or inventory.recent_days()[-1]
    stamp = int(time.time() * 10_000_000)
    listed = inventory.build_inventory(spark.read.parquet(args.hosts), spark.read.parquet(args.disks), day)
    inventory.merge_day(spark, inventory.create_state(spark, args.state), listed, day, stamp)


def merge(spark: SparkSession, args: Args) -> None:
    """Merge stored inventory rows of any days into the state; prints the days that were replaced."""
    listed, stamp = spark.read.parquet(args.listed), int(time.time() * 10_000_000)
    state = inventory.create_state(spark, args.state, inventory.state_schema(listed))
    inventory.merge_days(spark, state, listed, stamp).orderBy("crdate").show(1_000)


def extract(spark: SparkSession, args: Args) -> None:
    """Write the dictionary of changed days: all, some, or yesterday and today."""
    state = spark.read.schema(inventory.STATE_SCHEMA).parquet(args.state)
    only = inventory.recent_days() if args.recent else args.day
    inventory.extract_changed(spark, state, inventory.create_marks(spark, args.marks), args.path, only)


def costs(spark: SparkSession, args: Args) -> None:
    """Cost lines of a period by cluster and project."""
    billing = attribution.read_billing(spark, args.billing)
    dictionary = attribution.read_dictionary(spark, args.dictionary)
    labels = attribution.project_labels(billing, args.start, args.end)
    lines = attribution.attribute_costs(billing, dictionary, labels, args.start, args.end, with_fan_out=True)
    # Both replace what an earlier run left, so that one that died can run again.
    overwrite(lines, f"{args.path}/lines")
    stored = spark.read.parquet(f"{args.path}/lines")
    overwrite(attribution.cost_rollup(stored, ["date", "cluster_id", "project_id"]), f"{args.path}/rollup")


def event_log(spark: SparkSession, args: Args) -> None:
    """All event-log reports as Parquet, and the events they are made from, parsed once."""
    overwrite(read_event_log(spark, args.log), f"{args.path}/events")
    for name, report in diagnostics.event_reports(spark.read.parquet(f"{args.path}/events")).items():
        overwrite(report, f"{args.path}/{name}")


def layout(spark: SparkSession, args: Args) -> None:
    """Files, bytes and rows per partition as Parquet; their totals are printed."""
    overwrite(diagnostics.dataset_inventory(spark, args.source, args.keys), args.path)
    totals = [F.sum(name).alias(name) for name in ("n_files", "n_bytes", "n_rows")]
    spark.read.parquet(args.path).agg(F.count("*").alias("n_partitions"), *totals).show()


def register(spark: SparkSession, args: Args) -> None:
    """Add the partitions under a path that a table does not know, in batches; statistics of all batches."""
    add_missing_partitions(spark, args.table, args.path, args.keys, args.log, args.batch)
    diagnostics.registration_batches(spark.read.text(args.log)).show()


def losses(spark: SparkSession, args: Args) -> None:
    """Executors that driver logs name as lost, as Parquet; records may go over several lines."""
    read = read_records(spark, args.logs)
    overwrite(diagnostics.lost_executors(read.withColumn("value", F.translate("value", "\n", " "))), args.path)
    diagnostics.losses_by_executor(spark.read.parquet(args.path)).orderBy("executor").show(1_000)


def _secret(variable: str | None) -> str | None:
    return os.environ[variable] if variable else None


def parser() -> argparse.ArgumentParser:
    top_level = argparse.ArgumentParser(prog="millrace")
    top_level.add_argument(
        "--shuffle-bytes", type=int, default=SHUFFLE_BYTES, help="size of the largest shuffle; adaptive execution merges pieces that turn out small"
    )
    commands = top_level.add_subparsers(required=True)

    def command(name: str, job, *positional: str) -> argparse.ArgumentParser:
        added = commands.add_parser(name, help=job.__doc__)
        added.set_defaults(job=job)
        for argument in positional:
            added.add_argument(argument)
        return added

    def login(added: argparse.ArgumentParser) -> None:
        added.add_argument("--user")
        added.add_argument("--password-variable")

    wide = command("generate", generate_wide, "path")
    wide.add_argument("--parts", type=int, default=200)
    wide.add_argument("--rows-per-part", type=int, default=1_000_000)
    wide.add_argument("--start", type=int, default=0)
    wide.add_argument("--decimal-divisor", type=int, default=100)
    wide.add_argument("--codec", default="gzip")

    copied = command("recompress", copy, "source", "path")
    copied.add_argument("--codec", default="gzip")
    copied.add_argument("--files", type=int)

    series = command("load-series", load_series, "path")
    series.add_argument("--count", type=int, default=1_000_000_000)
    series.add_argument("--anchor", type=dt.datetime.fromisoformat)
    series.add_argument("--conflict", choices=CONFLICT_MODES, default="fail")
    series.add_argument("--exclusive", action="store_true", help="claim the partitions while they are written")

    ranked = command("top", top, "source", "key")
    ranked.add_argument("--k", type=int, default=10)

    exported = command("export", export, "query", "url", "table")
    exported.add_argument("--driver")
    exported.add_argument("--partitions", type=int, default=45)
    login(exported)

    received = command("receive", receive, "servers", "topic", "path", "checkpoint")
    login(received)

    sent = command("send", send, "servers", "topic", "checkpoint")
    sent.add_argument("--rate", type=float, default=10)
    login(sent)

    scanned = command("scan", scan, "hosts", "disks", "state")
    scanned.add_argument("--day", type=int)

    command("merge", merge, "listed", "state")

    extracted = command("extract", extract, "state", "marks", "path")
    extracted.add_argument("--day", type=int, nargs="*")
    extracted.add_argument("--recent", action="store_true")

    command("costs", costs, "billing", "dictionary", "start", "end", "path")
    command("event-log", event_log, "log", "path")
    command("losses", losses, "logs", "path")
    command("layout", layout, "source", "path").add_argument("keys", nargs="+")

    registered = command("register", register, "table", "path", "log")
    registered.add_argument("keys", nargs="+")
    registered.add_argument("--batch", type=int, default=1_000)
    return top_level


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.job(build_session("millrace", shuffle_bytes=args.shuffle_bytes), args)


if __name__ == "__main__":
    main()

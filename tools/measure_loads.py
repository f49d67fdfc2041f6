"""Time the three loads with published cluster timings, at a size for one machine.

    python tools/measure_loads.py DIRECTORY [--parts 8] [--rows-per-part 1000000] [--series 10000000]

DIRECTORY must not exist. Prints rows per second and core.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from pyspark.sql import functions as F  # noqa: E402

from millrace.session import build_session  # noqa: E402
from millrace.sinks.files import overwrite, recompress  # noqa: E402
from millrace.sinks.partitions import write_partitions  # noqa: E402
from millrace.sources.generate import number_series, time_series, uuid_columns, wide_rows  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("directory")
    parser.add_argument("--cpus", type=int, default=8)
    parser.add_argument("--parts", type=int, default=8)
    parser.add_argument("--rows-per-part", type=int, default=1_000_000)
    parser.add_argument("--series", type=int, default=10_000_000)
    args = parser.parse_args()
    spark = build_session(
        "loads",
        {"spark.master": f"local[{args.cpus}]", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
         "spark.sql.shuffle.partitions": str(args.cpus * 4)},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def report(label: str, rows: int, job) -> None:
        begin = time.perf_counter()
        job()
        spent = time.perf_counter() - begin
        print(f"{label:20} {rows:>12,} rows {spent:8.1f} s {rows / spent / args.cpus:>10,.0f} rows/s/core", flush=True)

    wide, copy = f"{args.directory}/wide", f"{args.directory}/copy"
    rows = args.parts * args.rows_per_part
    report("generate", rows, lambda: overwrite(wide_rows(spark, args.parts, args.rows_per_part), wide, codec="gzip"))
    report("read and write", rows, lambda: recompress(spark, wide, copy))
    anchor = F.expr("TIMESTAMP_NTZ '2022-12-17 12:00:00'")
    series = uuid_columns(time_series(number_series(spark, args.series), anchor))
    keys = ["tv_year", "tv_month", "tv_day"]
    report("partitioned load", args.series, lambda: write_partitions(series, f"{args.directory}/mega", keys))


if __name__ == "__main__":
    main()

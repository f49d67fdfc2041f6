import datetime as dt
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import plan_text, rows
from millrace.operators import diagnostics
from millrace.sources.logs import EVENT_SCHEMA, read_logs, read_records
from millrace.operators.phases import followed_moments, in_ranges, phase_durations

# Batch size, total, push, fetch and add times (ms) of two measured loads.
RUNS = {
    "first": [
        (1000, 26613, 1569, 17631, 6833),
        (1000, 22746, 1086, 14491, 6630),
        (1000, 24165, 913, 16231, 6485),
        (1000, 14934, 2241, 5043, 7133),
        (1000, 19189, 2465, 9759, 6456),
        (1000, 19393, 2412, 9448, 7013),
        (1000, 19235, 1852, 9520, 7341),
        (1000, 18496, 1844, 9622, 6510),
        (1000, 24594, 1905, 15081, 7097),
        (1000, 18730, 1738, 9607, 6875),
        (1000, 14752, 2182, 5016, 7038),
        (575, 10076, 1205, 4471, 4072),
    ],
    "second": [
        (1000, 25151, 1452, 15918, 7182),
        (1000, 23332, 1104, 14075, 7604),
        (1000, 22351, 908, 14421, 6479),
        (1000, 22960, 861, 14910, 6631),
        (1000, 21690, 1338, 13760, 6063),
        (1000, 22254, 856, 14383, 6469),
        (1000, 22034, 861, 14481, 6177),
        (1000, 14643, 2343, 5155, 6609),
        (1000, 19341, 2213, 9972, 6623),
        (1000, 19030, 2419, 9757, 6324),
        (1000, 16298, 2386, 4870, 8519),
        (575, 9364, 1287, 4288, 3483),
    ],
}


def test_registration_totals(spark):
    lines = []
    for run, batches in RUNS.items():
        for size, total, push, fetch, add in batches:
            lines.append((run, f"INFO total partitions to be created: {size}"))
            lines.append((run, f"INFO total method time: {total}, push={push}, fetch={fetch}, addParts={add}, other=1"))
        lines.append((run, "something else"))
    df = spark.createDataFrame(lines, "run STRING, value STRING")
    assert rows(diagnostics.registration_batches(df, by=["run"]), "run") == [
        ("first", 12, 11575, 232923, 21412, 125920, 79483, 1),
        ("second", 12, 11575, 238448, 18028, 135990, 78163, 1),
    ]
    assert diagnostics.registration_batches(df).first().partitions == 23150


def test_lost_executor_line(spark):
    text = (
        "23/02/23 20:22:09 WARN TaskSetManager: Lost task 28.0 in stage 13.0 (TID 242) \n"
        "        (host-1 executor 5): ExecutorLostFailure \n"
        "        (executor 5 exited caused by one of the running tasks) \n"
        "        Reason: Executor heartbeat timed out after 138218 ms"
    )
    killed = (
        "WARN TaskSetManager: Lost task 1.0 in stage 2.0 (TID 3) (h executor 6): ExecutorLostFailure (executor 6 "
        "exited unrelated to the running tasks) Reason: Container killed"
    )
    df = spark.createDataFrame([(text,), (killed,), ("ExecutorLostFailure but no task",), ("fine",), (None,)], "value STRING")
    found = diagnostics.lost_executors(df)
    assert rows(found, "task") == [
        (None, None, None, None, None, None, True),
        (1, 2, 3, "6", "Container killed", None, False),
        (28, 13, 242, "5", "Executor heartbeat timed out after 138218 ms", 138218, False),
    ]
    assert rows(diagnostics.losses_by_executor(found), "executor") == [(None, 0, None, 1), ("5", 1, 138218, 0), ("6", 1, None, 0)]


@pytest.fixture
def logs(spark):
    values = [(dt.datetime(2024, 1, 23, 10, m), "containers" if m % 2 else "syslog", f"app{m % 3}", f"m{m}") for m in range(10)]
    return spark.createDataFrame(values, "ts TIMESTAMP_NTZ, log_type STRING, application_id STRING, message STRING")


def test_log_search(logs):
    found = diagnostics.search_logs(
        logs, {"log_type": "containers"}, {"application_id": ["app0", "app1"]}, "2024-01-23 10:01:00", "2024-01-23 10:09:00"
    )
    assert [r.message for r in found.orderBy("ts").collect()] == ["m1", "m3", "m7"]
    assert diagnostics.search_logs(logs, limit=4).count() == 4
    assert diagnostics.search_logs(logs).count() == 10


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("since", ["2024-01-23 10:07:00", "2024-01-23T10:07:00Z", "2024-01-23T13:07:00+03:00"])
def test_log_times_are_utc(spark, conf, logs, kind, since):
    if kind == "timestamp":
        logs = logs.withColumn("ts", F.col("ts").cast("timestamp"))
        instants = logs.select((F.unix_micros("ts")).alias("us"), "message").collect()
        logs = spark.createDataFrame(instants, "us BIGINT, message STRING").select(F.timestamp_micros("us").alias("ts"), "message")
    conf("spark.sql.session.timeZone", "Asia/Tokyo")
    assert diagnostics.search_logs(logs, since=since).count() == 3


def test_log_time_of_today(spark):
    now = spark.sql("SELECT to_utc_timestamp(current_timestamp(), current_timezone())::timestamp_ntz AS ts")
    assert diagnostics.search_logs(now, since="00:00:00").count() == 1
    assert diagnostics.search_logs(now, until="00:00:00").count() == 0


def test_limit_gives_the_earliest(logs):
    found = diagnostics.search_logs(logs, {"log_type": "containers"}, since="2024-01-23 10:02:00", limit=2)
    assert [r.message for r in found.orderBy("ts").collect()] == ["m3", "m5"]


@pytest.mark.parametrize("day", ["20240123", "2024-01-23", "20240123T000000", "2024-W04-2"])
def test_dates_are_not_times_of_today(logs, day):
    assert diagnostics.search_logs(logs, since=day).count() == logs.count()
    assert diagnostics.search_logs(logs, until=day).count() == 0


def test_log_source(spark, tmp_path):
    record = '{"ts": "2024-01-23T10:00:00Z", "log_type": "syslog", "hostname": "h1", "message": "m", "other": 1}'
    (tmp_path / "logs.json").write_text(record + "\n")
    found = diagnostics.search_logs(read_logs(spark, str(tmp_path)), {"hostname": "h1"}, since="2024-01-23 10:00:00Z")
    assert found.count() == 1 and found.first().message == "m"


def test_log_search_is_pushed_down(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    logs.write.parquet(path)
    found = diagnostics.search_logs(spark.read.parquet(path), {"log_type": "syslog"}, since="2024-01-23 10:02:00")
    text = plan_text(found)
    assert "EqualTo(log_type,syslog)" in text and "GreaterThanOrEqual(ts,2024-01-23" in text


JOB = """
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").appName("logged")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", {path!r})
    .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
    .config("spark.ui.enabled", "false").getOrCreate())
spark.range(0, 100000, numPartitions=4).selectExpr("id % 10 AS k").groupBy("k").count().collect()
spark.stop()
"""


def test_real_event_log(spark, tmp_path):
    log_dir = tmp_path / "event-logs"
    log_dir.mkdir()
    subprocess.run([sys.executable, "-c", JOB.format(path=f"file:{log_dir}")], check=True, timeout=180, capture_output=True)
    report = diagnostics.event_log_report(spark, str(log_dir))
    jobs = report["jobs"].collect()
    assert jobs and all(j.result == "JobSucceeded" and j.duration_ms >= 0 and j.app.startswith("local-") for j in jobs)
    stages = {s.stage_id: s for s in report["stages"].collect()}
    assert any(s.n_tasks == 4 for s in stages.values()) and all(s.duration_ms >= 0 for s in stages.values())
    executors = report["executors"].collect()
    assert [e.executor_id for e in executors] == ["driver"]
    assert executors[0].n_tasks == sum(s.n_tasks for s in stages.values())
    assert executors[0].gc_share is None or 0 <= executors[0].gc_share <= 1
    assert sum(t.n_tasks for t in report["stage_tasks"].collect()) == executors[0].n_tasks
    states = report["executor_states"].collect()
    assert [(e.executor_id, e.cores, e.removed_ms) for e in states] == [("driver", 2, None)] and states[0].added_ms > 0
    settings = {r.setting: r.value for r in report["settings"].collect()}
    assert settings["spark.app.name"] == "logged" and settings["spark.master"] == "local[2]"
    assert "HashAggregate" in report["sql_plans"].first().plan
    assert all(q.duration_ms >= 0 for q in report["sql"].collect()) and report["sql"].count() == 1


def test_throughput(spark):
    runs = [("Generate", "v2.1", 204.785), ("Generate", "v2.0", 138.465), ("Read+Write", "v2.1", 235.486), ("Generate", "v2.0", 150.0)]
    df = spark.createDataFrame(runs, "test STRING, config STRING, seconds DOUBLE")
    found = diagnostics.throughput_report(df, configs=["v2.1", "v2.0"])
    assert found.columns == ["test", "v2.1", "v2.0"]
    assert rows(found, "test") == [("Generate", 204.785, 138.465), ("Read+Write", 235.486, None)]


def test_phase_durations(spark):
    times = {
        "2": ["2022-12-17 12:27:00", "2022-12-17 12:34:00", "2022-12-17 12:42:17", "2022-12-17 12:44:41", "2022-12-17 12:53:29"],
        "3": ["2022-12-19 07:50:12", "2022-12-19 07:54:50", "2022-12-19 08:01:54", "2022-12-19 08:02:32", "2022-12-19 08:07:03"],
    }
    events = [(run, f"phase {i}", dt.datetime.fromisoformat(t)) for run, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(events, "run STRING, phase STRING, ts TIMESTAMP_NTZ")
    found = phase_durations(df).select("run", "phase", (F.col("micros") / 1000000).cast("int").alias("s"))
    assert [r.s for r in found.where("run = '2'").orderBy("phase").collect()] == [420, 497, 144, 528, None]
    assert [r.s for r in found.where("run = '3'").orderBy("phase").collect()] == [278, 424, 38, 271, None]


@pytest.mark.parametrize("kind", ["TIMESTAMP_NTZ", "TIMESTAMP"])
def test_runs_cut_anywhere(spark, conf, kind):
    """Hot runs with bursts, equal timestamps, a NULL run and missing timestamps."""
    df = spark.range(20000).select(
        F.col("id"),
        F.when(F.col("id") % 10 < 5, "hot").when(F.col("id") % 10 < 8, None).otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("run"),
        F.when(
            F.col("id") % 101 != 0,
            F.expr(f"CAST('2024-01-01 00:00:00' AS {kind})")
            + F.make_dt_interval(secs=F.when(F.col("id") % 7 == 0, F.lit(77)).otherwise((F.col("id") * 7919) % 5000 * 0.5)),
        ).alias("ts"),
    )
    usual = phase_durations(df, order=["id"])
    conf("spark.sql.shuffle.partitions", "61")
    cut = phase_durations(df, order=["id"])
    by_window = df.where("ts IS NOT NULL").selectExpr(
        "id", "CAST(lead(ts) OVER (PARTITION BY run ORDER BY ts, id) - ts AS INTERVAL SECOND) AS gap"
    )
    assert usual.where("micros IS NOT NULL").count() == by_window.where("gap IS NOT NULL").count()
    total = by_window.agg(F.sum(F.col("gap").cast("decimal(18,6)"))).first()[0]
    assert usual.agg(F.sum("micros")).first()[0] == total * 1000000
    assert cut.columns == usual.columns
    assert rows(cut, "id") == rows(usual, "id")
    assert cut.count() == 20000


def test_dense_run_is_spread_over_all_tasks(spark, conf):
    """One run with all its moments in one second: every range gets its share of them."""
    conf("spark.sql.shuffle.partitions", "16")
    moments = spark.range(40000).selectExpr(
        "'r' AS run", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 40000) AS ts", "id AS last"
    )
    moments = moments.unionByName(moments.selectExpr("CAST(NULL AS STRING) AS run", "ts", "last").limit(3))
    sizes = [row["count"] for row in in_ranges(moments).groupBy("piece").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2.5 * 40000 / 16
    found = followed_moments(moments)
    assert found.where("next_ts IS NULL").count() == 2
    gaps = found.selectExpr("CAST(next_ts - ts AS INTERVAL SECOND) AS gap").groupBy("gap").count()
    assert gaps.where("gap = INTERVAL '0.000025' SECOND").first()["count"] == 39999 + 2


def test_equal_timestamps_without_order(spark):
    """Of many events at one moment exactly one is followed by the next moment."""
    moment = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
    df = spark.range(0, 50000, numPartitions=8).selectExpr("'r' AS run", f"{moment} AS ts")
    df = df.unionByName(spark.sql(f"SELECT 'r' AS run, {moment} + INTERVAL '2' DAY AS ts"))
    found = phase_durations(df).groupBy("micros").count()
    assert sorted(rows(found), key=str) == [(0, 49999), (172800000000, 1), (None, 1)]


def test_moments_not_events_are_ordered(spark, conf, tmp_path):
    """A run of all rows, most of them at one moment: what is ordered is one row per moment."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "128k")
    conf("spark.sql.shuffle.partitions", "64")
    df = spark.range(0, 200000, numPartitions=16).selectExpr(
        "'r' AS run", "id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, IF(id % 3 = 0, 0, id)) AS ts"
    )
    found = phase_durations(df, order=["id"])
    assert found.where("micros IS NULL").count() == 1
    found.collect()
    assert "SortMergeJoin(skew=true)" in plan_text(found)


def test_event_log_is_parsed_once(spark, tmp_path):
    assert set(diagnostics.event_reports(spark.createDataFrame([], EVENT_SCHEMA).withColumn("app", F.lit("a")))) == {
        "jobs", "stages", "stage_tasks", "executors", "executor_states", "sql", "sql_plans", "settings"
    }


def test_records_over_several_lines(spark, conf, tmp_path):
    """Splits of a few bytes: records begin in one and go on through others."""
    conf("spark.sql.files.maxPartitionBytes", "100")
    conf("spark.sql.files.openCostInBytes", "1")
    head = "2024-01-02 03:04:05 WARN"
    expected = [f"{head} record {i}" + "".join(f"\n  at line {j} of {i}" for j in range(i % 37)) for i in range(150)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("\n".join(["left over", " from before", *expected]) + "\n")
    (tmp_path / "logs" / "b.log").write_text("\n".join(expected[:3]))
    found = read_records(spark, str(tmp_path / "logs"))
    assert spark.read.text(str(tmp_path / "logs")).rdd.getNumPartitions() > 100
    values = sorted(r.value for r in found.where("file LIKE '%a.log'").collect())
    assert values == sorted(["left over\n from before", *expected])
    assert sorted(r.value for r in found.where("file LIKE '%b.log'").collect()) == sorted(expected[:3])

"""The command line, on small inputs."""

import datetime as dt

import pytest

from conftest import rows
from millrace import jobs
from millrace.sinks.jdbc import jdbc_options


@pytest.fixture
def run(spark, conf):
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"):
        conf(key, "8")  # set back after the test

    def call(*arguments):
        jobs.main([str(argument) for argument in arguments])

    return call


def test_generate_and_recompress(spark, run, tmp_path):
    run("generate", tmp_path / "wide", "--parts", 3, "--rows-per-part", 10)
    run("recompress", tmp_path / "wide", tmp_path / "copy", "--codec", "zstd", "--files", 1)
    first, second = (spark.read.parquet(str(tmp_path / name)) for name in ("wide", "copy"))
    assert first.count() == 30 and first.exceptAll(second).isEmpty()
    assert all(".zstd." in name for name in second.inputFiles()) and len(second.inputFiles()) == 1


def test_load_series_top_and_layout(spark, run, tmp_path, capsys):
    run("load-series", tmp_path / "mega", "--count", 100000, "--anchor", "2022-12-17 12:00:00")
    loaded = spark.read.parquet(str(tmp_path / "mega"))
    assert loaded.count() == 100000 and loaded.select("tv_year", "tv_month", "tv_day").distinct().count() == 2
    with pytest.raises(Exception, match="already has"):
        run("load-series", tmp_path / "mega", "--count", 10, "--anchor", "2022-12-17 12:00:00")
    run("load-series", tmp_path / "mega", "--count", 10, "--anchor", "2022-12-17 12:00:00", "--conflict", "append")
    run("top", tmp_path / "mega", "tv_day", "--k", 1)
    run("layout", tmp_path / "mega", tmp_path / "layout", "tv_month", "tv_day")
    assert spark.read.parquet(str(tmp_path / "layout")).agg({"n_rows": "sum"}).first()[0] == 100010
    assert "100010" in capsys.readouterr().out


def test_layout_lists_every_partition(spark, run, tmp_path):
    spark.range(1200).selectExpr("id AS x", "id AS k").coalesce(1).write.partitionBy("k").parquet(str(tmp_path / "many"))
    run("layout", tmp_path / "many", tmp_path / "layout", "k")
    assert spark.read.parquet(str(tmp_path / "layout")).count() == 1200


def test_commands_start_with_many_pieces(spark, run, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    run("top", tmp_path / "x", "id")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "2000"
    run("--shuffle-bytes", 10**14, "top", tmp_path / "x", "id")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "372530"


def test_inventory_to_costs(spark, run, tmp_path):
    today = dt.date(2022, 11, 10)
    spark.createDataFrame([("v1", "cA"), ("v2", "cB")], "vm_id STRING, cluster_id STRING").write.parquet(str(tmp_path / "hosts"))
    spark.createDataFrame([("d1", ["v1"])], "disk_id STRING, instance_ids ARRAY<STRING>").write.parquet(str(tmp_path / "disks"))
    for _ in range(2):
        run("scan", tmp_path / "hosts", tmp_path / "disks", tmp_path / "state", "--day", 20221110)
        run("extract", tmp_path / "state", tmp_path / "marks", tmp_path / "dictionary", "--day", 20221110)
    run("extract", tmp_path / "state", tmp_path / "marks", tmp_path / "dictionary", "--recent")
    assert spark.read.parquet(str(tmp_path / "marks")).count() == 1
    (tmp_path / "billing").mkdir()
    (tmp_path / "billing" / "b.csv").write_text(
        "resource_id,date,cost,label.user_labels.cluster_id,label.user_labels.project_id\n"
        "d1,2022-11-10,1.25,,\nv2,2022-11-10,2,,\nx,2022-11-10,4,,\ncluster,2022-11-10,0.5,cA,p1\n"
    )
    run("costs", tmp_path / "billing", tmp_path / "dictionary", "2022-11-05", "2022-11-20", tmp_path / "report")
    rollup = spark.read.parquet(str(tmp_path / "report" / "rollup"))
    assert [(r.date, r.cluster_id, r.project_id, float(r.cost), r.fan_out) for r in rollup.orderBy("cluster_id").collect()] == [
        (today, "-", "-", 4.5, 0),
        (today, "cA", "p1", 1.25, 0),
        (today, "cB", "-", 2.0, 0),
    ]
    run("costs", tmp_path / "billing", tmp_path / "dictionary", "2022-11-05", "2022-11-20", tmp_path / "report")
    assert spark.read.parquet(str(tmp_path / "report" / "rollup")).count() == 3


def test_event_log_reports(spark, run, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "local-1700000000001").write_text(
        '{"Event":"SparkListenerJobStart","Job ID":0,"Submission Time":10}\n'
        '{"Event":"SparkListenerJobEnd","Job ID":0,"Completion Time":35,"Job Result":{"Result":"JobSucceeded"}}\n'
    )
    run("event-log", tmp_path / "logs", tmp_path / "out")
    assert rows(spark.read.parquet(str(tmp_path / "out" / "jobs"))) == [("local-1700000000001", 0, 25, "JobSucceeded")]


def test_passwords_come_from_the_environment(spark, monkeypatch):
    seen = {}
    monkeypatch.setenv("EXPORT_SECRET", "s3cret")
    monkeypatch.setattr(jobs, "export_jdbc", lambda df, **options: seen.update(jdbc_options(**options), n=df.count()))
    jobs.main(["export", "SELECT 1 AS a", "jdbc:x", "t", "--user", "u", "--password-variable", "EXPORT_SECRET"])
    assert seen["password"] == "s3cret" and seen["numPartitions"] == "45" and seen["n"] == 1


def test_merge_of_days(spark, run, tmp_path, capsys):
    listed = "crdate INT, obj_id STRING, vm_id STRING, cluster_id STRING, otype STRING"
    for number, days in enumerate([(20240101, 20240102), (20240102, 20240103)]):
        spark.createDataFrame([(d, "a", "v", "c", "vm") for d in days], listed).write.parquet(str(tmp_path / f"listed{number}"))
        run("merge", tmp_path / f"listed{number}", tmp_path / "state")
    assert spark.read.parquet(str(tmp_path / "state")).count() == 3
    shown = capsys.readouterr().out.split("n_changed")[-1]
    assert "20240103" in shown and "20240102" not in shown


def test_register_and_losses(spark, run, tmp_path, capsys):
    spark.range(5).selectExpr("id AS x", "CAST(id AS STRING) AS k").write.partitionBy("k").parquet(str(tmp_path / "data"))
    spark.sql(f"CREATE TABLE register_test (x BIGINT, k STRING) USING parquet PARTITIONED BY (k) LOCATION '{tmp_path / 'data'}'")
    try:
        run("register", "register_test", tmp_path / "data", tmp_path / "log", "k", "--batch", 2)
        assert spark.table("register_test").count() == 5
    finally:
        spark.sql("DROP TABLE register_test")
    (tmp_path / "driver.log").write_text(
        "24/01/01 00:00:00 WARN TaskSetManager: Lost task 1.0 in stage 2.0\n(TID 7) (host executor 3): ExecutorLostFailure\n"
        "(executor 3 exited) Reason:\nExecutor heartbeat timed out after 130000 ms\n24/01/01 00:00:01 INFO x: y\n"
    )
    run("losses", tmp_path / "driver.log", tmp_path / "losses")
    assert rows(spark.read.parquet(str(tmp_path / "losses")).select("task", "executor", "timeout_ms")) == [(1, "3", 130000)]

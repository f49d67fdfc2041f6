import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan_text, rows
from millrace.operators import attribution, inventory
from millrace.sinks.partitions import write_partitions

STATE = "crdate INT, obj_id STRING, vm_id STRING, cluster_id STRING, otype STRING, upd_tv BIGINT"
BATCH = "crdate INT, obj_id STRING, vm_id STRING, cluster_id STRING, otype STRING"
ORDER = ["crdate", "obj_id"]


def state(spark, *values):
    return spark.createDataFrame(list(values), STATE)


def batch(spark, *values):
    return spark.createDataFrame(list(values), BATCH)


def test_build(spark):
    hosts = spark.createDataFrame([("v1", "c1"), ("v1", "c2"), ("v2", "c1")], "vm_id STRING, cluster_id STRING")
    disks = spark.createDataFrame(
        [("d1", ["v1", "v2"]), ("d2", ["other"]), ("d3", ["v1", "other"]), ("d4", None), ("d5", []), ("d1", ["v1"])],
        "disk_id STRING, instance_ids ARRAY<STRING>",
    )
    built = inventory.build_inventory(hosts, disks, 20240101)
    assert rows(built.select(*ORDER, "vm_id", "cluster_id", "otype"), *ORDER) == [
        (20240101, "d1", "v2", "c1", "disk"),
        (20240101, "d3", "v1", "c2", "disk"),
        (20240101, "v1", "v1", "c2", "vm"),
        (20240101, "v2", "v2", "c1", "vm"),
    ]


def test_hot_host_is_split(spark, conf):
    """Most disks hang on one host; the lookup runs as a skew join and stays whole."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    conf("spark.sql.shuffle.partitions", "64")
    hosts = spark.range(1000).select(F.format_string("v%d", "id").alias("vm_id"), F.lit("c").alias("cluster_id"))
    host = F.when(F.col("id") % 3 > 0, "v0").otherwise(F.format_string("v%d", F.col("id") % 1000))
    disks = spark.range(0, 200000, numPartitions=16).select(
        F.md5(F.col("id").cast("string")).alias("disk_id"), F.array(host).alias("instance_ids")
    )
    built = inventory.build_inventory(hosts, disks, 1)
    assert built.count() == 201000
    built.collect()
    assert "SortMergeJoin(skew=true)" in plan_text(built)


def test_upsert_rules(spark):
    old = state(
        spark,
        (1, "same", "v", "c", "vm", 1),
        (1, "changed", "v", "c", "vm", 1),
        (1, "incoming_null", "v", "c", "vm", 1),
        (1, "stored_null", "v", None, "vm", 1),
        (1, "stored_null_to_dash", "v", None, "vm", 1),
        (1, "both_null", "v", None, "vm", 1),
        (1, "null_and_change", "v", "c", "vm", 1),
        (1, "unlisted", "v", "c", "vm", 1),
    )
    new = batch(
        spark,
        (1, "same", "v", "c", "vm"),
        (1, "changed", "v", "c2", "vm"),
        (1, "incoming_null", "v", None, "vm"),
        (1, "stored_null", "v", "c", "vm"),
        (1, "stored_null_to_dash", "v", "-", "vm"),
        (1, "both_null", "v", None, "vm"),
        (1, "null_and_change", "v2", None, "vm"),
        (1, "new", "v", None, "disk"),
        (2, "same", "v", "c", "vm"),
        (1, "twice", "v1", "c9", "disk"),
        (1, "twice", "v2", "c1", "disk"),
    )
    kept = {
        (1, "same"): ("v", "c", "vm", 1),
        (1, "changed"): ("v", "c2", "vm", 5),
        (1, "incoming_null"): ("v", "c", "vm", 1),
        (1, "stored_null"): ("v", "c", "vm", 5),
        (1, "stored_null_to_dash"): ("v", None, "vm", 1),
        (1, "both_null"): ("v", None, "vm", 1),
        (1, "null_and_change"): ("v2", None, "vm", 5),
        (1, "unlisted"): ("v", "c", "vm", 1),
        (1, "new"): ("v", None, "disk", 5),
        (2, "same"): ("v", "c", "vm", 5),
        (1, "twice"): ("v2", "c1", "disk", 5),
    }
    found = inventory.upsert_changed(old, new, 5)
    assert found.columns == old.columns
    assert {tuple(r)[:2]: tuple(r)[2:] for r in found.collect()} == kept
    safe = {tuple(r)[:2]: tuple(r)[2:] for r in inventory.upsert_changed(old, new, 5, null_safe=True).collect()}
    assert safe[(1, "incoming_null")] == ("v", None, "vm", 5)
    assert safe[(1, "stored_null_to_dash")] == ("v", "-", "vm", 5)
    assert safe[(1, "both_null")] == ("v", None, "vm", 1)


def test_upsert_with_all_null_values_is_still_listed(spark):
    found = inventory.upsert_changed(state(spark), batch(spark, (1, "x", None, None, None)), 3)
    assert rows(found) == [(1, "x", None, None, None, 3)]


def test_upsert_is_one_shuffle(spark):
    text = plan_text(inventory.upsert_changed(state(spark, (1, "a", "v", "c", "vm", 1)), batch(spark, (1, "a", "v", "c", "vm")), 2))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_second_run_changes_nothing(spark):
    new = batch(spark, (1, "a", "v", None, "vm"), (1, "b", "v", "c", "vm"))
    first = inventory.upsert_changed(state(spark), new, 5)
    second = inventory.upsert_changed(first, new, 6)
    assert rows(second, *ORDER) == rows(first, *ORDER)
    marks = first.groupBy("crdate").agg(F.max("upd_tv").alias("upd_tv"))
    assert inventory.changed_days(second, marks).isEmpty()


def test_merge_day_rewrites_one_partition(spark, tmp_path):
    path = str(tmp_path / "state")
    write_partitions(state(spark, (1, "a", "v", "c", "vm", 1), (2, "a", "v", "c", "vm", 1)), path, ["crdate"])
    untouched = {f for f in spark.read.parquet(path).inputFiles() if "crdate=1" in f}
    inventory.merge_day(spark, path, batch(spark, (2, "a", "v", "c2", "vm"), (2, "b", "v", "c", "vm")), 2, 9)
    stored = spark.read.schema(STATE).parquet(path)
    assert rows(stored.select(*STATE.replace(",", "").split()[::2]), *ORDER) == [
        (1, "a", "v", "c", "vm", 1),
        (2, "a", "v", "c2", "vm", 9),
        (2, "b", "v", "c", "vm", 9),
    ]
    assert untouched < set(stored.inputFiles())
    inventory.merge_day(spark, path, batch(spark, (3, "a", "v", "c", "vm")), 3, 10)
    assert spark.read.schema(STATE).parquet(path).count() == 4


def test_merge_days_rewrites_changed_days_only(spark, tmp_path):
    """Of four stored days three come in, one of them as it is, and a new one."""
    path = str(tmp_path / "state")
    write_partitions(state(spark, *[(d, "a", "v", "c", "vm", 1) for d in (1, 2, 3, 4)]), path, ["crdate"])
    before = {f for f in spark.read.parquet(path).inputFiles()}
    incoming = batch(
        spark, (2, "a", "v", "c2", "vm"), (3, "a", "v", "c", "vm"), (4, "b", "v", None, "vm"), (5, "a", "v", "c", "vm"), (None, "a", "v", "c", "vm")
    )
    replaced = inventory.merge_days(spark, path, incoming, 9)
    assert rows(replaced, "crdate") == [(2, 1), (4, 1), (5, 1)]
    stored = spark.read.schema(STATE).parquet(path)
    assert rows(stored.select(*STATE.replace(",", "").split()[::2]), *ORDER) == [
        (1, "a", "v", "c", "vm", 1),
        (2, "a", "v", "c2", "vm", 9),
        (3, "a", "v", "c", "vm", 1),
        (4, "a", "v", "c", "vm", 1),
        (4, "b", "v", None, "vm", 9),
        (5, "a", "v", "c", "vm", 9),
    ]
    kept = {f for f in before if "crdate=1/" in f or "crdate=3/" in f}
    assert before & set(stored.inputFiles()) == kept and len(kept) == 2
    files = set(stored.inputFiles())
    assert inventory.merge_days(spark, path, incoming, 10).count() == 0
    assert set(spark.read.parquet(path).inputFiles()) == files


def test_merge_days_reads_the_days_of_the_batch(spark, tmp_path):
    path, listed = str(tmp_path / "state"), str(tmp_path / "days")
    write_partitions(state(spark, *[(d, "a", "v", "c", "vm", 1) for d in range(1, 9)]), path, ["crdate"])
    spark.createDataFrame([(3,), (5,)], "crdate INT").coalesce(1).write.parquet(listed)
    wanted = inventory.days_of(spark.read.schema(STATE).parquet(path), spark.read.parquet(listed))
    found = wanted.select("crdate", "obj_id")
    assert rows(found, "crdate") == [(3, "a"), (5, "a")]
    assert "dynamicpruning" in plan_text(found)


def test_first_merge_of_days(spark, tmp_path):
    path = inventory.create_state(spark, str(tmp_path / "state"))
    assert inventory.merge_days(spark, path, batch(spark), 5).count() == 0
    assert rows(inventory.merge_days(spark, path, batch(spark, (1, "a", "v", "c", "vm"), (2, "a", None, None, None)), 5), "crdate") == [(1, 1), (2, 1)]
    assert [r.upd_tv for r in spark.read.schema(STATE).parquet(path).collect()] == [5, 5]


def test_order_inside_files(spark, conf, tmp_path):
    """Splits of a few lines: rows out of order are found inside them and between them."""
    conf("spark.sql.files.maxPartitionBytes", "64")
    conf("spark.sql.files.openCostInBytes", "1")
    keys = [f"{i:04}" for i in range(200)]
    for name, order in (("good", keys), ("bad", [*keys[100:], *keys[:100]]), ("back", keys[::-1])):
        spark.createDataFrame([(k,) for k in order], "obj_id STRING").coalesce(1).write.csv(str(tmp_path / name), header=True)
        stored = spark.read.schema("obj_id STRING").csv(str(tmp_path / name), header=True)
        assert stored.rdd.getNumPartitions() > 8
        ((n_rows, out_of_order),) = rows(inventory.order_inside_files(stored, ["obj_id"]).drop("file"))
        assert (n_rows, out_of_order) == (200, {"good": 0, "bad": 1, "back": 199}[name])


def test_first_merge(spark, tmp_path):
    path = inventory.create_state(spark, str(tmp_path / "state"))
    inventory.merge_day(spark, path, batch(spark, (1, "a", "v", "c", "vm")), 1, 5)
    inventory.create_state(spark, path)
    inventory.merge_day(spark, path, batch(spark, (1, "a", "v", "c", "vm")), 1, 6)
    assert [r.upd_tv for r in spark.read.schema(STATE).parquet(path).collect()] == [5]


def test_changed_days(spark):
    current = state(
        spark,
        (1, "a", "v", "c", "vm", 5),
        (2, "a", "v", "c", "vm", 5),
        (3, "a", "v", "c", "vm", 5),
        (4, "a", "v", "c", "vm", None),
        (3, "b", "v", "c", "vm", 7),
    )
    marks = spark.createDataFrame([(1, 5), (2, 4), (2, 3)], "crdate INT, upd_tv BIGINT")
    assert rows(inventory.changed_days(current, marks), "crdate") == [(2, 5), (3, 7)]


def test_extract_cycle(spark, tmp_path):
    marks, out = str(tmp_path / "marks"), str(tmp_path / "out")
    inventory.create_marks(spark, marks)
    current = state(spark, (20240102, "b", "v", "c", "vm", 5), (20240102, "a", "v", 'x,"y"', "disk", 4), (20240103, "a", "v", None, "vm", 2))

    def extract():
        return spark.read.schema("dt STRING, obj_id STRING, obj_type STRING, vm_id STRING, cluster_id STRING").option(
            "header", "true"
        ).csv(out)

    inventory.extract_changed(spark, current, marks, out)
    assert rows(extract().select(*inventory.EXTRACT_COLUMNS), "dt", "obj_id") == [
        ("2024-01-02", "a", "disk", "v", 'x,"y"'),
        ("2024-01-02", "b", "vm", "v", "c"),
        ("2024-01-03", "a", "vm", "v", None),
    ]
    day = next(f for f in extract().inputFiles() if "day=20240102" in f)
    lines = [r[0] for r in spark.read.text(day).collect()]
    assert lines[0] == "dt,obj_id,obj_type,vm_id,cluster_id" and lines[1].startswith("2024-01-02,a,")
    before = set(extract().inputFiles())
    inventory.extract_changed(spark, current, marks, out)
    assert set(extract().inputFiles()) == before
    later = current.unionByName(state(spark, (20240103, "c", "v", "c", "vm", 9)))
    inventory.extract_changed(spark, later, marks, out)
    assert extract().count() == 4
    assert {f for f in extract().inputFiles() if "day=20240102" in f} < before
    assert inventory.changed_days(later, inventory.read_marks(spark, marks)).isEmpty()


def test_marks_are_replaced(spark, tmp_path):
    marks = inventory.create_marks(spark, str(tmp_path / "marks"))
    for stamp in range(1, 6):
        days = spark.createDataFrame([(1, stamp), (stamp, stamp)], "crdate INT, upd_tv BIGINT").distinct()
        inventory.save_marks(days, marks)
    assert rows(inventory.read_marks(spark, marks), "crdate") == [(1, 5), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert len(spark.read.parquet(marks).inputFiles()) == 1


def test_extract_scans_the_state_once_for_the_write(spark, tmp_path):
    path = str(tmp_path / "state")
    write_partitions(state(spark, *[(d, "a", "v", "c", "vm", d) for d in range(20240101, 20240106)]), path, ["crdate"])
    days = spark.createDataFrame([(20240105, 5)], "crdate INT, upd_tv BIGINT").where("upd_tv > 4")
    text = plan_text(inventory.daily_extract(spark.read.schema(STATE).parquet(path), days))
    assert text.count("FileScan parquet") == 1 and "rangepartitioning" not in text


def test_recent_days():
    assert inventory.recent_days(dt.datetime(2022, 12, 31, 21, 30)) == [20221231, 20230101]
    assert inventory.recent_days(dt.datetime(2022, 12, 31, 20, 30)) == [20221230, 20221231]


def test_extract_of_some_days(spark, tmp_path):
    marks, out = str(tmp_path / "marks"), str(tmp_path / "out")
    inventory.create_marks(spark, marks)
    current = state(spark, (20240102, "b", "v", "c", "vm", 5), (20240103, "a", "v", None, "vm", 2))
    inventory.extract_changed(spark, current, marks, out, only=[20240103])
    assert rows(inventory.read_marks(spark, marks)) == [(20240103, 2)]
    assert attribution.read_dictionary(spark, f"{out}/*").count() == 1


def test_extract_prunes_days(spark, tmp_path):
    path = str(tmp_path / "state")
    write_partitions(state(spark, *[(d, "a", "v", "c", "vm", d) for d in range(1, 6)]), path, ["crdate"])
    stored = spark.read.schema(STATE).parquet(path)
    days = spark.createDataFrame([(5, 5)], "crdate INT, upd_tv BIGINT").where("upd_tv > 4")
    extract = inventory.daily_extract(stored, days)
    assert "dynamicpruning" in plan_text(extract)
    assert extract.count() == 1


@pytest.mark.parametrize("copies", [1, 5000])
def test_hot_key_reaches_the_shuffle_once_per_task(spark, copies):
    many = spark.range(copies).select(
        F.lit(1).alias("crdate"), F.lit("hot").alias("obj_id"), F.format_string("v%05d", "id").alias("vm_id"),
        F.lit("c").alias("cluster_id"), F.lit("vm").alias("otype"),
    )
    assert rows(inventory.upsert_changed(state(spark), many, 1)) == [(1, "hot", f"v{copies - 1:05d}", "c", "vm", 1)]

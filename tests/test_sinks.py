import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import plan_text, rows
from millrace.operators.aggregates import prefix_average_range
from millrace.operators.diagnostics import dataset_inventory, registration_batches
from millrace.sinks import catalog, files, partitions
from millrace.sources import tables as readers

SCHEMA = "x INT, k STRING"


def frame(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "data")
    return partitions.write_partitions(frame(spark, (1, "a"), (2, "b"), (3, None)), path, ["k"])


def content(spark, path):
    return sorted(rows(spark.read.schema(SCHEMA).parquet(path)), key=str)


def test_first_write_and_no_overlap(spark, stored):
    partitions.write_partitions(frame(spark, (4, "c")), stored, ["k"], "fail")
    assert content(spark, stored) == [(1, "a"), (2, "b"), (3, None), (4, "c")]


@pytest.mark.parametrize("values", [[(9, "a"), (9, "c")], [(9, "a"), (9, "b"), (9, None)], [(9, None)]])
def test_fail_writes_nothing(spark, stored, values):
    with pytest.raises(partitions.PartitionConflict):
        partitions.write_partitions(frame(spark, *values), stored, ["k"], "fail")
    assert content(spark, stored) == [(1, "a"), (2, "b"), (3, None)]


def test_conflicts_are_listed(spark, stored):
    found = partitions.conflicting_partitions(frame(spark, (9, "a"), (9, None), (9, "c")), stored, ["k"])
    assert sorted(rows(found), key=str) == [("a",), (None,)]


def test_replace_leaves_the_others(spark, stored):
    partitions.write_partitions(frame(spark, (9, "a"), (8, None)), stored, ["k"], "replace")
    assert content(spark, stored) == [(2, "b"), (8, None), (9, "a")]


def test_append(spark, stored):
    partitions.write_partitions(frame(spark, (9, "a")), stored, ["k"], "append")
    assert content(spark, stored) == [(1, "a"), (2, "b"), (3, None), (9, "a")]


def test_unknown_mode(spark, stored):
    with pytest.raises(ValueError):
        partitions.write_partitions(frame(spark, (9, "a")), stored, ["k"], "merge")


def test_whole_overwrite_drops_other_partitions(spark, stored, conf):
    conf("spark.sql.sources.partitionOverwriteMode", "dynamic")
    files.overwrite(frame(spark, (9, "z")), stored)
    assert spark.read.parquet(stored).count() == 1


def test_hot_partition_is_split(spark, conf, tmp_path):
    """One partition holds nearly all rows; it is written by several tasks."""
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    # Many map tasks, as a cluster would have: a reducer's input is split by map output.
    df = spark.range(0, 400000, numPartitions=32).select(
        F.md5(F.col("id").cast("string")).alias("x"), F.when(F.col("id") < 10, F.col("id")).otherwise(-1).alias("k")
    )
    path = partitions.write_partitions(df, str(tmp_path / "hot"), ["k"])
    layout = {r.k: (r.n_files, r.n_rows) for r in dataset_inventory(spark, path, ["k"]).collect()}
    assert layout[-1][1] == 399990 and layout[-1][0] > 3
    assert all(layout[k] == (1, 1) for k in range(10))


def test_repartition_by_number(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    path = partitions.write_partitions(df, str(tmp_path / "n"), ["k"], tasks=5)
    assert sorted(r.n_files for r in dataset_inventory(spark, path, ["k"]).collect()) == [1, 1, 1]


def test_inventory_reads_no_data_column(spark, stored):
    layout = dataset_inventory(spark, stored, ["k"])
    assert "ReadSchema: struct<>" in plan_text(layout)
    assert sorted(r.n_rows for r in layout.collect()) == [1, 1, 1]
    assert all(r.n_bytes > 0 for r in layout.collect())


def test_recompress(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.range(0, 1000, numPartitions=4).withColumn("t", F.md5(F.col("id").cast("string")))
    df.write.parquet(source)
    files.recompress(spark, source, target, files=2)
    copy = readers.read_glob(spark, target, "part-*")
    assert copy.exceptAll(df).isEmpty() and copy.count() == 1000
    names = [name for name in copy.inputFiles()]
    assert len(names) == 2 and all(".gz." in name for name in names)
    sums = {"id_sum": F.col("id")}
    assert files.content_sums(copy, sums).first() == files.content_sums(df, sums).first()


@pytest.mark.parametrize("n_rows", [0, 1, 3, 10_000])
def test_recompress_deals_out_pieces(spark, tmp_path, conf, n_rows):
    """A file is put together from pieces: the shuffle is cut finer than the files, and rows stay even."""
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.range(0, n_rows, numPartitions=3).withColumn("t", F.when(F.col("id") % 7 > 0, F.md5(F.col("id").cast("string"))))
    df.write.parquet(source)
    conf("spark.sql.shuffle.partitions", "90")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    files.recompress(spark, source, target, files=3)
    tracker = spark.sparkContext.statusTracker()
    new = set(tracker.getJobIdsForGroup()) - set(before)
    tasks = [tracker.getStageInfo(s).numTasks for j in new for s in tracker.getJobInfo(j).stageIds]
    assert 90 in tasks
    copy = readers.read_glob(spark, target, "part-*")
    assert copy.exceptAll(df).isEmpty() and copy.count() == n_rows
    assert len(copy.inputFiles()) == 3 if n_rows == 10_000 else 1 <= len(copy.inputFiles()) <= 3
    counts = [r["count"] for r in copy.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert n_rows < 10_000 or max(counts) - min(counts) < 100
    conf("spark.sql.shuffle.partitions", "4")
    files.recompress(spark, source, target, files=3)
    assert readers.read_glob(spark, target, "part-*").exceptAll(df).isEmpty()


def test_write_once(spark, tmp_path):
    path = files.write_once(spark.range(3), str(tmp_path / "once"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_once(spark.range(3), path)


def test_csv_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "x INT, s STRING")
    path = files.write_csv(df, str(tmp_path / "csv"))
    assert rows(readers.read_csv(spark, path, df.schema), "x") == [(1, 'a,"b"'), (2, None)]


@pytest.fixture
def database(spark, tmp_path):
    name = catalog.create_database(spark, f"db_{tmp_path.name}", str(tmp_path / "db"))
    yield name
    catalog.use_database(spark, "default")
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_orc_rows_and_varchar_length(spark, database):
    spark.sql(f"CREATE TABLE {database}.test1 (a INT NOT NULL, b VARCHAR(5)) USING orc")
    literal = [(1, "One"), (2, "Two"), (3, "Three")]
    assert rows(catalog.insert_values(spark, f"{database}.test1", literal), "a") == literal
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        catalog.insert_values(spark, f"{database}.test1", [(4, "longer")])


def test_external_table_keeps_files(spark, database, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([(1, "ab", 2.0)], "a INT, s STRING, d DOUBLE").write.parquet(path)
    declared = readers.external_table(spark, f"{database}.dset1", "a INT, s BINARY", path)
    assert rows(declared) == [(1, bytearray(b"ab"))]
    catalog.drop_table(spark, f"{database}.dset1")
    assert spark.read.parquet(path).count() == 1


def test_views_databases_and_tables(spark, database):
    views = catalog.create_series_views(spark, database, 5000)
    assert [spark.table(v).count() for v in views] == [1000, 5000, 5000]
    assert spark.table(views[1]).agg(F.min("num"), F.max("num")).first() == (1, 5000)
    catalog.use_database(spark, database)
    assert spark.sql("SELECT COUNT(*) FROM (SELECT DISTINCT d FROM uuid_series) x").first()[0] == 5000
    assert (database,) in rows(catalog.list_databases(spark))
    assert rows(catalog.list_tables(spark, database), "name") == [("numbers",), ("numbers_1k",), ("uuid_series",)]


def test_partitioned_table_and_pruning(spark, database, tmp_path):
    columns = "num BIGINT, a VARCHAR(50), y INT, m INT"
    name = catalog.create_partitioned_table(spark, f"{database}.mega", columns, ["y", "m"], str(tmp_path / "mega"))
    df = spark.range(1, 101).select(
        (F.col("id") % 4 + 2000).cast("int").alias("y"), F.lit(1).alias("m"), F.md5(F.col("id").cast("string")).alias("a"),
        F.col("id").alias("num"),
    )
    loaded = catalog.insert_rows(df, name, cluster_by=["y", "m"])
    assert loaded.count() == 100
    pruned = loaded.where("y BETWEEN 2001 AND 2002").select("num")
    text = plan_text(pruned)
    assert "PartitionFilters: [isnotnull(y" in text and "ReadSchema: struct<num:bigint>" in text
    assert pruned.count() == 50


def test_registration(spark, database, tmp_path):
    path = partitions.write_partitions(spark.range(10).withColumn("k", F.col("id") % 5), str(tmp_path / "p"), ["k"])
    table = readers.external_table(spark, f"{database}.late", "id BIGINT, k BIGINT", path, partitioned_by="k")
    assert table.count() == 0
    assert catalog.register_partitions(spark, f"{database}.late").count() == 5
    assert spark.table(f"{database}.late").count() == 10


def test_create_table_as(spark, database):
    made = catalog.create_table_as(spark, f"{database}.dset2", spark.range(3).select(F.col("id").alias("a")))
    assert rows(made, "a") == [(0,), (1,), (2,)]


def test_rebalance_hint_in_plan(spark):
    assert "REBALANCE" in plan_text(partitions.clustered(spark.range(5).withColumn("k", F.lit(1)), ["k"]))


def test_statements_typed_as_sql(spark, database):
    """A stock ledger as a user types it: a view over a common table, a hint, an interval, a prefix."""
    catalog.use_database(spark, database)
    spark.sql("""
        CREATE VIEW movements AS
        WITH items AS (SELECT id AS item, sha1(string(id)) AS code FROM range(600))
        SELECT item, upper(code) AS code, DATE'2010-01-31' + make_ym_interval(0, int(item % 30)) AS moved, item * 3 AS units
        FROM items""")
    spark.sql("CREATE TABLE ledger (item BIGINT, code CHAR(40), units BIGINT, quarter INT) USING parquet PARTITIONED BY (quarter)")
    spark.sql("INSERT INTO ledger SELECT /*+ REPARTITION(4, quarter) */ item, code, units, int(quarter(moved)) AS quarter FROM movements")
    assert spark.sql("SELECT COUNT(*), SUM(units) FROM ledger").first() == (600, 3 * 599 * 300)
    spread = spark.sql("""
        WITH means AS (SELECT left(code, 1) AS shelf, AVG(item) AS mean FROM ledger WHERE quarter >= 3 GROUP BY ALL)
        SELECT MAX(mean) - MIN(mean) FROM means""")
    stored = spark.table("ledger").where("quarter >= 3")
    assert spread.first()[0] == prefix_average_range(stored, F.col("code"), 1, F.col("item")).first()[0]
    shelf = spark.sql("SELECT item, code FROM ledger WHERE quarter = 2 AND startswith(code, 'A')")
    assert shelf.count() > 0 and all(row.code[0] == "A" for row in shelf.collect())
    assert "PartitionFilters: [isnotnull(quarter" in plan_text(shelf)


def test_external_table_leaves_managed_tables(spark, database, tmp_path):
    spark.range(5).write.saveAsTable(f"{database}.kept")
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="MANAGED"):
        readers.external_table(spark, f"{database}.kept", "id BIGINT", str(tmp_path / "other"))
    assert spark.table(f"{database}.kept").count() == 5
    readers.external_table(spark, f"{database}.seen", "id BIGINT", str(tmp_path / "other"))
    spark.range(7).write.parquet(str(tmp_path / "third"))
    assert readers.external_table(spark, f"{database}.seen", "id BIGINT", str(tmp_path / "third")).count() == 7


def test_conflicts_are_counted(spark, tmp_path):
    many = spark.range(50).selectExpr("id AS x", "format_string('%03d', id) AS k")
    path = partitions.write_partitions(many, str(tmp_path / "d"), ["k"])
    with pytest.raises(partitions.PartitionConflict, match="50 of the incoming partitions, from k=000 to k=049"):
        partitions.write_partitions(many, path, ["k"])


def test_fail_runs_the_incoming_query_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    incoming = spark.range(20).selectExpr("id AS x", "id % 3 AS k").mapInArrow(count, "x long, k long")
    path = partitions.write_partitions(incoming, str(tmp_path / "once"), ["k"])
    assert ran.value == 20
    partitions.write_partitions(incoming.withColumn("k", F.col("k") + 10), path, ["k"])
    assert ran.value == 40 and spark.read.parquet(path).count() == 40


def test_hot_partition_by_number_is_spread(spark, tmp_path):
    df = spark.range(2000).withColumn("k", F.lit(1))
    path = partitions.write_partitions(df, str(tmp_path / "s"), ["k"], tasks=16, spread=8)
    assert dataset_inventory(spark, path, ["k"]).first().n_files > 3


def test_two_writers_at_once(spark, tmp_path):
    """Of two exclusive writers with some partitions in common one is refused and leaves nothing."""
    path = str(tmp_path / "data")
    batches = [frame(spark, *[(i, k) for k in keys]) for i, keys in enumerate(["abcd", "cdef"])]
    for _ in range(3):
        barrier = threading.Barrier(2)

        def write(batch):
            barrier.wait()
            try:
                partitions.write_partitions(batch, path, ["k"], "fail", exclusive=True)
            except partitions.PartitionConflict:
                return True
            return False

        with ThreadPoolExecutor(2) as pool:
            refused = list(pool.map(write, batches))
        assert sum(refused) == 1
        winner = refused.index(False)
        assert content(spark, path) == sorted(((winner, k) for k in ["abcd", "cdef"][winner]), key=str)
        path += "x"


def test_claims_are_given_back(spark, stored):
    claims = Path(stored) / partitions.CLAIMS
    with pytest.raises(partitions.PartitionConflict):
        partitions.write_partitions(frame(spark, (9, "a")), stored, ["k"], "fail", exclusive=True)
    assert not [f for f in claims.iterdir() if not f.name.startswith(".")]
    with partitions.claimed(frame(spark, (9, "z/ %"), (9, None)), stored, ["k"]) as held:
        assert len(held) == 2
        with pytest.raises(partitions.PartitionConflict):
            partitions.write_partitions(frame(spark, (9, "z/ %"), (9, "a")), stored, ["k"], "replace", exclusive=True)
        partitions.write_partitions(frame(spark, (9, "b")), stored, ["k"], "replace", exclusive=True)
    assert content(spark, stored) == [(1, "a"), (3, None), (9, "b")]
    # A claim of a writer that was killed.
    (claims / "k%3Da").touch()
    with pytest.raises(partitions.PartitionConflict):
        partitions.write_partitions(frame(spark, (9, "a")), stored, ["k"], "append", exclusive=True)
    partitions.drop_claims(spark, stored)
    partitions.write_partitions(frame(spark, (9, "a")), stored, ["k"], "append", exclusive=True)
    assert (9, "a") in content(spark, stored)


def test_registration_goes_on_where_it_broke_off(spark, database, tmp_path):
    path, log = str(tmp_path / "data"), str(tmp_path / "log")
    values = ["a", "b c", "d'e", "f/g", "h+i", "j\\k", "l=m", "100%", "n"]
    partitions.write_partitions(frame(spark, *enumerate(values)), path, ["k"])
    readers.external_table(spark, f"{database}.loaded", SCHEMA, path, partitioned_by="k")
    assert catalog.add_missing_partitions(spark, f"{database}.loaded", path, ["k"], log, batch=2, limit=2) == 2
    assert spark.table(f"{database}.loaded").count() == 4
    assert catalog.missing_partitions(spark, f"{database}.loaded", path, ["k"]).count() == 5
    assert catalog.add_missing_partitions(spark, f"{database}.loaded", path, ["k"], log, batch=2) == 3
    assert sorted(rows(spark.table(f"{database}.loaded").select("k"))) == sorted((v,) for v in values)
    assert catalog.add_missing_partitions(spark, f"{database}.loaded", path, ["k"], log) == 0
    report = registration_batches(spark.read.text(log)).first()
    assert (report.batches, report.partitions, report.n_other) == (5, 9, 0)

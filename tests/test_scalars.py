import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.functions import scalars


def test_md5_of_four_byte_int(spark):
    df = spark.createDataFrame([(21,), (-1,), (2147483647,)], "x INT")
    digests = [row[0] for row in df.select(scalars.md5_of_int(F.col("x"))).collect()]
    assert digests[0] == "009d30980aa408f62a12e0e7e7acbd17"
    import hashlib

    assert digests[1:] == [hashlib.md5(v.to_bytes(4, "big", signed=True)).hexdigest() for v in (-1, 2147483647)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_business_day_ignores_session_zone(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    moments = ["2024-01-01 20:59:59", "2024-01-01 21:00:00", "2022-12-31 23:30:00", "2024-03-10 02:30:00"]
    df = spark.createDataFrame([(m,) for m in moments], "m STRING").select(F.col("m").cast("timestamp_ntz").alias("m"))
    days = [row[0] for row in df.select(scalars.business_day(F.col("m"))).collect()]
    assert days == [20240101, 20240102, 20230101, 20240310]


def test_day_text_and_number(spark):
    df = spark.createDataFrame([(20240105,), (20221231,)], "d INT")
    assert [r[0] for r in df.select(scalars.day_text(F.col("d"))).collect()] == ["2024-01-05", "2022-12-31"]
    df = spark.createDataFrame([(dt.date(2024, 1, 5),)], "d DATE")
    assert df.select(scalars.day_number(F.col("d"))).first()[0] == 20240105


def test_timestamp_text_ignores_session_zone(spark, conf):
    conf("spark.sql.session.timeZone", "America/New_York")
    moments = ["2024-03-10 02:30:00", "2024-03-10 02:30:00.5", "2024-01-01 00:00:07.179575"]
    df = spark.createDataFrame([(m,) for m in moments], "m STRING").select(F.col("m").cast("timestamp_ntz").alias("m"))
    assert [row[0] for row in df.select(scalars.timestamp_text(F.col("m"))).collect()] == [
        "2024-03-10 02:30:00.000000",
        "2024-03-10 02:30:00.500000",
        "2024-01-01 00:00:07.179575",
    ]


def test_check_not_null(spark):
    good = spark.createDataFrame([(1, "a")], "x INT, `dotted.name` STRING")
    assert rows(scalars.check_not_null(good, ["x", "dotted.name"])) == [(1, "a")]
    bad = spark.createDataFrame([(1, "a"), (None, "b")], "x INT, y STRING")
    assert scalars.check_not_null(bad, ["y"]).count() == 2
    with pytest.raises(Exception, match="NULL in column x"):
        scalars.check_not_null(bad, ["x"]).collect()


def test_non_empty(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "x STRING")
    assert rows(df.where(scalars.non_empty(F.col("x")))) == [("a",)]

"""Column helpers. All are built-in expressions and stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the zone in which a business day begins.
BUSINESS_ZONE = "Europe/Moscow"


def md5_of_int(value: Column) -> Column:
    """MD5 of an INT taken as its four big-endian bytes.

    ANSI mode rejects a cast of INT to BINARY. ``hex`` gives up to 16 digits (all 16 for
    a negative number); the last eight are the four bytes.
    """
    digits = F.substring(F.lpad(F.hex(value), 16, "0"), 9, 8)
    return F.md5(F.unhex(digits))


def business_day(instant_utc: Column, zone: str = BUSINESS_ZONE) -> Column:
    """UTC wall-clock time (TIMESTAMP_NTZ) -> local day as an INT of the form YYYYMMDD.

    Works on TIMESTAMP_NTZ throughout, so the session time zone does not matter.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), instant_utc)
    return day_number(local)


def day_number(moment: Column) -> Column:
    """Date or timestamp -> INT of the form YYYYMMDD."""
    return F.year(moment) * 10000 + F.month(moment) * 100 + F.dayofmonth(moment)


def day_text(day: Column) -> Column:
    """INT of the form YYYYMMDD -> text YYYY-MM-DD."""
    digits = F.lpad(day.cast("string"), 8, "0")
    return F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))


def timestamp_text(moment: Column) -> Column:
    """TIMESTAMP_NTZ -> text with six decimals.

    The plain cast drops trailing zeros, and ``date_format`` would go through the session's
    time zone, where some wall-clock times do not exist.
    """
    text = moment.cast("string")
    return F.rpad(F.when(F.length(text) == 19, F.concat(text, F.lit("."))).otherwise(text), 26, "0")


def date_parts(moment: Column, prefix: str) -> list[Column]:
    """Year, month and day of a timestamp as three INT columns."""
    return [
        F.year(moment).alias(f"{prefix}_year"),
        F.month(moment).alias(f"{prefix}_month"),
        F.dayofmonth(moment).alias(f"{prefix}_day"),
    ]


def non_empty(value: Column) -> Column:
    """Neither NULL nor the empty string."""
    return value.isNotNull() & (value != "")


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the job when one of the columns is NULL.

    File tables do not enforce NOT NULL. The check is part of the row expression, so it
    costs no extra pass over the data. A column that is dropped later is not checked.
    """
    checked = {
        name: F.coalesce(
            quoted(name),
            F.raise_error(F.lit(f"NULL in column {name}")).cast(df.schema[name].dataType),
        )
        for name in columns
    }
    return df.withColumns(checked)

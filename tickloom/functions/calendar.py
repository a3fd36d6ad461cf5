"""The exchange calendar as a DataFrame, and sessions by join.

Sessions are 09:30 to 16:00 in New York (or an early close), held as UTC
timestamps without zone.  A calendar has one row a day of a bounded range, so
its size is known and it may be broadcast.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days of a calendar that may be broadcast (some kilobytes a year).
MAX_DAYS = 40_000
# The regular session in New York.
OPEN, CLOSE, ZONE = "09:30", "16:00", "America/New_York"


def to_utc(day: Column, clock: Column) -> Column:
    local = F.to_timestamp_ntz(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock), F.lit("yyyy-MM-dd HH:mm"))
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), local)


def trading_calendar(
    spark: SparkSession, first: str, last: str, holidays: list[str] = (), early_closes: dict[str, str] | None = None
) -> DataFrame:
    """session_date, open_time, close_time of each trading day from first to last."""
    if (date.fromisoformat(last) - date.fromisoformat(first)).days > MAX_DAYS:
        raise ValueError("the calendar is too long")
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS session_date")
    days = days.where(F.dayofweek("session_date").between(2, 6))
    if holidays:
        days = days.where(~F.date_format("session_date", "yyyy-MM-dd").isin(list(holidays)))
    close = F.lit(CLOSE)
    for day, clock in sorted((early_closes or {}).items()):
        close = F.when(F.col("session_date") == F.lit(day).cast("date"), clock).otherwise(close)
    return days.select(
        "session_date", to_utc(F.col("session_date"), F.lit(OPEN)).alias("open_time"), to_utc(F.col("session_date"), close).alias("close_time")
    )


def in_session(rows: DataFrame, calendar: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` lies in [open, close) of its UTC date."""
    sessions = F.broadcast(calendar.select(F.col("session_date").alias("_day"), F.col("open_time").alias("_open"), F.col("close_time").alias("_close")))
    on = (F.to_date(column) == F.col("_day")) & (F.col(column) >= F.col("_open")) & (F.col(column) < F.col("_close"))
    return rows.join(sessions, on, "left_semi")


def next_session_time(rows: DataFrame, calendar: DataFrame, column: str, out: str, interval: int = 60) -> DataFrame:
    """``out``: ``column`` itself in a session, else the next session's open.

    The calendar is an array of a known size in a one-row broadcast, and the
    next open is looked up in it; rows after its end get null.
    """
    days = calendar.agg(F.array_sort(F.collect_list(F.struct("open_time", "close_time"))).alias("_days"))
    following = F.expr(f"element_at(filter(_days, d -> d.close_time > {column}), 1)")
    rows = rows.join(F.broadcast(days)).withColumn("_next", following)
    rows = rows.withColumn(out, F.when(F.col(column).isNotNull(), F.greatest(F.col("_next.open_time"), F.col(column))))
    return rows.drop("_days", "_next")


def next_tradable_time(column: str, open_time: str, interval: int) -> Column:
    """Inside a session: the next multiple of ``interval`` minutes from the open."""
    minutes = F.timestamp_diff("MINUTE", F.col(open_time), F.col(column))
    whole = F.ceil(F.greatest(F.lit(0), minutes) / interval) * interval
    return F.timestamp_add("MINUTE", whole.cast("int"), F.col(open_time))

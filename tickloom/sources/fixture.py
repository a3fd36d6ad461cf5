"""A small built-in data set: six articles and hourly bars of two symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.calendar import trading_calendar
from ..functions.identity import iso, stable_id
from ..schemas import RAW_ARTICLES

# The fixture's articles, first and last day, first prices and planted returns.
ARTICLES = [
    ("massive-1", "fixture_finance", "finance", "2026-06-29T14:05:00Z", "SPY breakout on broad earnings strength",
     "Analysts call the move strong and constructive.", "fixture://spy-breakout", ["SPY"], []),
    ("massive-1-dup", "fixture_wire", "finance", "2026-06-29T14:07:00Z", "SPY breakout on broad earnings strength",
     "Analysts call the move strong and constructive.", "fixture://spy-breakout", ["SPY"], []),
    ("massive-2", "fixture_finance", "finance", "2026-06-30T15:05:00Z", "QQQ downgrade follows weak chip demand",
     "The note described weak orders and negative guidance.", "fixture://qqq-downgrade", ["QQQ"], ["technology"]),
    ("gdelt-1", "fixture_macro", "broad", "2026-07-01T13:40:00Z", "Rates relief boosts risk appetite",
     "Lower yields are positive for growth stocks and broad indexes.", "fixture://rates-relief", [], ["rates"]),
    ("gdelt-2", "fixture_macro", "broad", "2026-07-02T21:15:00Z", "Fed shock weighs on markets",
     "A surprise hawkish turn is negative for stocks after the close.", "fixture://after-close", [], ["rates"]),
    ("gdelt-3", "fixture_housing", "broad", "2026-07-06T14:10:00Z", "Housing data remains neutral",
     "Mixed data left investors with a neutral read.", "fixture://housing-neutral", [], ["housing"]),
]
FIRST_DAY, LAST_DAY = "2026-06-29", "2026-07-07"
FIRST_PRICE = {"SPY": 500.0}
OTHER_PRICE, USUAL_RETURN, VOLUME = 425.0, 0.0005, 1_000_000
RETURNS = {
    ("SPY", "2026-06-29T15:30:00Z"): 0.008,
    ("QQQ", "2026-06-30T16:30:00Z"): -0.009,
    ("SPY", "2026-07-01T14:30:00Z"): 0.006,
    ("QQQ", "2026-07-01T14:30:00Z"): 0.007,
    ("SPY", "2026-07-06T13:30:00Z"): -0.007,
    ("QQQ", "2026-07-06T13:30:00Z"): -0.008,
}


def raw_articles(spark: SparkSession, config: Config | None = None) -> DataFrame:
    rows = [(i, *a[:3], None, a[3], *a[4:], None) for i, a in enumerate(ARTICLES)]
    return with_time(spark.createDataFrame(rows, RAW_ARTICLES), "yyyy-MM-dd'T'HH:mm:ssX")


def with_time(rows: DataFrame, pattern: str) -> DataFrame:
    """published_at from published_at_raw; what does not parse is null."""
    parsed = F.try_to_timestamp("published_at_raw", F.lit(pattern))
    return rows.withColumn("published_at", F.convert_timezone(F.current_timezone(), F.lit("UTC"), parsed.cast("timestamp_ntz")))


def price_bars(spark: SparkSession, config: Config) -> DataFrame:
    """Bars of each session; the price starts anew each day and compounds."""
    days = trading_calendar(spark, FIRST_DAY, LAST_DAY, config.holidays, config.early_closes)
    rows = days.withColumn("symbol", F.explode(F.array(*map(F.lit, config.symbols))))
    step = F.expr(f"INTERVAL {config.price_interval_minutes} MINUTE")
    starts = F.sequence("open_time", F.col("close_time") - F.expr("INTERVAL 1 SECOND"), step)
    planted = F.lit(USUAL_RETURN)
    for (symbol, start), value in RETURNS.items():
        planted = F.when((F.col("symbol") == symbol) & (iso(F.col("start_time")) == start), value).otherwise(planted)
    rows = rows.select("symbol", "session_date", F.posexplode(starts).alias("at", "start_time")).withColumn("r", planted)
    first = F.lit(OTHER_PRICE)
    for symbol, price in FIRST_PRICE.items():
        first = F.when(F.col("symbol") == symbol, price).otherwise(first)
    day = rows.groupBy("symbol", "session_date").agg(F.array_sort(F.collect_list(F.struct("at", "start_time", "r"))).alias("day"))
    opens = F.expr("""transform(day, x -> struct(x.start_time AS start_time, x.r AS r,
        aggregate(filter(day, y -> y.at < x.at), first, (p, y) -> p * (1.0D + y.r)) AS open))""")
    day = day.withColumn("first", first.cast("double")).withColumn("bar", F.explode(opens))
    rows = day.select("symbol", "bar.start_time", "bar.open", (F.col("bar.open") * (1 + F.col("bar.r"))).alias("close"))
    rows = rows.withColumn("end_time", F.col("start_time") + step)
    return rows.select(
        stable_id("bar", F.col("symbol"), iso(F.col("start_time")), iso(F.col("end_time"))).alias("bar_id"), "symbol", "start_time", "end_time", "open",
        (F.greatest("open", "close") * 1.001).alias("high"), (F.least("open", "close") * 0.999).alias("low"), "close", F.lit(VOLUME).cast("long").alias("volume"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    """A lexicon of the fixture's own words."""
    good = ["strength", "strong", "constructive", "relief", "boosts", "positive", "growth", "breakout"]
    bad = ["downgrade", "weak", "negative", "shock", "weighs"]
    rows = [(w, 1, 2.0) for w in good] + [(w, -1, -2.0) for w in bad]
    return spark.createDataFrame(rows, "word string, tone int, valence double")

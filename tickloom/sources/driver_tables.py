"""The engine's relations from the driver's tables.

bars: hourly from ``events``, four symbols by user, price = value + 100.
articles: from ``documents``; times, tickers and themes follow from doc_id.
vendor sentiment: from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Thresholds
from ..functions.calendar import trading_calendar
from ..functions.identity import iso, stable_id

# The lexicon of the driver's invented language.
GOOD = ["the", "thing", "onble", "best", "la", "les", "und"]
BAD = ["worthless", "idiot", "scum", "threat", "er", "de", "der", "ention"]
VALENCE = [("and", 1.2), ("of", -0.8), ("to", 0.5), ("en", -1.1), ("is", 0.9), ("not", -0.4), ("moron", -3.0), ("that", 0.7), ("el", 1.0), ("le", -0.6), ("die", 0.8), ("ein", -1.3)]
HOLIDAYS, EARLY = ["2024-01-01", "2024-01-15"], {"2024-01-12": "13:00"}
FIRST, LAST = "2024-01-01", "2024-02-09"

CONFIG = Config(
    run_id="driver_tables",
    symbols=["S0", "S1", "S2", "S3"],
    source_sets=["finance_only", "broad_news", "finance_plus_broad"],
    news_windows_minutes=[60, 240],
    measurement_horizons_minutes=[60, 120],
    costs_bps=[5.0],
    holidays=HOLIDAYS,
    early_closes=EARLY,
    theme_symbol_map={"rates": ["S1", "S3"]},
    constituent_etf_map={"S2": ["S0"]},
    macro_symbols=["S0", "S1"],
    dataset_start="2024-01-02",
    dataset_end="2024-01-29",
    verdict_thresholds=Thresholds(min_lexicon_hit_rate=0.3),
)
DATASET = "ds_driver"


def price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("start_time"),
        F.struct("ts", "event_id").alias("at"), (F.col("value") + 100).alias("price"),
    )
    rows = events.groupBy("symbol", "start_time").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.count(F.lit(1)).alias("volume")
    )
    rows = rows.withColumn("end_time", F.col("start_time") + F.expr("INTERVAL 1 HOUR"))
    bar = stable_id("bar", F.col("symbol"), iso(F.col("start_time")), iso(F.col("end_time")))
    return rows.select(bar.alias("bar_id"), "symbol", "start_time", "end_time", "open", "high", "low", "close", "volume")


def articles_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw articles before their labels: a join on these need not carry texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    time = F.timestamp_add("MINUTE", (n * 26699 % 43200).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    missing, garbled, silent = n % 97 == 0, n % 89 == 0, n % 101 == 0
    title = F.substring_index(text, "\n", 1)
    none = F.array().cast("array<string>")
    return docs.select(
        n.alias("ordinal"), n.cast("string").alias("vendor_id"), "source", F.when(F.regexp_extract("source", "([0-9]+)", 1).cast("long") % 2 == 0, "finance").otherwise("broad").alias("source_kind"),
        F.when(~missing & ~garbled, time).alias("published_at"), F.when(missing, "").when(garbled, "some day").otherwise(iso(time)).alias("published_at_raw"),
        F.when(silent, "").otherwise(title).alias("title"), F.when(silent, " ").otherwise(F.substr(text, F.length(title) + 2)).alias("summary"),
        F.concat(F.lit("doc://"), F.md5(text.cast("binary"))).alias("url"), F.when(n % 5 == 0, none).when(n % 53 == 0, F.array(F.lit("ELSE"))).otherwise(F.array(F.concat(F.lit("S"), (n % 4).cast("string")))).alias("tickers"),
        F.when(n % 10 == 0, F.array(F.lit("rates"))).otherwise(none).alias("themes"),
    )


def with_labels(articles: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    vendor = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    known = labels.select(F.col("doc_id").alias("ordinal"), vendor.alias("vendor_sentiment")).groupBy("ordinal").agg(F.min("vendor_sentiment").alias("vendor_sentiment"))
    return articles.join(known, "ordinal", "left")


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_labels(articles_alone(spark, sf_dir), spark, sf_dir)


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(w, 1, None) for w in GOOD] + [(w, -1, None) for w in BAD] + [(w, None, v) for w, v in VALENCE]
    return spark.createDataFrame(rows, "word string, tone int, valence double")


def calendar(spark: SparkSession) -> DataFrame:
    return trading_calendar(spark, FIRST, LAST, HOLIDAYS, EARLY)

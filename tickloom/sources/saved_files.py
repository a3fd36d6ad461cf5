"""Saved vendor payloads: Massive and GDELT news, Alpaca bars."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.identity import iso, stable_id
from ..schemas import ALPACA_PAYLOAD, GDELT_PAYLOAD, MASSIVE_PAYLOAD
from .fixture import with_time

# Vendor sentiment labels.
SENTIMENT = {"positive": 1.0, "negative": -1.0, "neutral": 0.0}


def payloads(spark: SparkSession, folder: str, prefix: str, schema: T.StructType) -> DataFrame:
    """All payload files of a prefix, by Spark's JSON reader with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"{prefix}*.json").json(folder).withColumn("_file", F.col("_metadata.file_path"))


def _numbered(rows: DataFrame, start: int) -> DataFrame:
    """Input order: sources, files by path, places in a file.  No two rows share a number."""
    files = sorted(r["_file"] for r in rows.select("_file").distinct().collect())  # as many as the folder lists
    ranks = rows.sparkSession.createDataFrame(list(enumerate(files)), "_rank long, _file string")
    place = F.lit(start << 60) + F.shiftleft("_rank", 30) + F.col("_at")
    return rows.join(ranks, "_file").withColumn("ordinal", place.cast("long")).drop("_rank")


def massive_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = payloads(spark, folder, "massive_", MASSIVE_PAYLOAD).select("_file", F.posexplode("results").alias("_at", "r"))
    known = F.filter(F.transform(F.coalesce("r.insights", F.array().cast("array<struct<ticker:string,sentiment:string>>")), lambda x: _label(x["sentiment"])), lambda v: v.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))
    empty = F.array().cast("array<string>")
    rows = rows.select(
        "_file", "_at", F.col("r.id").alias("vendor_id"), F.col("r.publisher.name").alias("source"), F.lit("finance").alias("source_kind"), F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.coalesce("r.published_utc", F.lit("")).alias("published_at_raw"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.description", F.lit("")).alias("summary"),
        F.coalesce("r.article_url", F.lit("")).alias("url"), F.coalesce("r.tickers", empty).alias("tickers"), empty.alias("themes"), mean.alias("vendor_sentiment"),
    )
    return with_time(_numbered(rows, 0), "yyyy-MM-dd'T'HH:mm:ssX").drop("_file", "_at")


def _label(sentiment):
    out = F.lit(None).cast("double")
    for name, value in SENTIMENT.items():
        out = F.when(sentiment == name, F.lit(value)).otherwise(out)
    return out


def gdelt_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = payloads(spark, folder, "gdelt_", GDELT_PAYLOAD).select("_file", F.posexplode("articles").alias("_at", "r"))
    empty = F.array().cast("array<string>")
    rows = rows.select(
        "_file", "_at", F.col("r.url").alias("vendor_id"), F.col("r.domain").alias("source"), F.lit("broad").alias("source_kind"), F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.coalesce("r.seendate", F.lit("")).alias("published_at_raw"), F.coalesce("r.title", F.lit("")).alias("title"), F.lit("").alias("summary"), F.coalesce("r.url", F.lit("")).alias("url"),
        empty.alias("tickers"), empty.alias("themes"), F.lit(None).cast("double").alias("vendor_sentiment"),
    )
    return with_time(_numbered(rows, 1), "yyyyMMdd'T'HHmmssX").drop("_file", "_at")


def _exists(folder: str) -> None:
    if "://" not in folder and not Path(folder).is_dir():
        raise FileNotFoundError(f"saved files folder {folder} does not exist")


def raw_articles(spark: SparkSession, config: Config) -> DataFrame:
    _exists(config.saved_files_dir)
    rows = massive_articles(spark, config.saved_files_dir).unionByName(gdelt_articles(spark, config.saved_files_dir))
    if rows.isEmpty():
        raise ValueError("no articles in the saved files")
    return rows


def price_bars(spark: SparkSession, config: Config) -> DataFrame:
    _exists(config.saved_files_dir)
    rows = payloads(spark, config.saved_files_dir, "alpaca_", ALPACA_PAYLOAD).select(F.explode("bars").alias("symbol", "list"))
    rows = rows.select("symbol", F.explode("list").alias("b"))
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp("b.t", F.lit("yyyy-MM-dd'T'HH:mm:ssX")).cast("timestamp_ntz"))
    rows = rows.withColumn("start_time", start).withColumn("end_time", F.col("start_time") + F.make_dt_interval(mins=F.lit(config.price_interval_minutes)))
    rows = rows.select(
        stable_id("bar", F.col("symbol"), iso(F.col("start_time")), iso(F.col("end_time"))).alias("bar_id"), "symbol", "start_time", "end_time",
        F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"),
    )
    if rows.isEmpty():
        raise ValueError("no price bars in the saved files")
    return rows


def missing_symbols(config: Config, bars: DataFrame) -> DataFrame:
    asked = bars.sparkSession.createDataFrame([(s,) for s in config.symbols], "symbol string")
    return asked.join(bars.select("symbol").distinct(), "symbol", "left_anti")

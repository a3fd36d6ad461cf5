"""Structured Streaming forms of the news operators.

``signal_stream`` is the trailing-window join as a stream-stream interval join
with watermarks on both sides; ``first_articles`` keeps the first arrival of a
dedupe key within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_articles(articles: DataFrame, delay: str = "1 day") -> DataFrame:
    return articles.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["dedupe_key"])


def signal_stream(articles: DataFrame, bars: DataFrame, window_minutes: int, delay: str = "1 hour") -> DataFrame:
    """(symbol, signal_time, article_id, sentiment_score) of each article in (signal - window, signal].

    ``articles``: symbol, available_at, article_id, sentiment_score; ``bars``:
    symbol, signal_time.  Both times are timestamps of streams.
    """
    news = articles.select(F.col("symbol").alias("news_symbol"), "available_at", "article_id", "sentiment_score").withWatermark("available_at", delay)
    own = bars.select("symbol", "signal_time").withWatermark("signal_time", delay)
    near = F.expr(f"news_symbol = symbol AND available_at <= signal_time AND available_at > signal_time - INTERVAL {window_minutes} MINUTES")
    return own.join(news, near).select("symbol", "signal_time", "article_id", "sentiment_score")


def windowed_sentiment(articles: DataFrame, window: str = "240 minutes", slide: str = "60 minutes", delay: str = "1 hour") -> DataFrame:
    """Mean sentiment and count of each symbol over sliding windows."""
    rows = articles.withWatermark("available_at", delay).groupBy(F.window("available_at", window, slide), "symbol")
    return rows.agg(F.avg("sentiment_score").alias("mean_sentiment"), F.count(F.lit(1)).alias("article_count"))

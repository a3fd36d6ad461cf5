"""Checks that no observation uses what was not yet known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LookaheadError(RuntimeError):
    pass


def uses(observations: DataFrame) -> DataFrame:
    return observations.select("observation_id", "symbol", "entry_time", F.explode("article_ids").alias("article_id"))


def timestamp_audit(articles: DataFrame, observations: DataFrame) -> DataFrame:
    """Each article's deferral and how many observations use it."""
    counts = uses(observations).groupBy("article_id").agg(F.count(F.lit(1)).alias("observation_count"))
    rows = articles.join(counts, "article_id", "left")
    return rows.select(
        "vendor_id", "source", "published_at", "available_at", (F.col("available_at") != F.col("published_at")).alias("was_deferred"),
        F.timestamp_diff("MINUTE", F.col("published_at"), F.col("available_at")).alias("deferred_by_minutes"), F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
    )


def lookahead_violations(articles: DataFrame, observations: DataFrame) -> DataFrame:
    """Uses before availability.

    An article's earliest use tells whether it has any, so one row an article
    meets the articles; all uses are read again for those that have.
    """
    first = uses(observations).groupBy("article_id").agg(F.min("entry_time").alias("_first"))
    early = articles.select("article_id", "vendor_id", "available_at").join(first, "article_id").where("available_at > _first").drop("_first")
    rows = uses(observations).join(early, "article_id").where("available_at > entry_time")
    return rows.withColumn("minutes_after_entry", F.timestamp_diff("MINUTE", F.col("entry_time"), F.col("available_at")))


def assert_no_lookahead(articles: DataFrame, observations: DataFrame) -> None:
    found = lookahead_violations(articles, observations).limit(5).collect()  # a report of a few
    if found:
        lines = "\n".join(f"{r['observation_id']} uses {r['vendor_id']}, available {r['minutes_after_entry']} minutes after entry" for r in found)
        raise LookaheadError(f"observations use information that did not exist yet:\n{lines}")


def unused_articles(articles: DataFrame, observations: DataFrame) -> DataFrame:
    return articles.join(uses(observations).select("article_id"), "article_id", "left_anti")

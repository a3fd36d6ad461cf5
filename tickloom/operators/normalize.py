"""Raw articles to normalized ones; every raw row ends in exactly one place.

One ordered reason column decides: missing or unparseable time, no text, outside
the data set's dates, later duplicate, no relevant symbol.  Rows without a
reason are normalized, the others are set aside with their disposition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import calendar as cal
from ..functions import text as tx
from ..functions.identity import iso, stable_id

# Reasons of quarantine; the others are exclusions.
QUARANTINED = ["missing_published_at", "unparseable_published_at", "ambiguous_published_at", "missing_title_and_summary"]


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).rlike(r"^\s*$")


def dedupe_key() -> Column:
    tidy = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return F.concat(tidy("url"), F.lit("::"), tidy("title"))


def article_id() -> Column:
    return stable_id("art", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("url"), F.lit("")), iso(F.col("published_at")))


def scope() -> Column:
    return F.when(F.size("tickers") > 0, "ticker_specific").when(F.size("themes") > 0, "sector_theme").otherwise("macro_market")


def _looked_up(column: str, mapping: dict[str, list[str]]) -> Column:
    """Symbols that a mapping (part of the configuration) gives for a column's entries."""
    if not mapping:
        return F.array().cast("array<string>")
    table = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(F.col(column), lambda x: F.coalesce(F.try_element_at(table, x), F.array().cast("array<string>"))))


def relevant_symbols(config: Config) -> Column:
    symbols = F.array(*map(F.lit, config.symbols))
    macro = F.array(*map(F.lit, config.macro_symbols)) if config.macro_symbols else F.array().cast("array<string>")
    direct = F.array_intersect(F.col("tickers"), symbols)
    etfs = F.array_intersect(_looked_up("tickers", config.constituent_etf_map), symbols)
    named = F.array_sort(F.array_distinct(F.concat(direct, etfs, _looked_up("themes", config.theme_symbol_map))))
    return F.when((F.size(named) == 0) & (F.size("tickers") == 0), F.array_sort(F.array_distinct(macro))).otherwise(named)


def narrowed(raw: DataFrame, words: DataFrame) -> DataFrame:
    """Raw rows without their texts, from one pass over these.

    no_text, dedupe_key (a SHA-256 of it) and the scores take the place of
    title and summary in ``gated`` and ``normalized``.
    """
    text = tx.scored_text(F.col("title"), F.col("summary"))
    rows = raw.select("*", (blank("title") & blank("summary")).alias("no_text"), F.sha2(dedupe_key(), 256).alias("dedupe_key"), text.alias("_text"))
    return tx.scored(rows.drop("title", "summary"), "_text", words)


def gated(raw: DataFrame, config: Config) -> DataFrame:
    """Raw rows (or narrowed ones) with reason (null: normalized), dedupe_key, relevant_symbols, duplicate_of."""
    empty = F.array().cast("array<string>")
    rows = raw.withColumn("tickers", F.coalesce("tickers", empty)).withColumn("themes", F.coalesce("themes", empty))
    time = F.when(F.col("published_at").isNull(), F.when(blank("published_at_raw"), "missing_published_at").otherwise("unparseable_published_at"))
    narrow = "no_text" in raw.columns
    reason = F.coalesce(time, F.when(F.col("no_text") if narrow else blank("title") & blank("summary"), "missing_title_and_summary"))
    day = F.to_date("published_at")
    outside = F.lit(False)
    if config.dataset_start:
        outside = outside | (day < F.lit(config.dataset_start).cast("date"))
    if config.dataset_end:
        outside = outside | (day > F.lit(config.dataset_end).cast("date"))
    rows = rows.withColumn("reason", F.coalesce(reason, F.when(outside, "outside_dataset_window")))
    rows = rows.withColumn("dedupe_key", F.col("dedupe_key") if narrow else dedupe_key()).withColumn("relevant_symbols", relevant_symbols(config)).withColumn("article_id", article_id())
    # The earliest of equal keys by aggregation and join: a key that very many
    # rows share is combined before the shuffle instead of sorted in one task.
    first = rows.where("reason is null").groupBy("dedupe_key").agg(F.min(F.struct("published_at", "ordinal", "article_id")).alias("first"))
    rows = rows.join(first, "dedupe_key", "left")
    later = F.col("reason").isNull() & (F.col("first.ordinal") != F.col("ordinal"))
    unplaced = F.col("reason").isNull() & (F.size("relevant_symbols") == 0)
    rows = rows.withColumn("duplicate_of", F.when(later, F.col("first.article_id")).otherwise(""))
    return rows.withColumn("reason", F.when(later, "duplicate").when(unplaced, "no_relevant_symbol").otherwise(F.col("reason"))).drop("first")


def disposition() -> Column:
    return F.when(F.col("reason").isin(QUARANTINED), "quarantined").otherwise("excluded")


def set_aside(rows: DataFrame) -> DataFrame:
    """The set-aside part of gated rows."""
    columns = ["vendor_id", "source", "published_at_raw", "title", "url", "disposition", "reason", "duplicate_of"]
    return rows.where("reason is not null").withColumn("disposition", disposition()).select(*columns)


def normalized(rows: DataFrame, config: Config, calendar: DataFrame, words: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The normalized part of gated rows, with availability and sentiment.

    ``texts``: any rows that hold ordinal, title and summary of all of ``rows``
    (the raw ones), so that the gates are not run a second time for the scores.
    Narrowed rows have their scores and no texts.
    """
    rows = rows.where("reason is null").withColumn("scope", scope())
    rows = cal.next_session_time(rows, calendar, "published_at", "available_at", config.price_interval_minutes)
    if "score" not in rows.columns:
        # Copies of an article may share its id; the ordinal is each row's own key.
        texts = rows if texts is None else texts
        scores = tx.score_tokens(texts.select("ordinal", tx.tokens(tx.scored_text(F.col("title"), F.col("summary"))).alias("tokens")), "ordinal", words)
        rows = rows.join(scores.select("ordinal", "score", "hit"), "ordinal")
    return rows.select(
        "article_id", "vendor_id", "source", "source_kind", "published_at", "available_at", *[c for c in ("title", "summary") if c in rows.columns], "url", "tickers", "themes",
        "scope", "relevant_symbols", F.col("score").alias("sentiment_score"), tx.label(F.col("score")).alias("sentiment_label"),
        F.coalesce("vendor_sentiment", F.lit(0.0)).alias("vendor_sentiment"), F.col("vendor_sentiment").isNotNull().alias("vendor_sentiment_available"),
        F.col("hit").alias("lexicon_hit"), "dedupe_key",
    )


def source_catalog(raw: DataFrame) -> DataFrame:
    """source, source_kind: the kind that was seen first."""
    return raw.groupBy("source").agg(F.min_by("source_kind", "ordinal").alias("source_kind"))


def ranked_by_time(rows: DataFrame) -> DataFrame:
    """Chronological order of normalized rows, for sinks."""
    return rows.orderBy("available_at", "article_id")



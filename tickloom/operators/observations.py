"""Bars and news to signal observations without look-ahead.

The news join runs once: articles are exploded to their symbols and meet, on
symbol and day, the bands into which the ends of all windows cut the day; windows
and source sets are made from bands.  Bars look backward (as-of) and forward (horizon)
with windows over one symbol and day, so no pair of bars is enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import calendar as cal
from ..functions import text as tx
from ..functions.identity import iso, of_json

# Source sets by kind, and the size of a tail event.
SOURCE_SETS = [("finance_only", "finance"), ("broad_news", "broad"), ("finance_plus_broad", "finance"), ("finance_plus_broad", "broad")]
TAIL = 0.006


def minutes_before(time: Column, minutes: Column) -> Column:
    return time - F.make_dt_interval(mins=minutes)


def bar_return(open_: str = "open", close: str = "close") -> Column:
    return (F.col(close) - F.col(open_)) / F.col(open_)


def prior_bars(bars: DataFrame, signal: DataFrame) -> DataFrame:
    """signal rows (symbol, signal_time) with prior_return and prior_volatility.

    As-of, backward: bars and signals are sorted together by symbol and month
    and the last bar that has ended is carried forward.  A signal in the first
    bars of a month looks at the month before it through the carried summary.
    """
    month = lambda c: F.date_trunc("MONTH", F.col(c)).cast("timestamp_ntz")
    value = F.struct("end_time", bar_return().alias("r"), (F.col("high") / F.col("low") - 1).alias("v"))
    own = bars.select("symbol", F.col("end_time").alias("at"), F.lit(0).alias("kind"), value.alias("bar"))
    asked = signal.select("symbol", F.col("signal_time").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(own.schema["bar"].dataType).alias("bar")).distinct()
    rows = own.unionByName(asked).withColumn("part", month("at"))
    here = Window.partitionBy("symbol", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("found", F.last("bar", ignorenulls=True).over(here))
    ends = own.groupBy("symbol", month("at").alias("part")).agg(F.max("bar").alias("bar"))
    parts = rows.select("symbol", "part").distinct().join(ends, ["symbol", "part"], "left")
    before = Window.partitionBy("symbol").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.last("bar", ignorenulls=True).over(before)).drop("bar")
    rows = rows.where("kind = 1").join(parts, ["symbol", "part"]).withColumn("found", F.coalesce("found", "before"))
    rows = rows.select("symbol", F.col("at").alias("signal_time"), F.coalesce("found.r", F.lit(0.0)).alias("prior_return"), F.coalesce("found.v", F.lit(0.0)).alias("prior_volatility"))
    return signal.join(rows, ["symbol", "signal_time"])


def forward_horizons(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Session bars with the measurement over each horizon that is covered whole.

    A window over the symbol's day collects nothing but the horizon's own bars.
    Whole: the bars follow one another from the signal's start to its exit.
    """
    out = None
    for minutes in horizons:
        span = minutes * 60
        w = Window.partitionBy("symbol", "day").orderBy("at").rangeBetween(0, span - 1)
        rows = bars.withColumn("day", F.to_date("start_time")).withColumn("at", F.unix_timestamp(F.col("start_time").cast("timestamp")))
        inside = F.filter(F.array_sort(F.collect_list(F.struct("start_time", "end_time", "open", "high", "low", "close", "bar_id")).over(w)), lambda b: b["end_time"] <= F.col("exit_time"))
        rows = rows.withColumn("exit_time", F.col("start_time") + F.make_dt_interval(mins=F.lit(minutes))).withColumn("bars", inside)
        chained = F.forall(F.sequence(F.lit(1), F.size("bars")), lambda i: (i == F.size("bars")) | (F.element_at("bars", i)["end_time"] == F.try_element_at("bars", i + 1)["start_time"]))
        whole = (F.size("bars") > 0) & (F.try_element_at("bars", F.lit(-1))["end_time"] == F.col("exit_time"))
        rows = rows.where(whole).where(chained)
        own = rows.select(
            "symbol", F.col("start_time").alias("signal_time"), F.lit(minutes).alias("measurement_horizon_minutes"), "exit_time",
            F.element_at("bars", 1)["open"].alias("first_open"), F.element_at("bars", -1)["close"].alias("last_close"),
            F.array_max(F.col("bars.high")).alias("high"), F.array_min(F.col("bars.low")).alias("low"), F.col("bars.bar_id").alias("price_bar_ids"),
        )
        out = own if out is None else out.unionByName(own)
    change = (F.col("last_close") - F.col("first_open")) / F.col("first_open")
    return out.select(
        "symbol", "signal_time", "measurement_horizon_minutes", "exit_time", change.alias("future_return"), (F.col("high") / F.col("low") - 1).alias("future_volatility"),
        (F.abs(change) >= TAIL).alias("future_tail_event"), ((F.col("low") - F.col("first_open")) / F.col("first_open")).alias("future_max_drawdown"),
        ((F.col("high") - F.col("first_open")) / F.col("first_open")).alias("future_max_runup"), "price_bar_ids",
    )


def news_matches(articles: DataFrame, signals: DataFrame, longest: int) -> DataFrame:
    """(symbol, signal_time) with each article available in (signal - longest, signal].

    Equi-join on symbol and day: a signal looks at the days its window touches.
    """
    fields = ["article_id", "source", "source_kind", "scope", "sentiment_score", "sentiment_label", "available_at", "published_at"]
    news = articles.select(F.explode(F.array_distinct("relevant_symbols")).alias("symbol"), *fields).withColumn("day", F.to_date("available_at"))
    start = minutes_before(F.col("signal_time"), F.lit(longest))
    days = F.sequence(F.to_date(start), F.to_date("signal_time"), F.expr("INTERVAL 1 DAY"))
    asked = signals.select("symbol", "signal_time").distinct().withColumn("day", F.explode(days))
    rows = asked.join(news, ["symbol", "day"]).drop("day")
    return rows.where((F.col("available_at") <= F.col("signal_time")) & (F.col("available_at") > minutes_before(F.col("signal_time"), F.lit(longest))))


def _summed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Articles of a key in parts that ``_combined`` adds up; sums are decimal."""
    is_scope = lambda s: F.count_if(F.col("scope") == s)
    is_label = lambda s: F.count_if(F.col("sentiment_label") == s)
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("article_count"), is_scope("ticker_specific").alias("ticker_article_count"),
        is_scope("sector_theme").alias("sector_theme_article_count"), is_scope("macro_market").alias("macro_article_count"),
        F.collect_set("source").alias("sources"), tx.exact_sum(F.col("sentiment_score"), whole=True).alias("_sum"), F.count("sentiment_score").alias("_n"),
        F.max(F.struct(F.abs("sentiment_score"), "available_at", "article_id", "sentiment_score")).alias("_extreme"),
        is_label("positive").alias("positive_article_count"), is_label("negative").alias("negative_article_count"),
        F.bool_or(F.col("available_at") != F.col("published_at")).alias("is_after_hours_signal"),
        F.collect_list(F.struct("available_at", "article_id", "sentiment_score")).alias("_items"),
    )


def _combined(parts: DataFrame, source_sets: list[str]) -> DataFrame:
    """Features per signal, window and source set from the parts of these (``_summed``).

    Equal scores have equal means in every order of the rows: thresholds are
    values of other rows, and a tie must not depend on how rows were added up.
    """
    sets = F.array(*[F.struct(F.lit(s).alias("set"), F.lit(k).alias("kind")) for s, k in SOURCE_SETS if s in source_sets])
    rows = parts.withColumn("source_set", F.explode(F.transform(F.filter(sets, lambda x: x["kind"] == F.col("source_kind")), lambda x: x["set"])))
    total = lambda c: F.sum(c).alias(c)
    all_of = lambda c: F.flatten(F.collect_list(c))
    rows = rows.groupBy("symbol", "signal_time", "news_window_minutes", "source_set").agg(
        *map(total, ["article_count", "ticker_article_count", "sector_theme_article_count", "macro_article_count"]),
        F.sort_array(F.array_distinct(all_of("sources"))).alias("sources"), (F.sum("_sum").cast("double") / F.sum("_n")).alias("mean_sentiment"),
        F.max("_extreme").getField("sentiment_score").alias("extreme_sentiment"), total("positive_article_count"), total("negative_article_count"),
        F.bool_or("is_after_hours_signal").alias("is_after_hours_signal"), F.sort_array(all_of("_items")).alias("_items"),
    )
    away = F.aggregate("_items", F.lit(0.0), lambda s, x: s + F.abs(x["sentiment_score"] - F.col("mean_sentiment")))
    rows = rows.withColumn("sentiment_dispersion", away / F.col("article_count")).withColumn("article_ids", F.col("_items.article_id"))
    rows = rows.withColumn("source_count", F.size("sources").cast("long"))
    return rows.withColumn("publisher_count", F.col("source_count")).withColumn("weighted_sentiment", F.col("mean_sentiment")).drop("_items")


def window_features(matches: DataFrame, windows: list[int], source_sets: list[str]) -> DataFrame:
    """Per signal, window and source set: counts, means, dispersion, extremes, ids."""
    spread = F.explode(F.array(*map(F.lit, windows))).alias("news_window_minutes")
    rows = matches.select("*", spread).where(F.col("available_at") > minutes_before(F.col("signal_time"), F.col("news_window_minutes")))
    return _combined(_summed(rows, ["symbol", "signal_time", "news_window_minutes", "source_kind"]), source_sets)


def news_spans(signals: DataFrame, windows: list[int]) -> DataFrame:
    """(symbol, signal_time, news_window_minutes, day) with the part (lower, upper] of the window in that day."""
    rows = signals.select("symbol", "signal_time").distinct().withColumn("news_window_minutes", F.explode(F.array(*map(F.lit, windows))))
    begin = minutes_before(F.col("signal_time"), F.col("news_window_minutes"))
    rows = rows.withColumn("day", F.explode(F.sequence(F.to_date(begin), F.to_date("signal_time"), F.expr("INTERVAL 1 DAY"))))
    first = lambda day: day.cast("timestamp_ntz") - F.expr("INTERVAL 0.000001 SECOND")
    return rows.withColumn("lower", F.greatest(begin, first(F.col("day")))).withColumn("upper", F.least("signal_time", first(F.date_add("day", 1))))


def banded_features(articles: DataFrame, signals: DataFrame, windows: list[int], source_sets: list[str]) -> DataFrame:
    """``window_features`` of ``news_matches``, without a row for each article and window.

    The ends of all windows cut a symbol's day into bands, each wholly inside or
    outside any window.  An article is added up once, in its band; windows are
    made from bands, whose number depends on the signals and not on the articles.
    """
    fields = ["article_id", "source", "source_kind", "scope", "sentiment_score", "sentiment_label", "available_at", "published_at"]
    spans = news_spans(signals, windows)
    ends = spans.groupBy("symbol", "day").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("lower", "upper"))))).alias("ends"))
    news = articles.select(F.explode(F.array_distinct("relevant_symbols")).alias("symbol"), *fields).withColumn("day", F.to_date("available_at"))
    news = news.join(ends, ["symbol", "day"]).withColumn("band", F.expr("get(filter(ends, e -> e >= available_at), 0)")).where("band is not null")
    # Rows are dealt by band first: otherwise each task holds a part of nearly every band.
    band = ["symbol", "day", "band", "source_kind"]
    bands = _summed(news.repartition(*band), band)
    return _combined(spans.join(bands, ["symbol", "day"]).where("band > lower and band <= upper"), source_sets)


def observation_id(dataset_id: str) -> Column:
    text = F.concat(
        F.lit(f'["{dataset_id}","'), "symbol", F.lit('","'), iso(F.col("signal_time")), F.lit('",'), F.col("news_window_minutes").cast("string"),
        F.lit(","), F.col("measurement_horizon_minutes").cast("string"), F.lit(',"'), "source_set", F.lit('",'), F.to_json("article_ids"), F.lit("]"),
    )
    return of_json("sig", text)


def build_observations(config: Config, dataset_id: str, articles: DataFrame, bars: DataFrame, calendar: DataFrame, run_id: str | None = None) -> DataFrame:
    session = cal.in_session(bars, calendar, "start_time").where(F.col("symbol").isin(config.symbols))
    future = forward_horizons(session, config.measurement_horizons_minutes)
    signals = session.select("symbol", F.col("start_time").alias("signal_time"))
    features = banded_features(articles, signals, config.news_windows_minutes, config.source_sets)
    # The bars before are looked up for session bars, not for features: these are built once.
    rows = features.join(future, ["symbol", "signal_time"]).join(prior_bars(bars, signals.distinct()), ["symbol", "signal_time"])
    return rows.select(
        observation_id(dataset_id).alias("observation_id"), F.lit(dataset_id).alias("dataset_id"), "*", F.lit(config.price_interval_minutes).alias("price_interval_minutes"),
        F.lit("regular").alias("market_session"), F.col("signal_time").alias("entry_time"), F.lit(run_id or config.run_id).alias("created_by_run_id"),
    )


def coverage(observations: DataFrame) -> DataFrame:
    keys = ["news_window_minutes", "measurement_horizon_minutes", "source_set", "symbol"]
    return observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("observation_count"), F.sum("article_count").alias("article_count"))

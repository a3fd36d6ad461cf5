"""The decision gates, in order, as one expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, Thresholds
from . import stats
from .backtest import strategy_comparison
from .stats import KEY


def decide(rows: DataFrame, limits: Thresholds) -> DataFrame:
    """Adds recommendation and reason; the first gate that fails decides."""
    c, text = F.col, F.format_string
    margin = c("observed_top_minus_bottom") - c("shuffled_p95")
    low = lambda name, least: text(f"{name} %.3f is below min {least:.3f}", c(name))
    gates = [
        (c("quarantine_rate") > limits.max_quarantine_rate, "stop", text(f"quarantine_rate %.3f exceeds max {limits.max_quarantine_rate:.3f}", c("quarantine_rate"))),
        (c("degenerate"), "expand sources", F.lit("sentiment scores are too tied to separate a top from a bottom")),
        (c("lexicon_hit_rate") < limits.min_lexicon_hit_rate, "expand sources", low("lexicon_hit_rate", limits.min_lexicon_hit_rate)),
        (c("source_set_coverage") < limits.min_source_coverage, "expand sources", low("source_set_coverage", limits.min_source_coverage)),
        (c("articles_per_signal") < limits.min_articles_per_signal, "expand data", low("articles_per_signal", limits.min_articles_per_signal)),
        (c("judged_count") < limits.min_observations, "expand data", text(f"only %d observations, fewer than the {limits.min_observations} needed", c("judged_count"))),
        (
            (margin <= limits.min_spread_margin) | (c("observed_top_minus_bottom") <= limits.min_spread_margin),
            "revise",
            text("observed spread %.8f is not above the null's 95th percentile %.8f by the margin (%.8f)", c("observed_top_minus_bottom"), c("shuffled_p95"), margin),
        ),
        (
            c("sentiment_net_return") <= c("best_baseline_net_return"),
            "revise",
            text("sentiment net return %.6f does not beat %s at %.6f", c("sentiment_net_return"), c("best_baseline_name"), c("best_baseline_net_return")),
        ),
    ]
    word, reason = F.lit("continue"), text("observed spread %.8f beats the null and sentiment net %.6f beats %s", c("observed_top_minus_bottom"), c("sentiment_net_return"), c("best_baseline_name"))
    for failed, name, why in reversed(gates):
        word, reason = F.when(failed, name).otherwise(word), F.when(failed, why).otherwise(reason)
    return rows.withColumn("recommendation", word).withColumn("reason", reason)


def expected_sources(catalog: DataFrame) -> DataFrame:
    """source_set, expected: how many catalogued sources a set may draw on."""
    finance, broad = F.count_if(F.col("source_kind") == "finance"), F.count_if(F.col("source_kind") == "broad")
    sets = {"finance_only": finance, "broad_news": broad, "finance_plus_broad": finance + broad}
    counted = catalog.agg(F.array(*[F.struct(F.lit(k).alias("source_set"), v.alias("expected")) for k, v in sets.items()]).alias("sets"))
    return counted.select(F.inline("sets"))


def source_coverage(observations: DataFrame, articles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct contributing sources over expected ones, at most 1."""
    if "sources" in observations.columns:
        used = observations.select(*KEY, F.explode("sources").alias("source"))
    else:  # observation sets that were stored without their sources
        used = observations.select(*KEY, F.explode("article_ids").alias("article_id")).distinct()
        used = used.join(articles.select("article_id", "source").distinct(), "article_id")
    used = used.groupBy(*KEY).agg(F.count_distinct("source").alias("_n"))
    rows = observations.select(*KEY).distinct().join(used, KEY, "left").join(expected_sources(catalog), "source_set", "left")
    share = F.coalesce("_n", F.lit(0)) / F.greatest(F.coalesce("expected", F.lit(0)), F.lit(1))
    return rows.select(*KEY, F.least(share, F.lit(1.0)).alias("source_set_coverage"))


def quality(gated: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: quarantine_rate over raw rows, lexicon_hit_rate over normalized ones."""
    from .normalize import QUARANTINED

    bad = gated.agg(F.coalesce(F.avg(F.coalesce(F.col("reason").isin(QUARANTINED), F.lit(False)).cast("double")), F.lit(0.0)).alias("quarantine_rate"))
    hit = articles.agg(F.coalesce(F.avg(F.col("lexicon_hit").cast("double")), F.lit(0.0)).alias("lexicon_hit_rate"))
    return bad.join(F.broadcast(hit))  # two rows of one


def vendor_agreement(articles: DataFrame) -> DataFrame:
    """Spearman of our scores with the vendor's, where there are any."""
    rows = articles.where("vendor_sentiment_available").withColumn("all", F.lit(1))
    return stats.spearman(rows, "sentiment_score", "vendor_sentiment", ["all"]).select(F.col("spearman").alias("vendor_agreement"))


def analyze(observations: DataFrame, results: DataFrame, gated: DataFrame, articles: DataFrame, catalog: DataFrame, config: Config) -> DataFrame:
    """A decision row for each configuration."""
    judged = stats.judged(observations, config.development_fraction)
    group = observations.groupBy(*KEY).agg(F.count(F.lit(1)).alias("observation_count"), F.avg("article_count").alias("articles_per_signal"))
    whole = stats.degeneracy(observations, "mean_sentiment", KEY, config.long_quantile, config.short_quantile, config.max_modal_share)
    rows = group.join(stats.top_minus_bottom(judged), KEY).join(stats.permutation_null(judged, config.seed), KEY)
    rows = rows.join(stats.pearson(observations, "mean_sentiment", "future_return"), KEY).join(whole.select(*KEY, "degenerate"), KEY)
    rows = rows.join(source_coverage(observations, articles, catalog), KEY).join(strategy_comparison(results), KEY, "left")
    rows = rows.fillna(0.0, ["sentiment_net_return"]).fillna(float("-inf"), ["best_baseline_net_return"]).fillna("none", ["best_baseline_name"])
    rows = rows.join(F.broadcast(quality(gated, articles)))  # one row
    return decide(rows, config.verdict_thresholds)

"""Backtests of all configurations, strategies and splits as one plan.

Thresholds come from development rows and are frozen for the holdout.  One slot
a symbol: rows in a position's time are skipped, and only taken trades hold the
slot.  That recurrence is a fold over the sorted rows of one (configuration,
strategy, split, symbol, day); a slot that runs on overnight is chained by a
fold over the group's rows, whose number is bounded by a symbol's bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .stats import KEY, degeneracy, split, uniform

# Strategies in the order that breaks ties.
STRATEGIES = ["sentiment", "always_flat", "random", "prior_return_momentum", "shuffled_sentiment"]
SPLITS = ["development", "holdout"]
GROUP = [*KEY, "strategy", "split"]


def signals(observations: DataFrame, seed: int, fraction: float) -> DataFrame:
    """Split observations with one row and signal for each trading strategy."""
    rows = split(observations, fraction)
    w = Window.partitionBy(*KEY)
    rows = rows.withColumn("p", F.row_number().over(w.orderBy("signal_time", "observation_id")))
    draw = uniform(F.lit(f"{seed}-shuffled"), F.col("observation_id"))
    dealt = rows.select(*KEY, F.row_number().over(w.orderBy(draw, "observation_id")).alias("p"), F.col("mean_sentiment").alias("dealt"))
    rows = rows.join(dealt, [*KEY, "p"]).withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in STRATEGIES if s != "always_flat"])))
    value = (
        F.when(F.col("strategy") == "sentiment", F.col("mean_sentiment"))
        .when(F.col("strategy") == "random", uniform(seed, F.col("observation_id")) * 2 - 1)
        .when(F.col("strategy") == "prior_return_momentum", F.col("prior_return"))
        .otherwise(F.col("dealt"))
    )
    return rows.withColumn("signal", value).drop("p", "dealt")


def thresholds(rows: DataFrame, config: Config) -> DataFrame:
    """Per configuration and strategy, from development rows only."""
    development = rows.where("split = 'development'")
    return degeneracy(development, "signal", [*KEY, "strategy"], config.long_quantile, config.short_quantile, config.max_modal_share)


def trades(rows: DataFrame, limits: DataFrame, cost_bps: float, run_id: str) -> DataFrame:
    """The trades that are taken."""
    rows = rows.join(limits, [*KEY, "strategy"]).where("not degenerate")
    side = F.when(F.col("signal") >= F.col("long_threshold"), "long").when(F.col("signal") <= F.col("short_threshold"), "short")
    rows = rows.withColumn("side", side).where("side is not null")
    gross = F.when(F.col("side") == "long", F.col("future_return")).otherwise(-F.col("future_return"))
    rows = rows.withColumn("gross_return", gross)
    item = F.struct("entry_time", "observation_id", "exit_time", "signal_time", "side", "signal", "gross_return")
    packed = rows.groupBy(*GROUP, "symbol").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = packed.schema["items"].dataType.simpleString()
    taken = F.expr(f"""
        aggregate(items, named_struct('free', cast(null as timestamp_ntz), 'out', cast(array() as {kind})),
          (s, x) -> CASE WHEN s.free IS NOT NULL AND x.entry_time < s.free THEN s
            ELSE named_struct('free', x.exit_time, 'out', concat(s.out, array(x))) END,
          s -> s.out)""")
    out = packed.select(*GROUP, "symbol", F.inline(taken))
    return out.select(
        F.lit(run_id).alias("run_id"), *GROUP, "symbol", "observation_id", "side", "signal_time", "entry_time", "exit_time", F.col("signal").alias("sentiment"),
        "gross_return", F.lit(float(cost_bps)).alias("cost_bps"), (F.col("gross_return") - cost_bps / 10_000).alias("net_return"),
    )


def equity(taken: DataFrame) -> DataFrame:
    """Trades in order of (entry_time, symbol) with running equity and drawdown."""
    w = Window.partitionBy(*GROUP).orderBy("entry_time", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    rows = taken.withColumn("equity", F.sum("net_return").over(w))
    peak = F.greatest(F.lit(0.0), F.max("equity").over(w))
    return rows.withColumn("drawdown", F.col("equity") - peak)


def _mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(0.0)


def metrics(observations: DataFrame, taken: DataFrame, limits: DataFrame, cost_bps: float, run_id: str) -> DataFrame:
    """A row for every configuration, strategy and split, traded or not."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    is_ = {s: F.col("side") == s for s in ("long", "short")}
    sums = [
        F.count(F.lit(1)).alias("trade_count"), zero(F.sum("gross_return")).alias("gross_return"), zero(F.sum("net_return")).alias("net_return"),
        F.count_if(F.col("net_return") > 0).alias("wins"), zero(F.sum(F.when(F.col("net_return") > 0, F.col("net_return")))).alias("gains"),
        zero(F.sum(F.when(F.col("net_return") < 0, -F.col("net_return")))).alias("losses"), zero(F.min("drawdown")).alias("max_drawdown"),
    ]
    for s, cond in is_.items():
        own = F.when(cond, F.col("net_return"))
        sums += [F.count_if(cond).alias(f"{s}_count"), zero(F.sum(own)).alias(f"{s}_net_return"), F.count_if(cond & (F.col("net_return") > 0)).alias(f"_{s}_wins")]
    done = equity(taken).groupBy(*GROUP).agg(*sums)
    dense = observations.select(*KEY).distinct()
    dense = dense.withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES)))).withColumn("split", F.explode(F.array(*map(F.lit, SPLITS))))
    rows = dense.join(done, GROUP, "left").join(limits.select(*KEY, "strategy", "degenerate"), [*KEY, "strategy"], "left")
    counts = ["trade_count", "wins", "long_count", "short_count", "_long_wins", "_short_wins"]
    rows = rows.fillna(0, counts).fillna(0.0, ["gross_return", "net_return", "gains", "losses", "max_drawdown", "long_net_return", "short_net_return"])
    rows = rows.fillna(False, ["degenerate"])
    factor = F.when(F.col("losses") > 0, F.try_divide(F.col("gains"), F.col("losses"))).otherwise(F.col("gains"))
    return rows.select(
        F.lit(run_id).alias("run_id"), *GROUP, F.lit(float(cost_bps)).alias("cost_bps"), "trade_count", "long_count", "short_count", "gross_return", "net_return",
        _mean(F.col("net_return"), F.col("trade_count")).alias("average_net_return"), _mean(F.col("wins"), F.col("trade_count")).alias("win_rate"),
        factor.alias("profit_factor"), "max_drawdown", "long_net_return", "short_net_return",
        _mean(F.col("long_net_return"), F.col("long_count")).alias("long_average_net_return"), _mean(F.col("short_net_return"), F.col("short_count")).alias("short_average_net_return"),
        _mean(F.col("_long_wins"), F.col("long_count")).alias("long_win_rate"), _mean(F.col("_short_wins"), F.col("short_count")).alias("short_win_rate"), "degenerate",
    )


def backtest(observations: DataFrame, config: Config, cost_bps: float, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, trades) of all configurations."""
    rows = signals(observations, config.seed, config.development_fraction)
    limits = thresholds(rows, config)
    run_id = run_id or config.run_id
    taken = trades(rows, limits, cost_bps, run_id)
    return metrics(observations, taken, limits, cost_bps, run_id), taken


def strategy_comparison(results: DataFrame) -> DataFrame:
    """On the holdout: sentiment's net return and the best baseline (ties: the earlier strategy)."""
    order = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    base = F.col("strategy") != "sentiment"
    best = F.max_by(F.when(base, F.col("strategy")), F.when(base, F.struct("net_return", (-order).alias("o"))))
    return results.where("split = 'holdout'").groupBy(*KEY).agg(
        F.max(F.when(~base, F.col("net_return"))).alias("sentiment_net_return"), F.max(F.when(base, F.col("net_return"))).alias("best_baseline_net_return"), best.alias("best_baseline_name")
    )

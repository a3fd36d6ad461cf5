"""Correlation, ranks, nearest-rank quantiles, spreads and the permutation null.

All statistics are by configuration (news window, horizon, source set).  Ranks
come from windows over one configuration; the null re-pairs positions by a hash
order, so its 200 permutations are one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["news_window_minutes", "measurement_horizon_minutes", "source_set"]
# Permutations, the quantile of the null, buckets.
PERMUTATIONS, NULL_QUANTILE = 200, 0.95
BUCKETS = ["low", "middle", "high"]


def uniform(seed: int | Column, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    digits = F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def nearest_rank(values: Column, q: float) -> Column:
    """sorted[round((n - 1) q)] of the grouped values; 0 when there are none."""
    ordered = F.sort_array(F.collect_list(values))
    at = F.round((F.size(ordered) - 1) * F.lit(q)).cast("int") + 1
    return F.when(F.count(values) == 0, 0.0).otherwise(F.try_element_at(ordered, F.greatest(at, F.lit(1))))


def pearson(rows: DataFrame, x: str, y: str, keys: list[str] = KEY) -> DataFrame:
    """Population correlation; 0 when either variance is 0."""
    both = F.stddev_pop(x) * F.stddev_pop(y)
    return rows.groupBy(*keys).agg(F.when(F.coalesce(both, F.lit(0.0)) > 0, F.try_divide(F.covar_pop(x, y), both)).otherwise(0.0).alias("pearson_correlation"))


def average_rank(column: str, keys: list[str]) -> Column:
    """Mean rank over ties."""
    by = [F.col(k) for k in keys]
    ahead = F.rank().over(Window.partitionBy(*by).orderBy(column))
    return ahead + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Correlation of average ranks; 0 with fewer than three rows or without variance."""
    ranked = rows.select(*keys, average_rank(x, keys).alias("_rx"), average_rank(y, keys).alias("_ry"))
    both = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    value = F.when((F.count(F.lit(1)) >= 3) & (both > 0), F.try_divide(F.covar_pop("_rx", "_ry"), both)).otherwise(0.0)
    return ranked.groupBy(*keys).agg(value.alias("spearman"))


def position(*extra: str) -> Column:
    order = [F.col("mean_sentiment"), F.col("signal_time"), F.col("observation_id")]
    return F.row_number().over(Window.partitionBy(*KEY, *extra).orderBy(*order))


def bucket_returns(observations: DataFrame, buckets: int = 3) -> DataFrame:
    """Floor-thirds by sentiment; a group of fewer rows than buckets overlaps."""
    rows = observations.withColumn("at", position() - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    low = F.floor(F.col("i") * F.col("n") / buckets)
    high = F.least(F.col("n"), F.greatest(F.floor((F.col("i") + 1) * F.col("n") / buckets), low + 1))
    rows = rows.where((F.col("at") >= low) & (F.col("at") < high))
    name = F.element_at(F.array(*map(F.lit, BUCKETS)), F.col("i") + 1) if buckets == len(BUCKETS) else F.col("i").cast("string")
    return rows.groupBy(*KEY, name.alias("bucket")).agg(
        F.count(F.lit(1)).alias("observation_count"), F.avg("mean_sentiment").alias("mean_sentiment"), F.avg("future_return").alias("mean_future_return")
    )


def split(observations: DataFrame, fraction: float) -> DataFrame:
    """split: the first round(n * fraction) rows in time are development."""
    w = Window.partitionBy(*KEY)
    at = F.row_number().over(w.orderBy("signal_time", "observation_id"))
    cut = F.round(F.count(F.lit(1)).over(w) * F.lit(fraction))
    return observations.withColumn("split", F.when(at <= cut, "development").otherwise("holdout"))


def judged(observations: DataFrame, fraction: float) -> DataFrame:
    """The holdout, or the whole group where the holdout has fewer than three rows."""
    rows = split(observations, fraction)
    held = F.sum((F.col("split") == "holdout").cast("int")).over(Window.partitionBy(*KEY))
    return rows.withColumn("_held", held).where((F.col("_held") < 3) | (F.col("split") == "holdout")).drop("_held")


def _spread(at: str, n: str, value: str) -> Column:
    size = F.greatest(F.floor(F.col(n) / 3), F.lit(1))
    top = F.avg(F.when(F.col(at) > F.col(n) - size, F.col(value)))
    return top - F.avg(F.when(F.col(at) <= size, F.col(value)))


def top_minus_bottom(rows: DataFrame) -> DataFrame:
    """Mean return of the highest third by sentiment less that of the lowest."""
    own = rows.select(*KEY, "future_return", position().alias("at"), F.count(F.lit(1)).over(Window.partitionBy(*KEY)).alias("n"))
    return own.groupBy(*KEY).agg(_spread("at", "n", "future_return").alias("observed_top_minus_bottom"), F.first("n").alias("judged_count"))


def permutation_null(rows: DataFrame, seed: int, permutations: int = PERMUTATIONS) -> DataFrame:
    """Mean and 95th percentile of the spread when scores are dealt anew.

    Position p takes the score of the row whose hash rank is p, then positions
    are ordered by (score, position): a re-pairing, ties included.
    """
    time = [F.col("signal_time"), F.col("observation_id")]
    own = rows.select(*KEY, "observation_id", "mean_sentiment", "future_return", F.row_number().over(Window.partitionBy(*KEY).orderBy(*time)).alias("p"))
    own = own.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    part = [*KEY, "permutation"]
    draw = uniform(F.concat(F.lit(f"{seed}-"), F.col("permutation").cast("string")), F.col("observation_id"))
    dealt = own.withColumn("q", F.row_number().over(Window.partitionBy(*part).orderBy(draw, "observation_id")))
    dealt = dealt.select(*part, F.col("q").alias("p"), F.col("mean_sentiment").alias("score"))
    pairs = own.select(*part, "p", "future_return").join(dealt, [*part, "p"])
    w = Window.partitionBy(*part)
    pairs = pairs.withColumn("at", F.row_number().over(w.orderBy("score", "p"))).withColumn("n", F.count(F.lit(1)).over(w))
    spreads = pairs.groupBy(*part).agg(_spread("at", "n", "future_return").alias("spread"), F.first("n").alias("n"))
    at = min(int(permutations * NULL_QUANTILE), permutations - 1)
    few = F.first("n") < 3
    return spreads.groupBy(*KEY).agg(
        F.when(few, 0.0).otherwise(F.avg("spread")).alias("shuffled_top_minus_bottom"),
        F.when(few, 0.0).otherwise(F.element_at(F.sort_array(F.collect_list("spread")), at + 1)).alias("shuffled_p95"),
    )


def fixed(x: Column) -> Column:
    """Nine decimals as text; a negative zero is zero."""
    return F.format_string("%.9f", F.when(F.round(x, 9) == 0, F.lit(0.0)).otherwise(x))


def modal_share(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Share of the most frequent value at nine decimals."""
    counts = rows.groupBy(*keys, fixed(F.col(column)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("modal_share"))


def degeneracy(rows: DataFrame, column: str, keys: list[str], long_q: float, short_q: float, most: float) -> DataFrame:
    """keys, long_threshold, short_threshold, modal_share, degenerate."""
    cut = rows.groupBy(*keys).agg(nearest_rank(F.col(column), long_q).alias("long_threshold"), nearest_rank(F.col(column), short_q).alias("short_threshold"))
    rows = cut.join(modal_share(rows, column, keys), keys)
    return rows.withColumn("degenerate", (F.col("long_threshold") <= F.col("short_threshold")) | (F.col("modal_share") > most))

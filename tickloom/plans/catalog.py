"""Registered queries of the research engine and their DuckDB twins.

Every query runs over the whole driver tables.  Times leave as text and real
numbers are rounded, so both engines show the same values.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as tx
from ..functions.identity import iso
from ..operators import audit, backtest, normalize, observations, stats, verdict
from ..operators.stats import KEY
from ..sources import driver_tables as dt

CFG = dt.CONFIG


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _num(c: str, digits: int = 7) -> Column:
    x = F.round(F.col(c), digits)
    return F.when(x == 0, F.lit(0.0)).otherwise(x).alias(c)


#: Columns of articles that queries read; texts are not among them.
_NARROW = ["article_id", "vendor_id", "source", "source_kind", "published_at", "available_at", "scope", "relevant_symbols", "sentiment_score", "sentiment_label", "vendor_sentiment", "vendor_sentiment_available", "lexicon_hit"]


#: Partitions of kept relations whose rows the calendar bounds, and that many stages read.
_FEW = 12
#: Columns of observations that grow with the articles; statistics read none of them.
_WIDE = ["article_ids", "price_bar_ids"]


def _kept(rows: DataFrame) -> DataFrame:
    """Persisted and filled by a job of its own.

    Stages that read a cache side by side while it is filled would each compute
    the partitions that other executors still work on.
    """
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    return rows


class Relations:
    """The engine's relations of one session and directory.

    Bars, articles without their texts and observations are kept: many operators
    read them, and each would scan events and score all texts again.  Texts are
    read once, for rows that hold scores in their place; ``narrow``: these gated.
    ``signals``: the observations without their lists of identifiers.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = dt.raw_articles(spark, sf_dir)
        self.calendar = dt.calendar(spark)
        self.words = dt.lexicon(spark)
        self.gated = normalize.gated(self.raw, CFG)

    @cached_property
    def bars(self) -> DataFrame:
        return _kept(dt.price_bars(self.spark, self.sf_dir).coalesce(_FEW))

    @cached_property
    def narrow(self) -> DataFrame:
        # Kept before the gates, which read their rows twice, and after them for the queries.
        scored = _kept(normalize.narrowed(dt.articles_alone(self.spark, self.sf_dir), self.words))
        rows = _kept(normalize.gated(dt.with_labels(scored, self.spark, self.sf_dir), CFG))
        scored.unpersist()
        return rows

    @cached_property
    def articles(self) -> DataFrame:
        return _kept(normalize.normalized(self.narrow, CFG, self.calendar, self.words).select(*_NARROW))

    @cached_property
    def observations(self) -> DataFrame:
        return _kept(observations.build_observations(CFG, dt.DATASET, self.articles, self.bars, self.calendar))

    @cached_property
    def signals(self) -> DataFrame:
        return _kept(self.observations.drop(*_WIDE).coalesce(_FEW))


@lru_cache(maxsize=4)
def _relations(app: str, sf_dir: str) -> Relations:
    return Relations(SparkSession.active(), sf_dir)


def relations(spark: SparkSession, sf_dir: str) -> Relations:
    return _relations(spark.sparkContext.applicationId, sf_dir)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of the relations under its name, with its twin."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(relations(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def _values(rows: list[str]) -> str:
    return ", ".join(rows)


# DuckDB twins of the relations -------------------------------------------------

_BARS = """
bars AS (
  SELECT 'S' || (user_id % 4) AS symbol, date_trunc('hour', ts) AS start_time, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_time,
         arg_min(value + 100, row(ts, event_id)) AS open, max(value + 100) AS high, min(value + 100) AS low,
         arg_max(value + 100, row(ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY ALL
)"""
_CAL = f"""
cal AS (
  SELECT d AS session_date, timezone('UTC', timezone('America/New_York', d + INTERVAL '9 hours 30 minutes')) AS open_time,
         timezone('UTC', timezone('America/New_York', d + CASE WHEN d = DATE '2024-01-12' THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END)) AS close_time
  FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{dt.FIRST}', TIMESTAMP '{dt.LAST}', INTERVAL 1 DAY)) AS DATE) AS d)
  WHERE isodow(d) < 6 AND d NOT IN ({_values([f"DATE '{h}'" for h in dt.HOLIDAYS])})
)"""
_RAW = """
known AS (
  SELECT doc_id, min(CASE WHEN toxic = 1 THEN -1.0 WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS vs FROM labels GROUP BY doc_id
), raw AS (
  SELECT d.doc_id AS ordinal, CAST(d.doc_id AS VARCHAR) AS vendor_id, source,
         CASE WHEN CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 2 = 0 THEN 'finance' ELSE 'broad' END AS source_kind,
         CASE WHEN d.doc_id % 97 <> 0 AND d.doc_id % 89 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id * 26699 % 43200 AS INTEGER)) END AS published_at,
         CASE WHEN d.doc_id % 97 = 0 THEN '' WHEN d.doc_id % 89 = 0 THEN 'some day'
              ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id * 26699 % 43200 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS published_at_raw,
         CASE WHEN d.doc_id % 101 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title,
         CASE WHEN d.doc_id % 101 = 0 THEN ' ' ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS summary,
         'doc://' || md5(text) AS url,
         CASE WHEN d.doc_id % 5 = 0 THEN CAST([] AS VARCHAR[]) WHEN d.doc_id % 53 = 0 THEN ['ELSE'] ELSE ['S' || (d.doc_id % 4)] END AS tickers,
         CASE WHEN d.doc_id % 10 = 0 THEN ['rates'] ELSE CAST([] AS VARCHAR[]) END AS themes, known.vs AS vendor_sentiment
  FROM documents d LEFT JOIN known ON known.doc_id = d.doc_id
)"""
_GATED = _RAW + """, keyed AS (
  SELECT *, lower(trim(url)) || '::' || lower(trim(title)) AS dedupe_key,
         'art_' || substr(sha256('["' || source || '","' || url || '","' || strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') || '"]'), 1, 16) AS article_id,
         CASE WHEN published_at IS NULL AND trim(published_at_raw) = '' THEN 'missing_published_at' WHEN published_at IS NULL THEN 'unparseable_published_at'
              WHEN regexp_matches(title, '^\\s*$') AND regexp_matches(summary, '^\\s*$') THEN 'missing_title_and_summary'
              WHEN CAST(published_at AS DATE) < DATE '2024-01-02' OR CAST(published_at AS DATE) > DATE '2024-01-29' THEN 'outside_dataset_window' END AS gate,
         list_sort(list_distinct(list_concat(list_filter(tickers, lambda x: x IN ('S0', 'S1', 'S2', 'S3')),
           CASE WHEN list_contains(tickers, 'S2') THEN ['S0'] ELSE CAST([] AS VARCHAR[]) END,
           CASE WHEN list_contains(themes, 'rates') THEN ['S1', 'S3'] ELSE CAST([] AS VARCHAR[]) END))) AS named
  FROM raw
), ranked AS (
  SELECT *, first_value(article_id) OVER w AS first_id, first_value(ordinal) OVER w AS first_ordinal
  FROM keyed WHERE gate IS NULL WINDOW w AS (PARTITION BY dedupe_key ORDER BY published_at, ordinal)
), gated AS (
  SELECT k.*, CASE WHEN len(k.named) = 0 AND len(k.tickers) = 0 THEN ['S0', 'S1'] ELSE k.named END AS relevant_symbols,
         CASE WHEN r.first_ordinal <> k.ordinal THEN r.first_id ELSE '' END AS duplicate_of,
         CASE WHEN k.gate IS NOT NULL THEN k.gate WHEN r.first_ordinal <> k.ordinal THEN 'duplicate'
              WHEN len(k.named) = 0 AND len(k.tickers) > 0 THEN 'no_relevant_symbol' END AS reason
  FROM keyed k LEFT JOIN ranked r ON r.ordinal = k.ordinal
)"""
_LEX = f"""
lex(word, tone, valence) AS (VALUES {_values([f"('{w}', 1, NULL)" for w in dt.GOOD] + [f"('{w}', -1, NULL)" for w in dt.BAD] + [f"('{w}', NULL, CAST({v} AS DOUBLE))" for w, v in dt.VALENCE])})"""
_NEG = _values([f"'{w}'" for w in tx.NEGATORS])
_SCORES = _LEX + """, toks AS (
  SELECT ordinal, list_filter(regexp_split_to_array(lower(title || ' ' || summary), '[^a-z'']+'), lambda x: x <> '') AS t FROM gated WHERE reason IS NULL
), each AS (
  SELECT ordinal, t[i] AS word, i > 1 AND t[i - 1] IN (""" + _NEG + """) AS negated
  FROM (SELECT ordinal, t, unnest(range(1, len(t) + 1)) AS i FROM toks)
), sums AS (
  SELECT e.ordinal, coalesce(sum(tone), 0) AS tn, coalesce(sum(valence * CASE WHEN negated THEN -0.74 ELSE 1.0 END), 0.0) AS vl,
         bool_or(tone IS NOT NULL OR valence IS NOT NULL) AS hit
  FROM each e LEFT JOIN lex USING (word) GROUP BY e.ordinal
), scores AS (
  SELECT t.ordinal, len(t.t) AS n_tokens, coalesce(hit, false) AS hit,
         CASE WHEN len(t.t) > 0 THEN coalesce(tn, 0) / sqrt(len(t.t)) ELSE 0.0 END AS tone,
         coalesce(vl / sqrt(vl * vl + 15.0), 0.0) AS valence
  FROM toks t LEFT JOIN sums s ON s.ordinal = t.ordinal
)"""
_ARTICLES = _GATED + ", " + _CAL + ", " + _SCORES + """, articles AS (
  SELECT g.*, s.hit AS lexicon_hit, greatest(-1.0, least(1.0, 0.5 * s.tone + 0.5 * s.valence)) AS sentiment_score,
         (SELECT greatest(min(c.open_time), g.published_at) FROM cal c WHERE c.close_time > g.published_at) AS available_at,
         CASE WHEN len(tickers) > 0 THEN 'ticker_specific' WHEN len(themes) > 0 THEN 'sector_theme' ELSE 'macro_market' END AS scope
  FROM gated g JOIN scores s ON s.ordinal = g.ordinal WHERE g.reason IS NULL
), labelled AS (
  SELECT *, CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM articles
)"""
_SESSION = """
session AS (
  SELECT bars.* FROM bars JOIN cal ON cal.session_date = CAST(start_time AS DATE) AND start_time >= open_time AND start_time < close_time
)"""
_FUTURE = """
future AS (
  SELECT s.symbol, s.start_time AS signal_time, h.h AS measurement_horizon_minutes, s.start_time + to_minutes(CAST(h.h AS INTEGER)) AS exit_time,
         arg_min(f.open, f.start_time) AS fo, arg_max(f.close, f.start_time) AS fc, max(f.high) AS fh, min(f.low) AS fl, count(*) AS n_bars
  FROM session s, (VALUES (60), (120)) h(h)
  JOIN session f ON f.symbol = s.symbol AND f.start_time >= s.start_time AND f.end_time <= s.start_time + to_minutes(CAST(h.h AS INTEGER))
  GROUP BY ALL HAVING count(*) = h.h // 60
)"""
_OBS = _ARTICLES + ", " + _BARS + ", " + _SESSION + ", " + _FUTURE + """, sets(source_set, kind) AS (
  VALUES ('finance_only', 'finance'), ('broad_news', 'broad'), ('finance_plus_broad', 'finance'), ('finance_plus_broad', 'broad')
), news AS (
  SELECT *, unnest(relevant_symbols) AS symbol FROM labelled
), feats AS (
  SELECT s.symbol, s.start_time AS signal_time, w.w AS news_window_minutes, x.source_set, count(*) AS article_count,
         count(*) FILTER (scope = 'ticker_specific') AS ticker_article_count, count(*) FILTER (scope = 'sector_theme') AS sector_theme_article_count,
         count(*) FILTER (scope = 'macro_market') AS macro_article_count, count(DISTINCT source) AS source_count, avg(sentiment_score) AS mean_sentiment,
         arg_max(sentiment_score, row(abs(sentiment_score), available_at, article_id)) AS extreme_sentiment,
         count(*) FILTER (sentiment_label = 'positive') AS positive_article_count, count(*) FILTER (sentiment_label = 'negative') AS negative_article_count,
         bool_or(available_at <> published_at) AS is_after_hours_signal,
         list(sentiment_score) AS all_scores, list(article_id ORDER BY available_at, article_id) AS article_ids
  FROM session s, (VALUES (60), (240)) w(w)
  JOIN news n ON n.symbol = s.symbol AND n.available_at <= s.start_time AND n.available_at > s.start_time - to_minutes(CAST(w.w AS INTEGER))
  JOIN sets x ON x.kind = n.source_kind
  GROUP BY ALL
), joined AS (
  SELECT f.*, u.measurement_horizon_minutes, u.exit_time, (fc - fo) / fo AS future_return, fh / fl - 1 AS future_volatility,
         abs((fc - fo) / fo) >= 0.006 AS future_tail_event, (fl - fo) / fo AS future_max_drawdown, (fh - fo) / fo AS future_max_runup,
         list_avg(list_transform(all_scores, lambda x: abs(x - mean_sentiment))) AS sentiment_dispersion
  FROM feats f JOIN future u ON u.symbol = f.symbol AND u.signal_time = f.signal_time
), obs AS (
  SELECT j.*, coalesce((b.close - b.open) / b.open, 0.0) AS prior_return, coalesce(b.high / b.low - 1, 0.0) AS prior_volatility, j.signal_time AS entry_time,
         'sig_' || substr(sha256('["ds_driver","' || j.symbol || '","' || strftime(j.signal_time, '%Y-%m-%dT%H:%M:%SZ') || '",' || news_window_minutes || ',' ||
           measurement_horizon_minutes || ',"' || source_set || '",' || '["' || array_to_string(article_ids, '","') || '"]]'), 1, 16) AS observation_id
  FROM joined j ASOF LEFT JOIN bars b ON b.symbol = j.symbol AND j.signal_time >= b.end_time
)"""
_K = "news_window_minutes, measurement_horizon_minutes, source_set"
_SPLIT = _OBS + f""", sp AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY {_K} ORDER BY signal_time, observation_id) <= round(count(*) OVER (PARTITION BY {_K}) * 0.5)
         THEN 'development' ELSE 'holdout' END AS split, row_number() OVER (PARTITION BY {_K} ORDER BY signal_time, observation_id) AS p FROM obs
), judged AS (
  SELECT * FROM (SELECT *, count(*) FILTER (split = 'holdout') OVER (PARTITION BY {_K}) AS held FROM sp) WHERE held < 3 OR split = 'holdout'
)"""


def _u(seed: str, key: str) -> str:
    return f"CAST(('0x' || substr(md5({seed} || ':' || {key}), 1, 13)) AS BIGINT) / 4503599627370496.0"


_SIGNALS = _SPLIT + f""", dealt AS (
  SELECT {_K}, row_number() OVER (PARTITION BY {_K} ORDER BY {_u("'42-shuffled'", "observation_id")}, observation_id) AS p, mean_sentiment AS d FROM sp
), sig AS (
  SELECT s.*, st.strategy, CASE st.strategy WHEN 'sentiment' THEN s.mean_sentiment WHEN 'random' THEN ({_u("'42'", "observation_id")}) * 2 - 1
         WHEN 'prior_return_momentum' THEN s.prior_return ELSE dealt.d END AS signal
  FROM sp s JOIN dealt USING ({_K}, p), (VALUES ('sentiment'), ('random'), ('prior_return_momentum'), ('shuffled_sentiment')) st(strategy)
)"""
_SKEY = f"{_K}, strategy"


def _degenerate(name: str, source: str, column: str, keys: str) -> str:
    return f""", {name}_cut AS (
  SELECT {keys}, list_sort(list({column}))[CAST(round((count(*) - 1) * 0.8) AS BIGINT) + 1] AS long_threshold,
         list_sort(list({column}))[CAST(round((count(*) - 1) * 0.2) AS BIGINT) + 1] AS short_threshold FROM {source} GROUP BY {keys}
), {name}_mode AS (
  SELECT {keys}, max(n) / sum(n) AS modal_share FROM (
    SELECT {keys}, printf('%.9f', CASE WHEN round({column}, 9) = 0 THEN 0.0 ELSE {column} END) AS v, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {keys}
), {name} AS (
  SELECT *, long_threshold <= short_threshold OR modal_share > 0.8 AS degenerate FROM {name}_cut JOIN {name}_mode USING ({keys})
)"""


_LIMITS = _SIGNALS + _degenerate("lim", "(SELECT * FROM sig WHERE split = 'development')", "signal", _SKEY)
_G = f"{_SKEY}, split"


def _trades_sql() -> str:
    cols = [c.strip() for c in _G.split(",")]
    same = " AND ".join(f"b.{c} = a.{c}" for c in [*cols, "symbol"])
    return _LIMITS + f""", sided AS (
  SELECT s.*, CASE WHEN signal >= long_threshold THEN 'long' WHEN signal <= short_threshold THEN 'short' END AS side
  FROM sig s JOIN lim USING ({_SKEY}) WHERE NOT degenerate
), able AS (
  SELECT *, CASE WHEN side = 'long' THEN future_return ELSE -future_return END AS gross_return,
         row_number() OVER (PARTITION BY {_G}, symbol ORDER BY entry_time, observation_id) AS k FROM sided WHERE side IS NOT NULL
), nexts AS (
  SELECT {", ".join("a." + c for c in cols)}, a.symbol, a.k, min(b.k) AS nxt FROM able a JOIN able b ON {same} AND b.k > a.k AND b.entry_time >= a.exit_time GROUP BY ALL
), walk AS (
  SELECT {_G}, symbol, k FROM able WHERE k = 1
  UNION ALL
  SELECT {", ".join("w." + c for c in cols)}, w.symbol, n.nxt FROM walk w JOIN nexts n USING ({_G}, symbol, k)
), taken AS (
  SELECT a.*, a.gross_return - 5.0 / 10000 AS net_return FROM able a JOIN walk USING ({_G}, symbol, k)
)"""


_TAKEN = _trades_sql()
_EQUITY = _TAKEN + f""", eq AS (
  SELECT *, sum(net_return) OVER (PARTITION BY {_G} ORDER BY entry_time, symbol ROWS UNBOUNDED PRECEDING) AS equity FROM taken
), dd AS (
  SELECT *, equity - greatest(0.0, max(equity) OVER (PARTITION BY {_G} ORDER BY entry_time, symbol ROWS UNBOUNDED PRECEDING)) AS drawdown FROM eq
)"""
_METRICS = _EQUITY + f""", done AS (
  SELECT {_G}, count(*) AS n, count(*) FILTER (side = 'long') AS nl, count(*) FILTER (side = 'short') AS ns, sum(gross_return) AS gross, sum(net_return) AS net,
         count(*) FILTER (net_return > 0) AS wins, coalesce(sum(net_return) FILTER (net_return > 0), 0) AS gains, coalesce(-sum(net_return) FILTER (net_return < 0), 0) AS losses,
         min(drawdown) AS mdd, coalesce(sum(net_return) FILTER (side = 'long'), 0) AS ln, coalesce(sum(net_return) FILTER (side = 'short'), 0) AS sn FROM dd GROUP BY {_G}
), dense AS (
  SELECT DISTINCT {_K}, st.strategy, x.split FROM obs, (VALUES ('sentiment'), ('always_flat'), ('random'), ('prior_return_momentum'), ('shuffled_sentiment')) st(strategy),
         (VALUES ('development'), ('holdout')) x(split)
), metrics AS (
  SELECT d.*, coalesce(n, 0) AS trade_count, coalesce(nl, 0) AS long_count, coalesce(ns, 0) AS short_count, coalesce(gross, 0.0) AS gross_return, coalesce(net, 0.0) AS net_return,
         coalesce(net / n, 0.0) AS average_net_return, coalesce(wins / n, 0.0) AS win_rate, coalesce(CASE WHEN losses > 0 THEN gains / losses ELSE gains END, 0.0) AS profit_factor,
         coalesce(mdd, 0.0) AS max_drawdown, coalesce(ln, 0.0) AS long_net_return, coalesce(sn, 0.0) AS short_net_return, coalesce(l.degenerate, false) AS degenerate
  FROM dense d LEFT JOIN done USING ({_G}) LEFT JOIN lim l USING ({_SKEY})
)"""


def _r(c: str, digits: int = 7) -> str:
    return f"CASE WHEN round({c}, {digits}) = 0 THEN 0.0 ELSE round({c}, {digits}) END AS {c.split('.')[-1]}"


def _t(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c.split('.')[-1]}"


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip().lstrip(',')}\n{select}"


# Queries -----------------------------------------------------------------------


@query(_with(_BARS, f"SELECT symbol, {_t('start_time')}, {_t('end_time')}, open, high, low, close, volume, {_r('(close - open) / open AS bar_return'.split(' AS ')[0], 7).replace('AS (close - open) / open', 'AS bar_return')} FROM bars"))
def bars_ohlcv(r: Relations) -> DataFrame:
    rows = r.bars.withColumn("bar_return", observations.bar_return())
    return rows.select("symbol", _stamp("start_time"), _stamp("end_time"), "open", "high", "low", "close", "volume", _num("bar_return"))


@query(_with(_CAL, f"SELECT strftime(session_date, '%Y-%m-%d') AS session_date, {_t('open_time')}, {_t('close_time')} FROM cal"))
def trading_calendar(r: Relations) -> DataFrame:
    return r.calendar.select(F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), _stamp("open_time"), _stamp("close_time"))


@query(_with(_BARS + ", " + _CAL + ", " + _SESSION, f"SELECT symbol, {_t('start_time')} FROM session"))
def session_filter(r: Relations) -> DataFrame:
    return cal.in_session(r.bars, r.calendar, "start_time").select("symbol", _stamp("start_time"))


@query(_with(_GATED, "SELECT vendor_id, coalesce(reason, 'normalized') AS place, dedupe_key, array_to_string(relevant_symbols, ',') AS relevant FROM gated"))
def gate_order(r: Relations) -> DataFrame:
    return r.gated.select("vendor_id", F.coalesce("reason", F.lit("normalized")).alias("place"), "dedupe_key", F.array_join("relevant_symbols", ",").alias("relevant"))


@query(_with(_GATED, """SELECT vendor_id, source, published_at_raw, title, url, CASE WHEN reason IN ('missing_published_at', 'unparseable_published_at', 'missing_title_and_summary')
  THEN 'quarantined' ELSE 'excluded' END AS disposition, reason, duplicate_of FROM gated WHERE reason IS NOT NULL"""))
def set_aside_reasons(r: Relations) -> DataFrame:
    return normalize.set_aside(r.gated)


@query(_with(_GATED, "SELECT CASE WHEN reason IS NULL THEN 'normalized' WHEN reason IN ('missing_published_at', 'unparseable_published_at', 'missing_title_and_summary') THEN 'quarantined' ELSE 'excluded' END AS place, count(*) AS n FROM gated GROUP BY 1"))
def disposition_counts(r: Relations) -> DataFrame:
    place = F.when(F.col("reason").isNull(), "normalized").otherwise(normalize.disposition())
    return r.narrow.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query(_with(_GATED, "SELECT vendor_id, article_id FROM gated WHERE reason IS NULL"))
def dedupe_earliest(r: Relations) -> DataFrame:
    return r.narrow.where("reason is null").select("vendor_id", "article_id")


@query(_with(_GATED, "SELECT vendor_id, unnest(relevant_symbols) AS symbol FROM gated WHERE reason IS NULL"))
def relevance_explode(r: Relations) -> DataFrame:
    return r.narrow.where("reason is null").select("vendor_id", F.explode("relevant_symbols").alias("symbol"))


@query(_with(_RAW, "SELECT source, arg_min(source_kind, ordinal) AS source_kind FROM raw GROUP BY source"))
def source_catalog(r: Relations) -> DataFrame:
    return normalize.source_catalog(r.narrow)


def _scores(r: Relations) -> DataFrame:
    return r.narrow.where("reason is null").select("ordinal", "n_tokens", "tone", "valence", "score", "hit")


@query(_with(_GATED + ", " + _SCORES, "SELECT ordinal, n_tokens, hit FROM scores"))
def tokenize_counts(r: Relations) -> DataFrame:
    return _scores(r).select("ordinal", "n_tokens", "hit")


@query(_with(_GATED + ", " + _SCORES, f"SELECT ordinal, {_r('tone')} FROM scores"))
def lm_tone(r: Relations) -> DataFrame:
    return _scores(r).select("ordinal", _num("tone"))


@query(_with(_GATED + ", " + _SCORES, f"SELECT ordinal, {_r('valence')} FROM scores"))
def valence_negation(r: Relations) -> DataFrame:
    return _scores(r).select("ordinal", _num("valence"))


@query(_with(_ARTICLES, f"SELECT vendor_id, scope, sentiment_label, {_r('sentiment_score')}, {_t('available_at')}, vendor_sentiment IS NOT NULL AS vendor_sentiment_available FROM labelled"))
def normalized_articles(r: Relations) -> DataFrame:
    return r.articles.select("vendor_id", "scope", "sentiment_label", _num("sentiment_score"), _stamp("available_at"), "vendor_sentiment_available")


@query(_with(_ARTICLES, f"SELECT vendor_id, {_t('published_at')}, {_t('available_at')}, date_diff('minute', published_at, available_at) AS deferred_by_minutes FROM labelled"))
def availability_deferral(r: Relations) -> DataFrame:
    late = F.timestamp_diff("MINUTE", F.col("published_at"), F.col("available_at"))
    return r.articles.select("vendor_id", _stamp("published_at"), _stamp("available_at"), late.alias("deferred_by_minutes"))


@query(_with(_GATED + ", " + _CAL + ", " + _SCORES, """SELECT round((SELECT avg(CASE WHEN reason IN ('missing_published_at', 'unparseable_published_at', 'missing_title_and_summary') THEN 1.0 ELSE 0.0 END) FROM gated), 9) AS quarantine_rate,
  round((SELECT avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FROM scores), 9) AS lexicon_hit_rate"""))
def quality_rates(r: Relations) -> DataFrame:
    return verdict.quality(r.narrow, r.articles).select(_num("quarantine_rate", 9), _num("lexicon_hit_rate", 9))


@query(_with(_GATED + ", " + _BARS, """SELECT strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day FROM (
  SELECT CAST(published_at AS DATE) AS d FROM gated WHERE reason IS NULL UNION ALL SELECT CAST(start_time AS DATE) FROM bars)"""))
def date_range(r: Relations) -> DataFrame:
    days = r.narrow.where("reason is null").select(F.to_date("published_at").alias("d")).union(r.bars.select(F.to_date("start_time")))
    return days.agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last_day"))


@query(_with(_BARS + ", " + _CAL + ", " + _SESSION, f"""SELECT s.symbol, {_t('s.start_time').replace('AS start_time', 'AS signal_time')}, {_r('p')}, {_r('v')} FROM (
  SELECT s.symbol, s.start_time, coalesce((b.close - b.open) / b.open, 0.0) AS p, coalesce(b.high / b.low - 1, 0.0) AS v
  FROM session s ASOF LEFT JOIN bars b ON b.symbol = s.symbol AND s.start_time >= b.end_time) s"""))
def asof_prior_bar(r: Relations) -> DataFrame:
    signal = cal.in_session(r.bars, r.calendar, "start_time").select("symbol", F.col("start_time").alias("signal_time"))
    rows = observations.prior_bars(r.bars, signal)
    return rows.select("symbol", _stamp("signal_time"), _num("prior_return").alias("p"), _num("prior_volatility").alias("v"))


@query(_with(_BARS + ", " + _CAL + ", " + _SESSION + ", " + _FUTURE, f"""SELECT symbol, {_t('signal_time')}, measurement_horizon_minutes, {_t('exit_time')}, {_r('fr')}, n_bars
  FROM (SELECT *, (fc - fo) / fo AS fr FROM future)"""))
def forward_horizon(r: Relations) -> DataFrame:
    rows = observations.forward_horizons(cal.in_session(r.bars, r.calendar, "start_time"), CFG.measurement_horizons_minutes)
    return rows.select("symbol", _stamp("signal_time"), "measurement_horizon_minutes", _stamp("exit_time"), _num("future_return").alias("fr"), F.size("price_bar_ids").cast("long").alias("n_bars"))


@query(_with(_ARTICLES + ", " + _BARS + ", " + _SESSION, f"""SELECT s.symbol, {_t('s.start_time').replace('AS start_time', 'AS signal_time')}, n.article_id, n.vendor_id FROM session s
  JOIN (SELECT *, unnest(relevant_symbols) AS symbol FROM labelled) n ON n.symbol = s.symbol AND n.available_at <= s.start_time AND n.available_at > s.start_time - INTERVAL 240 MINUTE"""))
def news_window_join(r: Relations) -> DataFrame:
    signal = cal.in_session(r.bars, r.calendar, "start_time").select("symbol", F.col("start_time").alias("signal_time"))
    rows = observations.news_matches(r.articles, signal, 240).join(r.articles.select("article_id", "vendor_id"), "article_id")
    return rows.select("symbol", _stamp("signal_time"), "article_id", "vendor_id")


_FEATURES = ["article_count", "ticker_article_count", "sector_theme_article_count", "macro_article_count", "source_count", "positive_article_count", "negative_article_count", "is_after_hours_signal", "future_tail_event"]
_REALS = ["mean_sentiment", "extreme_sentiment", "sentiment_dispersion", "prior_return", "prior_volatility", "future_return", "future_volatility", "future_max_drawdown", "future_max_runup"]


@query(_with(_OBS, f"SELECT observation_id, symbol, {_t('signal_time')}, {_t('exit_time')}, {_K}, {', '.join(_FEATURES)}, {', '.join(map(_r, _REALS))} FROM obs"))
def observation_features(r: Relations) -> DataFrame:
    return r.signals.select("observation_id", "symbol", _stamp("signal_time"), _stamp("exit_time"), *KEY, *_FEATURES, *map(_num, _REALS))


@query(_with(_GATED, "SELECT vendor_id, article_id FROM keyed WHERE published_at IS NOT NULL"))
def stable_ids(r: Relations) -> DataFrame:
    return r.narrow.where("published_at is not null").select("vendor_id", "article_id")


@query(_with(_OBS, f"SELECT {_K}, symbol, count(*) AS observation_count, sum(article_count)::BIGINT AS article_count FROM obs GROUP BY ALL"))
def coverage(r: Relations) -> DataFrame:
    return observations.coverage(r.signals)


@query(_with(_OBS, f"""SELECT {_K}, ['low', 'middle', 'high'][i + 1] AS bucket, count(*) AS observation_count, {_r('avg(mean_sentiment)').replace('AS avg(mean_sentiment)', 'AS mean_sentiment')},
  {_r('avg(future_return)').replace('AS avg(future_return)', 'AS mean_future_return')}
  FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY mean_sentiment, signal_time, observation_id) - 1 AS a, count(*) OVER (PARTITION BY {_K}) AS n FROM obs), (VALUES (0), (1), (2)) b(i)
  WHERE a >= i * n // 3 AND a < least(n, greatest((i + 1) * n // 3, i * n // 3 + 1)) GROUP BY ALL"""))
def bucket_returns(r: Relations) -> DataFrame:
    rows = stats.bucket_returns(r.signals)
    return rows.select(*KEY, "bucket", "observation_count", _num("mean_sentiment"), _num("mean_future_return"))


@query(_with(_SPLIT, "SELECT observation_id, split FROM sp"))
def chrono_split(r: Relations) -> DataFrame:
    return stats.split(r.signals, CFG.development_fraction).select("observation_id", "split")


@query(_with(_SIGNALS, f"SELECT observation_id, strategy, split, {_r('signal')} FROM sig"))
def strategy_signals(r: Relations) -> DataFrame:
    return backtest.signals(r.signals, CFG.seed, CFG.development_fraction).select("observation_id", "strategy", "split", _num("signal"))


@query(_with(_LIMITS, f"SELECT {_SKEY}, {_r('long_threshold')}, {_r('short_threshold')} FROM lim"))
def nearest_rank_thresholds(r: Relations) -> DataFrame:
    rows = backtest.thresholds(backtest.signals(r.signals, CFG.seed, CFG.development_fraction), CFG)
    return rows.select(*KEY, "strategy", _num("long_threshold"), _num("short_threshold"))


@query(_with(_OBS + _degenerate("deg", "obs", "mean_sentiment", _K), f"SELECT {_K}, {_r('modal_share')}, degenerate FROM deg"))
def modal_share(r: Relations) -> DataFrame:
    rows = stats.degeneracy(r.signals, "mean_sentiment", KEY, CFG.long_quantile, CFG.short_quantile, CFG.max_modal_share)
    return rows.select(*KEY, _num("modal_share"), "degenerate")


def _backtest(r: Relations) -> tuple[DataFrame, DataFrame]:
    return backtest.backtest(r.signals, CFG, CFG.costs_bps[0])


@query(_with(_TAKEN, f"SELECT {_G}, symbol, observation_id, side, {_t('entry_time')}, {_t('exit_time')}, {_r('gross_return')}, {_r('net_return')} FROM taken"))
def greedy_slots(r: Relations) -> DataFrame:
    return _backtest(r)[1].select(*backtest.GROUP, "symbol", "observation_id", "side", _stamp("entry_time"), _stamp("exit_time"), _num("gross_return"), _num("net_return"))


@query(_with(_EQUITY, f"SELECT {_G}, observation_id, {_r('equity')}, {_r('drawdown')} FROM dd"))
def equity_drawdown(r: Relations) -> DataFrame:
    return backtest.equity(_backtest(r)[1]).select(*backtest.GROUP, "observation_id", _num("equity"), _num("drawdown"))


_COUNTS = ["trade_count", "long_count", "short_count", "degenerate"]
_SUMS = ["gross_return", "net_return", "average_net_return", "win_rate", "profit_factor", "max_drawdown", "long_net_return", "short_net_return"]


@query(_with(_METRICS, f"SELECT {_G}, {', '.join(_COUNTS)}, {', '.join(_r(c, 6) for c in _SUMS)} FROM metrics"))
def trade_metrics(r: Relations) -> DataFrame:
    return _backtest(r)[0].select(*backtest.GROUP, *_COUNTS, *[_num(c, 6) for c in _SUMS])


_COMPARE = _METRICS + f""", best AS (
  SELECT {_K}, max(net_return) FILTER (strategy = 'sentiment') AS sentiment_net_return, max(net_return) FILTER (strategy <> 'sentiment') AS best_baseline_net_return,
         arg_max(strategy, row(net_return, -o)) FILTER (strategy <> 'sentiment') AS best_baseline_name
  FROM (SELECT *, list_position(['sentiment', 'always_flat', 'random', 'prior_return_momentum', 'shuffled_sentiment'], strategy) AS o FROM metrics) WHERE split = 'holdout' GROUP BY {_K}
)"""


@query(_with(_COMPARE, f"SELECT {_K}, {_r('sentiment_net_return')}, {_r('best_baseline_net_return')}, best_baseline_name FROM best"))
def strategy_comparison(r: Relations) -> DataFrame:
    rows = backtest.strategy_comparison(_backtest(r)[0])
    return rows.select(*KEY, _num("sentiment_net_return"), _num("best_baseline_net_return"), "best_baseline_name")


@query(_with(_OBS, f"SELECT {_K}, {_r('c')} FROM (SELECT {_K}, CASE WHEN stddev_pop(mean_sentiment) * stddev_pop(future_return) > 0 THEN corr(mean_sentiment, future_return) ELSE 0.0 END AS c FROM obs GROUP BY ALL)"))
def pearson(r: Relations) -> DataFrame:
    return stats.pearson(r.signals, "mean_sentiment", "future_return").select(*KEY, _num("pearson_correlation").alias("c"))


@query(_with(_ARTICLES, f"""SELECT {_r('vendor_agreement')} FROM (SELECT corr(a, b) AS vendor_agreement FROM (
  SELECT rank() OVER (ORDER BY sentiment_score) + (count(*) OVER (PARTITION BY sentiment_score) - 1) / 2 AS a, rank() OVER (ORDER BY vendor_sentiment) + (count(*) OVER (PARTITION BY vendor_sentiment) - 1) / 2 AS b
  FROM labelled WHERE vendor_sentiment IS NOT NULL))"""))
def spearman(r: Relations) -> DataFrame:
    return verdict.vendor_agreement(r.articles).select(_num("vendor_agreement"))


def _spread_sql(a: str, n: str) -> str:
    return f"avg(future_return) FILTER ({a} > {n} - greatest({n} // 3, 1)) - avg(future_return) FILTER ({a} <= greatest({n} // 3, 1))"


_TOP = f"""top AS (
  SELECT {_K}, {_spread_sql('a', 'n')} AS observed_top_minus_bottom, any_value(n) AS judged_count
  FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY mean_sentiment, signal_time, observation_id) AS a, count(*) OVER (PARTITION BY {_K}) AS n FROM judged) GROUP BY {_K}
)"""


@query(_with(_SPLIT + ", " + _TOP, f"SELECT {_K}, {_r('observed_top_minus_bottom')}, judged_count FROM top"))
def top_minus_bottom(r: Relations) -> DataFrame:
    rows = stats.top_minus_bottom(stats.judged(r.signals, CFG.development_fraction))
    return rows.select(*KEY, _num("observed_top_minus_bottom"), "judged_count")


_NULL = f"""own AS (
  SELECT {_K}, observation_id, mean_sentiment, future_return, permutation, row_number() OVER (PARTITION BY {_K}, permutation ORDER BY signal_time, observation_id) AS p
  FROM judged, (SELECT unnest(range(0, 200)) AS permutation)
), dealt2 AS (
  SELECT {_K}, permutation, mean_sentiment AS score, row_number() OVER (PARTITION BY {_K}, permutation ORDER BY {_u("'42-' || permutation", "observation_id")}, observation_id) AS p FROM own
), paired AS (
  SELECT {_K}, permutation, future_return, row_number() OVER (PARTITION BY {_K}, permutation ORDER BY score, p) AS a, count(*) OVER (PARTITION BY {_K}, permutation) AS n
  FROM own JOIN dealt2 USING ({_K}, permutation, p)
), spreads AS (
  SELECT {_K}, permutation, {_spread_sql('a', 'n')} AS spread, any_value(n) AS n FROM paired GROUP BY {_K}, permutation
), nul AS (
  SELECT {_K}, CASE WHEN any_value(n) < 3 THEN 0.0 ELSE avg(spread) END AS shuffled_top_minus_bottom, CASE WHEN any_value(n) < 3 THEN 0.0 ELSE list_sort(list(spread))[191] END AS shuffled_p95
  FROM spreads GROUP BY {_K}
)"""


@query(_with(_SPLIT + ", " + _NULL, f"SELECT {_K}, {_r('shuffled_top_minus_bottom')}, {_r('shuffled_p95')} FROM nul"))
def permutation_null(r: Relations) -> DataFrame:
    rows = stats.permutation_null(stats.judged(r.signals, CFG.development_fraction), CFG.seed)
    return rows.select(*KEY, _num("shuffled_top_minus_bottom"), _num("shuffled_p95"))


_COVER = f"""cov AS (
  SELECT {_K}, least(count(DISTINCT s) / greatest(any_value(e), 1), 1.0) AS source_set_coverage FROM (
    SELECT {_K}, a.source AS s FROM (SELECT {_K}, unnest(article_ids) AS article_id FROM obs) u JOIN labelled a USING (article_id))
  JOIN (SELECT x.source_set, count(DISTINCT c.source) AS e FROM sets x JOIN (SELECT source, arg_min(source_kind, ordinal) AS k FROM raw GROUP BY source) c ON c.k = x.kind GROUP BY 1) USING (source_set)
  GROUP BY {_K}
)"""


@query(_with(_OBS + ", " + _COVER, f"SELECT {_K}, {_r('source_set_coverage')} FROM cov"))
def source_set_coverage(r: Relations) -> DataFrame:
    rows = verdict.source_coverage(r.signals, r.articles, normalize.source_catalog(r.narrow))
    return rows.select(*KEY, _num("source_set_coverage"))


_VERDICT = _COMPARE + ", " + _TOP + ", " + _NULL + ", " + _COVER + _degenerate("deg", "obs", "mean_sentiment", _K) + f""", rates AS (
  SELECT (SELECT avg(CASE WHEN reason IN ('missing_published_at', 'unparseable_published_at', 'missing_title_and_summary') THEN 1.0 ELSE 0.0 END) FROM gated) AS quarantine_rate,
         (SELECT avg(CASE WHEN lexicon_hit THEN 1.0 ELSE 0.0 END) FROM labelled) AS lexicon_hit_rate
), grp AS (
  SELECT {_K}, count(*) AS observation_count, avg(article_count) AS articles_per_signal FROM obs GROUP BY {_K}
), ver AS (
  SELECT *, CASE WHEN quarantine_rate > 0.1 THEN 'stop' WHEN degenerate THEN 'expand sources' WHEN lexicon_hit_rate < 0.3 THEN 'expand sources' WHEN source_set_coverage < 0.5 THEN 'expand sources'
       WHEN articles_per_signal < 1.0 THEN 'expand data' WHEN judged_count < 30 THEN 'expand data'
       WHEN observed_top_minus_bottom - shuffled_p95 <= 0.0001 OR observed_top_minus_bottom <= 0.0001 THEN 'revise' WHEN sentiment_net_return <= best_baseline_net_return THEN 'revise' ELSE 'continue' END AS recommendation
  FROM grp JOIN top USING ({_K}) JOIN nul USING ({_K}) JOIN cov USING ({_K}) JOIN deg USING ({_K}) JOIN best USING ({_K}), rates
)"""


def _analysis(r: Relations) -> DataFrame:
    return verdict.analyze(r.signals, _backtest(r)[0], r.narrow, r.articles, normalize.source_catalog(r.narrow), CFG)


@query(_with(_VERDICT, f"SELECT {_K}, observation_count, {_r('articles_per_signal')}, recommendation FROM ver"))
def verdicts(r: Relations) -> DataFrame:
    return _analysis(r).select(*KEY, "observation_count", _num("articles_per_signal"), "recommendation")


@query(_with(_VERDICT, "SELECT recommendation, count(*) AS n FROM ver GROUP BY 1"))
def decision_histogram(r: Relations) -> DataFrame:
    return _analysis(r).groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))


@query(_with(_OBS, f"""SELECT l.vendor_id, {_t('l.available_at')}, l.available_at <> l.published_at AS was_deferred, date_diff('minute', l.published_at, l.available_at) AS deferred_by_minutes, count(u.article_id) AS observation_count
  FROM labelled l LEFT JOIN (SELECT unnest(article_ids) AS article_id FROM obs) u ON u.article_id = l.article_id GROUP BY l.vendor_id, l.available_at, l.published_at"""))
def timestamp_audit(r: Relations) -> DataFrame:
    return audit.timestamp_audit(r.articles, r.observations).select("vendor_id", _stamp("available_at"), "was_deferred", "deferred_by_minutes", "observation_count")


@query(_with(_OBS, "SELECT o.observation_id, l.vendor_id FROM (SELECT observation_id, entry_time, unnest(article_ids) AS article_id FROM obs) o JOIN labelled l USING (article_id) WHERE l.available_at > o.entry_time"))
def lookahead_violations(r: Relations) -> DataFrame:
    return audit.lookahead_violations(r.articles, r.observations).select("observation_id", "vendor_id")


@query(_with(_OBS, "SELECT vendor_id FROM labelled WHERE article_id NOT IN (SELECT unnest(article_ids) FROM obs)"))
def unused_articles(r: Relations) -> DataFrame:
    return audit.unused_articles(r.articles, r.observations).select("vendor_id")


@query(_with(_OBS, "SELECT count(DISTINCT symbol) AS symbols, count(DISTINCT symbol) / 4 >= 0.5 AS valid FROM obs"))
def run_validity(r: Relations) -> DataFrame:
    share = F.count_distinct("symbol") / len(CFG.symbols)
    return r.signals.agg(F.count_distinct("symbol").alias("symbols"), (share >= CFG.min_coverage).alias("valid"))


@query(_with(_OBS, f"""SELECT symbol, count(*) AS n, {_r('c')} FROM (SELECT symbol, mean_sentiment, future_return, corr(mean_sentiment, future_return) OVER (PARTITION BY symbol) AS c FROM obs
  WHERE news_window_minutes = 240 AND measurement_horizon_minutes = 60 AND source_set = 'finance_plus_broad') GROUP BY symbol, c"""))
def flagship_correlation(r: Relations) -> DataFrame:
    """Does sentiment of the last four hours go with the next hour's return?"""
    rows = r.signals.where("news_window_minutes = 240 and measurement_horizon_minutes = 60 and source_set = 'finance_plus_broad'")
    found = stats.pearson(rows, "mean_sentiment", "future_return", ["symbol"]).join(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol")
    return found.select("symbol", "n", _num("pearson_correlation").alias("c"))

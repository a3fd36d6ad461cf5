"""Invariants of the research engine on small hand-made relations."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.config import Config, Thresholds
from tickloom.functions import calendar as cal
from tickloom.functions import text as tx
from tickloom.functions.identity import stable_id_of
from tickloom.operators import audit, backtest, normalize, observations, stats, verdict
from tickloom.schemas import NORMALIZED_ARTICLES, PRICE_BARS, RAW_ARTICLES
from tickloom.sources import fixture

CFG = Config(
    run_id="t", symbols=["SPY", "QQQ"], source_sets=["finance_only", "broad_news", "finance_plus_broad"], news_windows_minutes=[60, 240],
    measurement_horizons_minutes=[60], holidays=["2026-07-03"], theme_symbol_map={"technology": ["QQQ"], "rates": ["SPY", "QQQ"], "housing": ["SPY"]},
    macro_symbols=["SPY", "QQQ"], verdict_thresholds=Thresholds(min_observations=2),
)


def t(text: str) -> datetime:
    return datetime.fromisoformat(text)


def raw(spark, *rows):
    base = {"vendor_id": "v", "source": "s", "source_kind": "finance", "published_at": t("2026-06-29 14:05"), "published_at_raw": "x", "title": "a", "summary": "b", "url": "u", "tickers": ["SPY"], "themes": [], "vendor_sentiment": None}
    full = [{**base, "ordinal": i, "vendor_id": f"v{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in RAW_ARTICLES) for r in full], RAW_ARTICLES)


def places(spark, *rows, config=CFG):
    return {r["vendor_id"]: r["reason"] for r in normalize.gated(raw(spark, *rows), config).collect()}


def test_stable_id():
    assert stable_id_of("art", ["fixture_finance", "fixture://spy-breakout", "2026-06-29T14:05:00Z"]) == "art_15cb10ef8870db50"


def test_config_is_checked():
    with pytest.raises(ValueError, match="short_quantile must be below"):
        replace(CFG, short_quantile=0.9)
    with pytest.raises(ValueError, match="saved_files_dir"):
        replace(CFG, news_source="saved_files")


def test_every_raw_row_has_one_place(spark):
    found = places(
        spark,
        {"published_at": None, "published_at_raw": " "}, {"published_at": None, "published_at_raw": "soon"}, {"title": " ", "summary": ""},
        {"url": "w", "published_at": t("2026-06-28 10:00")}, {"url": "x"}, {"url": "X ", "published_at": t("2026-06-29 14:06")}, {"url": "y", "tickers": ["ELSE"]},
        {"url": "z", "tickers": [], "themes": ["unknown"]},
        config=replace(CFG, dataset_start="2026-06-29", dataset_end="2026-06-29"),
    )
    assert found == {
        "v0": "missing_published_at", "v1": "unparseable_published_at", "v2": "missing_title_and_summary", "v3": "outside_dataset_window",
        "v4": None, "v5": "duplicate", "v6": "no_relevant_symbol", "v7": None,
    }


def test_earliest_duplicate_stays_whatever_the_order(spark):
    found = places(spark, {"published_at": t("2026-06-29 15:00")}, {"published_at": t("2026-06-29 14:00")})
    assert found == {"v0": "duplicate", "v1": None}


def test_calendar_knows_daylight_saving_early_closes_and_holidays(spark):
    days = cal.trading_calendar(spark, "2026-03-05", "2026-03-10", ["2026-03-05"], {"2026-03-06": "13:00"}).collect()
    assert [(str(d["session_date"]), d["open_time"].hour, d["close_time"].hour) for d in days] == [("2026-03-06", 14, 18), ("2026-03-09", 13, 20), ("2026-03-10", 13, 20)]


def test_fixture_run_defers_after_hours_news_and_drops_the_copy(spark):
    gated = normalize.gated(fixture.raw_articles(spark, CFG), CFG)
    days = cal.trading_calendar(spark, "2026-06-29", "2026-07-20", CFG.holidays)
    rows = {r["vendor_id"]: r for r in normalize.normalized(gated, CFG, days, fixture.lexicon(spark)).collect()}
    assert sorted(rows) == ["gdelt-1", "gdelt-2", "gdelt-3", "massive-1", "massive-2"]
    assert rows["gdelt-2"]["available_at"] == t("2026-07-06 13:30")
    assert rows["massive-1"]["sentiment_label"] == "positive" and rows["massive-2"]["sentiment_label"] == "negative"
    assert fixture.price_bars(spark, CFG).count() == 84
    bars = fixture.price_bars(spark, CFG)
    found = observations.build_observations(CFG, "ds", spark.createDataFrame(list(rows.values()), NORMALIZED_ARTICLES), bars, days)
    audit.assert_no_lookahead(spark.createDataFrame(list(rows.values()), NORMALIZED_ARTICLES), found)
    assert found.select("news_window_minutes", "source_set").distinct().count() == 6
    late = found.withColumn("entry_time", F.col("entry_time") - F.expr("INTERVAL 1 DAY"))
    with pytest.raises(audit.LookaheadError):
        audit.assert_no_lookahead(spark.createDataFrame(list(rows.values()), NORMALIZED_ARTICLES), late)


def bars_of(spark, *starts):
    rows = [(f"b{i}", "SPY", t(s), t(s).replace(hour=t(s).hour + 1), 100.0, 102.0, 99.0, 101.0, 1) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, PRICE_BARS)


def test_news_window_is_open_on_the_left_and_closed_on_the_right(spark):
    signal = spark.createDataFrame([("SPY", t("2026-06-29 15:30"))], "symbol string, signal_time timestamp_ntz")
    times = ["2026-06-29 14:30", "2026-06-29 14:31", "2026-06-29 15:30", "2026-06-29 15:31"]
    rows = [(f"a{i}", ["SPY"], "s", "finance", "ticker_specific", 0.1, "positive", t(x), t(x)) for i, x in enumerate(times)]
    news = spark.createDataFrame(rows, "article_id string, relevant_symbols array<string>, source string, source_kind string, scope string, sentiment_score double, sentiment_label string, available_at timestamp_ntz, published_at timestamp_ntz")
    assert {r["article_id"] for r in observations.news_matches(news, signal, 60).collect()} == {"a1", "a2"}


def test_horizon_needs_bars_without_a_gap(spark):
    bars = bars_of(spark, "2026-06-29 13:30", "2026-06-29 14:30", "2026-06-29 16:30")
    found = observations.forward_horizons(bars, [60, 120]).collect()
    assert {(r["signal_time"].hour, r["measurement_horizon_minutes"]) for r in found} == {(13, 60), (14, 60), (16, 60), (13, 120)}


def test_prior_bar_is_the_last_that_has_ended(spark):
    bars = bars_of(spark, "2026-06-29 13:30", "2026-06-29 14:30")
    asked = spark.createDataFrame([("SPY", t("2026-06-29 13:30")), ("SPY", t("2026-06-29 14:30")), ("SPY", t("2026-07-02 10:00"))], "symbol string, signal_time timestamp_ntz")
    found = {r["signal_time"]: r["prior_return"] for r in observations.prior_bars(bars, asked).collect()}
    assert found[t("2026-06-29 13:30")] == 0.0 and found[t("2026-06-29 14:30")] == pytest.approx(0.01) and found[t("2026-07-02 10:00")] == pytest.approx(0.01)


def test_tokens_tone_valence_and_negation(spark):
    words = spark.createDataFrame([("good", 1, 2.0), ("bad", -1, -2.0)], "word string, tone int, valence double")
    texts = [(1, "Good, not good!"), (2, "isn't bad"), (3, ""), (4, None)]
    rows = spark.createDataFrame(texts, "k int, text string").select("k", tx.tokens(F.col("text")).alias("tokens"))
    found = {r["k"]: r for r in tx.score_tokens(rows, "k", words).collect()}
    assert found[1]["n_tokens"] == 3 and found[1]["tone"] == pytest.approx(2 / 3**0.5)
    assert found[1]["valence"] == pytest.approx(tx.expected_valence(2.0 * (1 - 0.74)))
    assert found[2]["valence"] == pytest.approx(tx.expected_valence(-2.0))  # isn't is no negator
    assert found[3]["score"] == found[4]["score"] == 0.0 and not found[3]["hit"]


OBS = "observation_id string, symbol string, news_window_minutes int, measurement_horizon_minutes int, source_set string, signal_time timestamp_ntz, entry_time timestamp_ntz, exit_time timestamp_ntz, mean_sentiment double, prior_return double, future_return double, article_count int, article_ids array<string>"


def obs(spark, scores, returns, prior=None):
    rows = []
    for i, (s, r) in enumerate(zip(scores, returns, strict=True)):
        at = datetime(2026, 1, 1 + i // 20, i % 20)
        rows.append((f"o{i:04d}", "SPY", 60, 60, "finance_only", at, at, at.replace(hour=at.hour + 1), float(s), float(prior[i] if prior else 0.0), float(r), 1, [f"a{i}"]))
    return spark.createDataFrame(rows, OBS)


def test_floor_thirds_and_spread(spark):
    rows = obs(spark, range(7), [10.0 * i for i in range(7)])
    assert stats.top_minus_bottom(rows).first()["observed_top_minus_bottom"] == 50.0
    assert sorted(r["observation_count"] for r in stats.bucket_returns(rows).collect()) == [2, 2, 3]


def test_tied_scores_are_degenerate_and_never_trade(spark):
    rows = obs(spark, [0.0] * 9 + [0.5], [0.01] * 10)
    metrics, trades = backtest.backtest(rows, replace(CFG, development_fraction=0.9), 0.0)
    own = metrics.where("strategy = 'sentiment'").collect()
    assert len(own) == 2 and all(r["degenerate"] and r["trade_count"] == 0 for r in own)
    assert metrics.count() == 10 and trades.where("strategy = 'always_flat'").count() == 0


def test_thresholds_come_from_development_alone(spark):
    scores = [i / 1000 for i in range(20)] + [0.9 + i / 1000 for i in range(20)]
    _, trades = backtest.backtest(obs(spark, scores, [0.01] * 40), CFG, 0.0)
    own = trades.where("strategy = 'sentiment' and split = 'holdout'")
    assert {r["side"] for r in own.collect()} == {"long"} and own.count() == 20


def test_a_taken_trade_holds_the_slot_and_a_skipped_one_does_not(spark):
    rows = obs(spark, [1.0] * 4, [0.01] * 4).withColumn("exit_time", F.col("entry_time") + F.expr("INTERVAL 2 HOURS")).withColumn("split", F.lit("holdout")).withColumn("strategy", F.lit("sentiment")).withColumn("signal", F.lit(1.0))
    limits = spark.createDataFrame([(60, 60, "finance_only", "sentiment", 0.5, -0.5, False)], "news_window_minutes int, measurement_horizon_minutes int, source_set string, strategy string, long_threshold double, short_threshold double, degenerate boolean")
    taken = backtest.trades(rows, limits, 5.0, "t").collect()
    assert sorted(r["observation_id"] for r in taken) == ["o0000", "o0002"]
    assert taken[0]["net_return"] == pytest.approx(0.01 - 0.0005)


def test_planted_signal_clears_the_null_and_noise_does_not(spark):
    scores = [((i * 37) % 60) / 60 - 0.5 for i in range(60)]
    good = obs(spark, scores, [s * 0.02 for s in scores])
    noise = obs(spark, scores, [(((i * i * 7919) % 101) / 101 - 0.5) * 0.02 for i in range(60)])
    for rows, beats in ((good, True), (noise, False)):
        spread = stats.top_minus_bottom(rows).first()["observed_top_minus_bottom"]
        assert (spread > stats.permutation_null(rows, 42, 60).first()["shuffled_p95"] + 0.0001) is beats


def test_correlations(spark):
    rows = obs(spark, [1, 2, 3, 4], [1, 2, 3, 40])
    assert stats.spearman(rows, "mean_sentiment", "future_return", ["symbol"]).first()["spearman"] == pytest.approx(1.0)
    assert stats.pearson(obs(spark, [1, 1, 1], [1, 2, 3]), "mean_sentiment", "future_return").first()["pearson_correlation"] == 0.0


GATES = {"quarantine_rate": 0.0, "degenerate": False, "lexicon_hit_rate": 0.9, "source_set_coverage": 1.0, "articles_per_signal": 2.0, "judged_count": 100,
         "observed_top_minus_bottom": 0.01, "shuffled_p95": 0.001, "sentiment_net_return": 0.2, "best_baseline_net_return": 0.1, "best_baseline_name": "random"}


def test_gates_in_order(spark):
    cases = [
        ({}, "continue"), ({"quarantine_rate": 0.2, "degenerate": True}, "stop"), ({"degenerate": True}, "expand sources"), ({"lexicon_hit_rate": 0.5}, "expand sources"),
        ({"source_set_coverage": 0.4}, "expand sources"), ({"articles_per_signal": 0.5}, "expand data"), ({"judged_count": 10}, "expand data"), ({"shuffled_p95": 0.00995}, "revise"),
        ({"sentiment_net_return": 0.1}, "revise"),
    ]
    names = list(GATES)
    rows = spark.createDataFrame([tuple({**GATES, **c}[n] for n in names) + (i,) for i, (c, _) in enumerate(cases)], [*names, "i"])
    found = [r["recommendation"] for r in verdict.decide(rows, Thresholds()).orderBy("i").collect()]
    assert found == [w for _, w in cases]


def test_equal_scores_have_equal_means_in_every_order(spark):
    scores = [0.1, 0.2, 0.3, 0.7, -0.6, 0.05]
    fields = "symbol string, signal_time timestamp_ntz, article_id string, source string, source_kind string, scope string, sentiment_score double, sentiment_label string, available_at timestamp_ntz, published_at timestamp_ntz"
    at, rows = t("2026-06-29 15:30"), []
    for i in range(len(scores)):
        rows += [(f"S{i}", at, f"a{i}{j}", "s", "finance", "macro_market", x, "neutral", at, at) for j, x in enumerate(scores[i:] + scores[:i])]
    found = observations.window_features(spark.createDataFrame(rows, fields).coalesce(1), [60], ["finance_only"]).collect()
    assert len(found) == len(scores) and {r["mean_sentiment"] for r in found} == {0.125}


def test_equal_sums_of_valences_are_equal_scores(spark):
    words = spark.createDataFrame([("a", None, 0.1), ("b", None, 0.8), ("c", None, 0.7)], "word string, tone int, valence double")
    rows = spark.createDataFrame([(1, ["a"] * 8), (2, ["b"] + ["x"] * 7), (3, ["c", "a"] + ["x"] * 6)], "k int, tokens array<string>")
    assert len({r["score"] for r in tx.score_tokens(rows, "k", words).collect()}) == 1


def test_observations_join_the_news_once(spark):
    articles, bars = spark.createDataFrame([], NORMALIZED_ARTICLES), bars_of(spark, "2026-06-29 13:30")
    days = cal.trading_calendar(spark, "2026-06-29", "2026-07-20", CFG.holidays)
    plan = observations.build_observations(CFG, "ds", articles, bars, days)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate explode(array_distinct(relevant_symbols") == 1


def test_scores_come_from_raw_texts_as_from_gated_ones(spark):
    rows = fixture.raw_articles(spark, CFG)
    gated, days, words = normalize.gated(rows, CFG), cal.trading_calendar(spark, "2026-06-29", "2026-07-20", CFG.holidays), fixture.lexicon(spark)
    own, other = (normalize.normalized(gated, CFG, days, words, x).orderBy("vendor_id").collect() for x in (None, rows))
    assert own == other and len(own) == 5


def test_lookahead_is_found_for_each_early_use_and_joined_by_article(spark):
    articles = spark.createDataFrame([(f"a{i}", f"v{i}", datetime(2026, 1, 1, i)) for i in range(3)], "article_id string, vendor_id string, available_at timestamp_ntz")
    rows = obs(spark, [0.0] * 3, [0.0] * 3).withColumn("article_ids", F.array(F.lit("a0"), F.lit("a1"), F.lit("a2")))
    found = audit.lookahead_violations(articles, rows)
    assert sorted((r["observation_id"], r["vendor_id"], r["minutes_after_entry"]) for r in found.collect()) == [("o0000", "v1", 60), ("o0000", "v2", 120), ("o0001", "v2", 60)]
    assert "min(entry_time" in found._jdf.queryExecution().analyzed().toString()


def test_source_coverage_reads_the_sources_of_observations(spark):
    articles = spark.createDataFrame([(f"a{i}", f"s{i % 3}") for i in range(4)], "article_id string, source string")
    catalog = spark.createDataFrame([(f"s{i}", "finance") for i in range(4)], "source string, source_kind string")
    rows = obs(spark, [0.0] * 4, [0.0] * 4)
    kept = rows.withColumn("sources", F.transform("article_ids", lambda x: F.concat(F.lit("s"), (F.substring(x, 2, 1).cast("int") % 3).cast("string"))))
    found = verdict.source_coverage(kept, articles, catalog)
    assert found.collect() == verdict.source_coverage(rows, articles, catalog).collect() and found.first()["source_set_coverage"] == 0.75
    assert "article_ids" not in found._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_scores_of_batches_are_those_of_joined_tokens(spark):
    words = spark.createDataFrame([("good", 1, 2.1), ("bad", -1, -0.3), ("k", 1, 1e-15), ("i", None, 0.7), ("not", None, -0.4), ("b'c", -1, None)], "word string, tone int, valence double")
    texts = [None, "", "Good, not good! NOT BAD", "bad", "not", "good", "\u212a \u0130good \u0130", "\u00e9bad\u00e9 b'c", "never" + " good" * 50 + " \u00df" * 9, "x " * 3000, "fails\nbad not i"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    old = tx.score_tokens(rows.select("k", tx.tokens(F.col("text")).alias("tokens")), "k", words)
    new = tx.scored(rows, "text", words).select(old.columns)
    assert sorted(new.collect()) == sorted(old.collect()) and new.count() == len(texts)


def test_texts_beyond_a_slice_are_scored_each(spark, monkeypatch):
    monkeypatch.setattr(tx, "SLICE", 7)
    words = spark.createDataFrame([("good", 1, 2.0)], "word string, tone int, valence double")
    rows = spark.createDataFrame([(i, "good not " * (i % 3)) for i in range(20)], "k int, text string").coalesce(1)
    found = tx.scored(rows, "text", words).collect()
    assert [(r["k"], r["n_tokens"], r["hit"]) for r in found] == [(i, 2 * (i % 3), i % 3 > 0) for i in range(20)]


def test_narrowed_rows_are_gated_and_scored_as_whole_ones(spark):
    rows = fixture.raw_articles(spark, CFG).unionByName(raw(spark, {"ordinal": 90, "title": " ", "summary": ""}, {"ordinal": 91, "published_at": None, "published_at_raw": ""}))
    days, words = cal.trading_calendar(spark, "2026-06-29", "2026-07-20", CFG.holidays), fixture.lexicon(spark)
    whole, narrow = normalize.gated(rows, CFG), normalize.gated(normalize.narrowed(rows, words), CFG)
    own = ["ordinal", "article_id", "reason", "relevant_symbols", "duplicate_of"]
    assert narrow.select(own).orderBy("ordinal").collect() == whole.select(own).orderBy("ordinal").collect()
    own = [c for c in NORMALIZED_ARTICLES.fieldNames() if c not in ("title", "summary", "dedupe_key")]
    old, new = normalize.normalized(whole, CFG, days, words), normalize.normalized(narrow, CFG, days, words)
    assert new.select(own).orderBy("vendor_id").collect() == old.select(own).orderBy("vendor_id").collect()


def test_gates_and_scores_read_kept_rows_and_not_the_texts(spark):
    from tickloom.plans import catalog

    r = catalog.relations(spark, "/root/testdata/sf0.001")
    for rows in (r.narrow, r.articles, verdict.quality(r.narrow, r.articles), normalize.source_catalog(r.narrow)):
        assert not [f for f in rows.inputFiles() if "documents" in f]


def test_bands_make_the_features_of_matched_articles(spark):
    """Also over midnight, at both ends of a window and with more signals than articles."""
    signals = [(s, t(f"2026-06-{d} {h}")) for s in ("SPY", "QQQ") for d, h in ((29, "23:30"), (30, "00:30"), (30, "01:00"), (30, "01:30"), (30, "15:00"))]
    times = ["29 19:30", "29 19:31", "29 23:30", "29 23:59:59.999999", "30 00:00", "30 00:00:00.000001", "30 00:30", "30 00:31", "30 01:00", "30 01:30", "30 01:30", "30 14:30", "30 16:00", "28 12:00"]
    rows = [
        (f"a{i}", ["SPY", "QQQ", "SPY"][: 1 + i % 3], f"s{i % 4}", ("finance", "broad")[i % 2], ("ticker_specific", "macro_market")[i % 2], (i * 7 % 11 - 5) / 10, ("positive", "neutral", "negative")[i % 3], t(f"2026-06-{x}"), t("2026-06-29 19:30"))
        for i, x in enumerate(times)
    ]
    rows.append(("late", ["SPY"], "s", "finance", "macro_market", 0.1, "positive", None, t("2026-06-29 19:30")))
    news = spark.createDataFrame(rows, "article_id string, relevant_symbols array<string>, source string, source_kind string, scope string, sentiment_score double, sentiment_label string, available_at timestamp_ntz, published_at timestamp_ntz")
    asked = spark.createDataFrame(signals, "symbol string, signal_time timestamp_ntz")
    for windows, sets in (([60, 240], CFG.source_sets), ([1500], ["broad_news"])):
        old = observations.window_features(observations.news_matches(news, asked, max(windows)), windows, sets)
        new = observations.banded_features(news, asked, windows, sets).select(old.columns)
        order = ["symbol", "signal_time", "news_window_minutes", "source_set"]
        assert new.orderBy(*order).collect() == old.orderBy(*order).collect() and old.count() > 5


def test_observations_do_not_hold_a_row_for_each_article_and_window(spark, monkeypatch):
    articles, bars = spark.createDataFrame([], NORMALIZED_ARTICLES), bars_of(spark, "2026-06-29 13:30")
    days = cal.trading_calendar(spark, "2026-06-29", "2026-07-20", CFG.holidays)
    monkeypatch.setattr(observations, "news_matches", None)
    assert observations.build_observations(CFG, "ds", articles, bars, days).count() == 0


def test_statistics_read_few_partitions_without_lists(spark):
    from tickloom.plans import catalog

    r = catalog.relations(spark, "/root/testdata/sf0.001")
    assert r.signals.rdd.getNumPartitions() <= catalog._FEW and not {"article_ids", "price_bar_ids"} & set(r.signals.columns)
    assert r.signals.count() == r.observations.count()

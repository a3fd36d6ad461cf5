"""Saved payloads, the paced client and whole runs."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest

from tickloom.config import Config
from tickloom.plans import runs
from tickloom.sources import api, saved_files

from .test_engine import CFG

MASSIVE = {"results": [
    {"id": "m1", "publisher": {"name": "P"}, "title": "T", "description": "D", "published_utc": "2026-06-29T14:05:00Z", "article_url": "u", "tickers": ["SPY"],
     "insights": [{"ticker": "SPY", "sentiment": "positive"}, {"ticker": "X", "sentiment": "neutral"}]},
    {"id": "m2", "publisher": {"name": "P"}, "title": "T2", "description": None, "published_utc": "", "article_url": "w", "tickers": None, "insights": None},
]}
GDELT = {"articles": [{"url": "g", "title": "G", "domain": "d.example", "seendate": "20260629T143000Z"}]}
ALPACA = {"bars": {"SPY": [{"t": "2026-06-29T14:00:00Z", "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10}]}, "next_page_token": None}


def test_saved_payloads(spark, tmp_path):
    for name, body in (("massive_SPY", MASSIVE), ("gdelt_macro", GDELT), ("alpaca_bars", ALPACA)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    config = replace(CFG, news_source="saved_files", price_source="saved_files", saved_files_dir=str(tmp_path))
    rows = {r["vendor_id"]: r for r in saved_files.raw_articles(spark, config).collect()}
    assert rows["m1"]["vendor_sentiment"] == 0.5 and rows["m1"]["published_at"].hour == 14
    assert rows["m2"]["published_at"] is None and rows["m2"]["tickers"] == [] and rows["m2"]["vendor_sentiment"] is None
    assert rows["g"]["source_kind"] == "broad" and rows["g"]["published_at"].minute == 30
    bar = saved_files.price_bars(spark, config).first()
    assert (bar["end_time"] - bar["start_time"]).seconds == 3600 and bar["volume"] == 10
    assert [r["symbol"] for r in saved_files.missing_symbols(config, saved_files.price_bars(spark, config)).collect()] == ["QQQ"]
    with pytest.raises(FileNotFoundError):
        saved_files.raw_articles(spark, replace(config, saved_files_dir=str(tmp_path / "none")))


def test_configuration_keys():
    base = {"run_id": "r", "symbols": ["SPY"], "source_sets": ["broad_news"], "news_windows_minutes": [60], "measurement_horizons_minutes": [60]}
    config = Config.from_dict(base | {"dataset_date_start": "2025-07-01", "dataset_date_end": "2025-07-07"})
    assert (config.dataset_start, config.dataset_end) == ("2025-07-01", "2025-07-07")
    for wrong in ({"unheard_of": 1}, {"dataset_date_start": "2025-07-08", "dataset_date_end": "2025-07-07"}, {"news_source": "api"}):
        with pytest.raises(ValueError):
            Config.from_dict(base | wrong)


def test_ordinals_follow_paths_and_places(spark, tmp_path):
    for name, ids in (("massive_B", ["b0", "b1"]), ("massive_A", ["a0"]), ("massive_C", [])):
        results = [{"id": i, "title": "t", "published_utc": "2025-07-01T00:00:00Z"} for i in ids]
        (tmp_path / f"{name}.json").write_text(json.dumps({"results": results, "status": "OK"}))
    rows = saved_files.massive_articles(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["vendor_id"] for r in rows] == ["a0", "b0", "b1"] and len({r["ordinal"] for r in rows}) == 3


def test_client_pages_caches_retries_and_gives_up(tmp_path):
    answers = [(429, "slow"), (200, json.dumps({"next_url": "https://x/?cursor=abc&x=1"})), (200, "{}")]
    waits, now = [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    client = api.Client(tmp_path, lambda *a: answers.pop(0), sleep, lambda: now[0])
    assert len(client.massive("SPY", "a", "b", "k")) == 2 and answers == []
    assert 2.0 in waits and any(w >= 9 for w in waits)
    assert len(client.massive("SPY", "a", "b", "k")) == 2  # from the cache
    assert [row[5] for row in client.log] == [False, False, True, True] and client.log[0][4] is True
    refused = api.Client(tmp_path, lambda *a: (403, "no"), sleep, lambda: now[0])
    with pytest.raises(RuntimeError, match="403"):
        refused.gdelt("q", "a", "b")
    assert api.timeframe(15) == "15Min" and api.timeframe(240) == "4Hour"
    with pytest.raises(ValueError):
        api.timeframe(90)


def test_whole_run_is_reproducible(spark, tmp_path):
    config = replace(CFG, output_root=str(tmp_path))
    out = runs.run_all(spark, config)
    analysis = json.loads((out / "reports" / "analysis_summary.json").read_text())
    assert len(analysis) == 6 and all(a["recommendation"] for a in analysis)
    for name in ("reports/summary.md", "reports/coverage.csv", "reports/set_aside.csv", "charts/equity_curve.svg", "validity.json"):
        assert (out / name).exists()
    again, _ = runs.ingest(spark, config)
    assert [p.name for p in (tmp_path / "data" / "datasets").iterdir()] == [again]


def test_dry_run_checks_the_configuration(tmp_path, capsys):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"run_id": "r", "symbols": ["SPY"], "source_sets": ["broad_news"], "news_windows_minutes": [60], "measurement_horizons_minutes": [60]}))
    runs.main(["run", "--config", str(file), "--dry-run"])
    assert "dry run" in capsys.readouterr().out

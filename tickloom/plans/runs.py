"""Whole runs: ingest, build observations, analyze, backtest, and all of them."""

from __future__ import annotations

import argparse
import json
import shutil
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import calendar as cal
from ..functions import text
from ..operators import audit, backtest, normalize, observations, stats, verdict
from ..operators.stats import KEY
from ..sources import api, fixture, registry, snapshot


def _calendar(spark: SparkSession, config: Config, raw: DataFrame, bars: DataFrame) -> DataFrame:
    days = raw.select(F.to_date("published_at").alias("d")).union(bars.select(F.to_date("start_time"))).agg(F.min("d"), F.max("d")).first()
    if days[0] is None:
        raise ValueError("neither articles nor bars have dates")
    last = days[1].toordinal() + 21  # the next session after the last day
    return cal.trading_calendar(spark, str(days[0]), str(type(days[1]).fromordinal(last)), config.holidays, config.early_closes)


def ingest(spark: SparkSession, config: Config, words: DataFrame | None = None) -> tuple[str, Path]:
    """Fetch, normalize and publish a data set."""
    shared = registry.client(config)
    raw, bars = registry.news_source(config, shared)(spark, config), registry.price_source(config, shared)(spark, config)
    words = words if words is not None else fixture.lexicon(spark)
    gated = normalize.gated(raw, config)
    articles = normalize.normalized(gated, config, _calendar(spark, config, raw, bars), words)
    tables = {
        "raw_articles": raw, "gated": gated.select("vendor_id", "reason"), "normalized_articles": articles, "set_aside_articles": normalize.set_aside(gated),
        "price_bars": bars, "source_catalog": normalize.source_catalog(raw),
    }
    if shared.log:
        tables["ingest_log"] = api.ingest_log(spark, shared)
    facts = {"kind": "dataset", "vendors": registry.vendor_names(config), "symbols": config.symbols, "generated_at": config.generated_at, "scorer": snapshot.content_hash(words)}
    return snapshot.write_snapshot(Path(config.output_root), "datasets", "ds", tables, facts, ("raw_articles",))


def build(spark: SparkSession, config: Config, dataset: str) -> tuple[str, Path]:
    folder = Path(config.output_root) / "data" / "datasets" / dataset
    articles, bars = snapshot.read_table(spark, folder, "normalized_articles"), snapshot.read_table(spark, folder, "price_bars")
    calendar = _calendar(spark, config, articles, bars)
    rows = observations.build_observations(config, dataset, articles, bars, calendar)
    facts = {"kind": "observations", "dataset_id": dataset, "windows": config.news_windows_minutes, "horizons": config.measurement_horizons_minutes, "source_sets": config.source_sets, "generated_at": config.generated_at}
    return snapshot.write_snapshot(Path(config.output_root), "observation_sets", "obs", {"news_signal_observations": rows}, facts)


def _loaded(spark: SparkSession, config: Config, observation_set: str) -> tuple[DataFrame, dict[str, DataFrame], str]:
    root = Path(config.output_root) / "data"
    folder = root / "observation_sets" / observation_set
    dataset = json.loads((folder / "manifest.json").read_text())["dataset_id"]
    names = ["gated", "normalized_articles", "price_bars", "source_catalog", "set_aside_articles"]
    tables = {n: snapshot.read_table(spark, root / "datasets" / dataset, n) for n in names}
    return snapshot.read_table(spark, folder, "news_signal_observations"), tables, dataset


def run_backtest(spark: SparkSession, config: Config, observation_set: str, run_id: str, cost_bps: float | None = None) -> Path:
    rows, _, _ = _loaded(spark, config, observation_set)
    out = Path(config.output_root) / "runs" / run_id
    for cost in [cost_bps] if cost_bps is not None else config.costs_bps:
        metrics, trades = backtest.backtest(rows, config, cost, run_id)
        snapshot.write_csv(metrics, out / "reports" / f"backtest_metrics_{cost:g}bps.csv", backtest.GROUP)
        snapshot.write_csv(trades, out / "reports" / f"trade_log_{cost:g}bps.csv", [*backtest.GROUP, "entry_time", "symbol"])
    return out


def run_analyze(spark: SparkSession, config: Config, observation_set: str, run_id: str) -> Path:
    """Decisions and reports.  The look-ahead check comes before anything is written."""
    rows, tables, dataset = _loaded(spark, config, observation_set)
    audit.assert_no_lookahead(tables["normalized_articles"], rows)
    metrics, trades = backtest.backtest(rows, config, config.costs_bps[0], run_id)
    found = verdict.analyze(rows, metrics, tables["gated"], tables["normalized_articles"], tables["source_catalog"], config)
    held = metrics.where("strategy = 'sentiment' and split = 'holdout'").select(*KEY, *snapshot.SUMMARY[snapshot.SUMMARY.index("trade_count") :])
    agreement = verdict.vendor_agreement(tables["normalized_articles"]).first()
    shared = {"vendor_agreement": (agreement and agreement[0]) or 0.0}
    analysis = [r.asDict() | shared for r in found.join(held, KEY, "left").orderBy(*KEY).collect()]  # one row a configuration
    out = Path(config.output_root) / "runs" / run_id
    (out / "reports").mkdir(parents=True, exist_ok=True)
    symbols = rows.select("symbol").distinct().count()
    valid = symbols / len(config.symbols) >= config.min_coverage
    (out / "config.json").write_text(json.dumps(asdict(config), indent=2) + "\n")
    (out / "validity.json").write_text(json.dumps({"valid": valid, "symbols_with_observations": symbols}) + "\n")
    (out / "reports" / "analysis_summary.json").write_text(json.dumps(analysis, indent=2, default=str) + "\n")
    for kind, own in (("datasets", dataset), ("observation_sets", observation_set)):
        shutil.copyfile(Path(config.output_root) / "data" / kind / own / "manifest.json", out / f"{kind}_manifest.json")
    snapshot.write_csv(observations.coverage(rows), out / "reports" / "coverage.csv", [*KEY, "symbol"])
    buckets = stats.bucket_returns(rows)
    snapshot.write_csv(buckets, out / "reports" / "bucket_returns.csv", [*KEY, "bucket"])
    snapshot.write_csv(audit.timestamp_audit(tables["normalized_articles"], rows), out / "reports" / "timestamp_audit.csv", ["published_at", "vendor_id"])
    snapshot.write_csv(tables["set_aside_articles"], out / "reports" / "set_aside.csv", ["disposition", "reason", "vendor_id"])
    snapshot.write_summary(out / "reports" / "summary.md", dataset, observation_set, analysis, valid)
    first = [F.col("news_window_minutes") == config.news_windows_minutes[0], F.col("measurement_horizon_minutes") == config.measurement_horizons_minutes[0], F.col("source_set") == config.source_sets[0]]
    primary = lambda df: df.where(first[0] & first[1] & first[2])
    means = {r["bucket"]: r["mean_future_return"] for r in primary(buckets).collect()}  # three rows
    snapshot.bucket_chart(out / "charts" / "bucket_returns.svg", [(b, means[b]) for b in stats.BUCKETS if b in means])
    curve = backtest.equity(primary(trades).where("strategy = 'sentiment' and split = 'holdout'")).orderBy("entry_time", "symbol")
    snapshot.equity_chart(out / "charts" / "equity_curve.svg", [0.0, *[r["equity"] for r in curve.select("equity").toLocalIterator()]])
    return out


def run_all(spark: SparkSession, config: Config, run_id: str | None = None, words: DataFrame | None = None) -> Path:
    run_id = run_id or config.run_id
    dataset, _ = ingest(spark, config, words)
    observation_set, _ = build(spark, config, dataset)
    run_backtest(spark, config, observation_set, run_id)
    return run_analyze(spark, config, observation_set, run_id)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tickloom")
    parser.add_argument("command", choices=["run", "fixture", "ingest", "build-observations", "analyze", "backtest"])
    parser.add_argument("--config", required=True)
    parser.add_argument("--output-root")
    parser.add_argument("--lexicon", nargs=2, metavar=("POSITIVE", "NEGATIVE"), help="word lists, one word a line")
    parser.add_argument("--valence", help="tab-separated word, valence, ...")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--dataset-id")
    parser.add_argument("--observation-set-id")
    parser.add_argument("--run-id")
    parser.add_argument("--cost-bps", type=float)
    args = parser.parse_args(argv)
    config = Config.load(args.config)
    if args.output_root:
        config = replace(config, output_root=args.output_root)
    if args.dry_run:
        print(f"dry run: {args.command} of {config.run_id} is valid")
        return
    spark = SparkSession.builder.appName("tickloom").getOrCreate()
    run_id = args.run_id or config.run_id
    lists = [text.read_words(spark, path, tone) for path, tone in zip(args.lexicon or [], (1, -1), strict=False)]
    lists += [text.read_valence(spark, args.valence)] if args.valence else []
    words = text.lexicon(*lists) if lists else None
    if config.news_source != "fixture" and words is None and args.command in ("run", "ingest"):
        parser.error("news that is not the fixture's needs --lexicon or --valence")
    if args.command in ("build-observations", "analyze", "backtest") and not (args.dataset_id if args.command == "build-observations" else args.observation_set_id):
        parser.error(f"{args.command} needs the identifier of what it reads")
    if args.command in ("run", "fixture"):
        print(run_all(spark, config, run_id, words))
    elif args.command == "ingest":
        print(ingest(spark, config, words)[0])
    elif args.command == "build-observations":
        print(build(spark, config, args.dataset_id)[0])
    elif args.command == "analyze":
        print(run_analyze(spark, config, args.observation_set_id, run_id))
    else:
        print(run_backtest(spark, config, args.observation_set_id, run_id, args.cost_bps))

"""Sinks: content-addressed snapshots, manifests, CSV, JSON lines and reports."""

from __future__ import annotations

import csv
import json
import shutil
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import stable_id_of


def content_hash(df: DataFrame) -> str:
    """A hash of a relation's rows that does not depend on their order or on files."""
    rows = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("h"))
    # Two sums and a count over all rows, combined before the shuffle.
    mixed = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return stable_id_of("rows", [int(mixed["n"]), str(mixed["s"] or 0), str(mixed["x"] or 0)])


def publish(folder: Path, building: str, name: str) -> Path:
    """Give a finished folder its final name; an equal snapshot that exists stays."""
    made, final = folder / building, folder / name
    if final.exists():
        shutil.rmtree(made)
    else:
        made.rename(final)
    return final


def write_snapshot(root: Path, kind: str, prefix: str, tables: dict[str, DataFrame], facts: dict, jsonl: tuple[str, ...] = ()) -> tuple[str, Path]:
    """Write tables and a manifest; the id hashes the facts and the rows' content."""
    folder = root / "data" / kind
    building = folder / "_building"
    shutil.rmtree(building, ignore_errors=True)
    building.mkdir(parents=True)
    for name, df in tables.items():
        if name in jsonl:
            df.write.json(f"file://{building.resolve()}/raw/{name}.jsonl")
        else:
            df.write.parquet(f"file://{building.resolve()}/{name}.parquet")
    manifest = {**facts, "content": {name: content_hash(df) for name, df in sorted(tables.items())}}
    own = stable_id_of(prefix, manifest)
    (building / "manifest.json").write_text(json.dumps({"id": own, **manifest}, indent=2) + "\n")
    return own, publish(folder, "_building", own)


def read_table(spark: SparkSession, folder: Path, name: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"file://{(folder / name).resolve()}.parquet")


def write_csv(df: DataFrame, path: Path, order: list[str]) -> None:
    """A report as one CSV file; it is streamed row by row, so its size is not the driver's."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.orderBy(*order).toLocalIterator():
            out.writerow(["" if v is None else f"{v:.12g}" if isinstance(v, float) else v for v in row])


#: Columns of the summary's table; those from trade_count on are the sentiment strategy's on held-out rows.
SUMMARY = """news_window_minutes measurement_horizon_minutes source_set observation_count recommendation reason sentiment_net_return
best_baseline_name best_baseline_net_return degenerate articles_per_signal source_set_coverage observed_top_minus_bottom shuffled_p95
pearson_correlation trade_count net_return win_rate long_count long_net_return long_win_rate short_count short_net_return short_win_rate""".split()
#: Run-wide figures and what they say.
DATA_QUALITY = {
    "quarantine_rate": "share of articles without a usable time or text",
    "lexicon_hit_rate": "share of articles in which the scorer knew a word",
    "vendor_agreement": "rank correlation of our scores with the vendor's; a benchmark, never traded on",
    "degenerate_configurations": "configurations whose scores are too tied to trade; they take no trades",
}


def write_summary(path: Path, dataset: str, observation_set: str, analysis: list[dict], valid: bool) -> None:
    """Markdown: run-wide data quality, then a row for each configuration; invalid runs carry a stamp."""
    columns = SUMMARY
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v).replace("|", "/")
    lines = ["# Run summary", "", f"Data set `{dataset}`, observation set `{observation_set}`.", ""]
    if not valid:
        lines += ["**This run is invalid: too few symbols have observations.**", ""]
    first = analysis[0] if analysis else {}
    facts = {c: first.get(c, 0.0) for c in DATA_QUALITY} | {"degenerate_configurations": sum(bool(r["degenerate"]) for r in analysis)}
    lines += [f"Configurations: {len(analysis)}, of which continue: {sum(r['recommendation'] == 'continue' for r in analysis)}.", "", "## Data quality", ""]
    lines += ["| figure | value | meaning |", "|---|---|---|", *(f"| {c} | {show(facts[c])} | {why} |" for c, why in DATA_QUALITY.items())]
    lines += ["", "## Configurations", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in analysis]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def _svg(body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="800" height="420" viewBox="0 0 800 420"><rect width="800" height="420" fill="white"/>{body}</svg>\n'


def bucket_chart(path: Path, rows: list[tuple[str, float]]) -> None:
    top = max([abs(v) for _, v in rows] or [0.0]) or 1.0
    body = '<line x1="40" y1="210" x2="760" y2="210" stroke="black"/>'
    for i, (name, value) in enumerate(rows):
        height, x = abs(value) / top * 160, 80 + i * 680 / max(1, len(rows))
        y = 210 - height if value >= 0 else 210
        body += f'<rect x="{x:.1f}" y="{y:.1f}" width="{480 / max(1, len(rows)):.1f}" height="{height:.1f}" fill="steelblue"/><text x="{x:.1f}" y="400">{escape(name)}: {value:.6f}</text>'
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(_svg(body))


def equity_chart(path: Path, equity: list[float]) -> None:
    low, high = min([0.0, *equity]), max([0.0, *equity])
    step, span = 720 / max(1, len(equity) - 1), (high - low) or 1.0
    points = " ".join(f"{40 + i * step:.1f},{380 - (v - low) / span * 340:.1f}" for i, v in enumerate(equity))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(_svg(f'<polyline points="{points}" fill="none" stroke="steelblue" stroke-width="2"/>'))

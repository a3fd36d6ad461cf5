"""Run configuration: defaults, loading and validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import date
from pathlib import Path


#: Keys of configuration files, where they are not the fields' own names.
RENAMED = {"dataset_date_start": "dataset_start", "dataset_date_end": "dataset_end"}


@dataclass(frozen=True)
class Thresholds:
    """Limits of the decision gates."""

    max_quarantine_rate: float = 0.10
    min_lexicon_hit_rate: float = 0.60
    min_source_coverage: float = 0.50
    min_articles_per_signal: float = 1.0
    min_observations: int = 30
    min_spread_margin: float = 0.0001


@dataclass(frozen=True)
class Config:
    run_id: str
    symbols: list[str]
    source_sets: list[str]
    news_windows_minutes: list[int]
    measurement_horizons_minutes: list[int]
    price_interval_minutes: int = 60
    long_quantile: float = 0.8
    short_quantile: float = 0.2
    costs_bps: list[float] = field(default_factory=lambda: [0.0])
    holidays: list[str] = field(default_factory=list)
    early_closes: dict[str, str] = field(default_factory=dict)
    theme_symbol_map: dict[str, list[str]] = field(default_factory=dict)
    constituent_etf_map: dict[str, list[str]] = field(default_factory=dict)
    macro_symbols: list[str] = field(default_factory=list)
    dataset_start: str | None = None
    dataset_end: str | None = None
    verdict_thresholds: Thresholds = field(default_factory=Thresholds)
    max_modal_share: float = 0.8
    seed: int = 42
    development_fraction: float = 0.5
    min_coverage: float = 0.5
    news_source: str = "fixture"
    price_source: str = "fixture"
    saved_files_dir: str | None = None
    output_root: str = "artifacts"
    generated_at: str = "1970-01-01T00:00:00Z"

    def __post_init__(self) -> None:
        problems = [
            (not self.run_id.strip(), "run_id must not be empty"),
            (not self.symbols, "symbols must not be empty"),
            (not self.news_windows_minutes, "news_windows_minutes must not be empty"),
            (any(m <= 0 for m in self.news_windows_minutes), "news_windows_minutes must be positive"),
            (not self.measurement_horizons_minutes, "measurement_horizons_minutes must not be empty"),
            (any(m <= 0 for m in self.measurement_horizons_minutes), "measurement_horizons_minutes must be positive"),
            (not self.source_sets, "source_sets must not be empty"),
            (not 0 <= self.short_quantile < 1, "short_quantile must be between 0 and 1"),
            (not 0 <= self.long_quantile < 1, "long_quantile must be between 0 and 1"),
            (self.short_quantile >= self.long_quantile, "short_quantile must be below long_quantile"),
            (
                "saved_files" in (self.news_source, self.price_source) and not self.saved_files_dir,
                "saved_files_dir is required when a source is saved_files",
            ),
        ]
        bounds = [date.fromisoformat(d) if d else None for d in (self.dataset_start, self.dataset_end)]
        problems += [
            (all(bounds) and bounds[0] > bounds[1], "the first date must not be after the last"),
            ("api" in (self.news_source, self.price_source) and not all(bounds), "an api source needs both dates"),
        ]
        for wrong, message in problems:
            if wrong:
                raise ValueError(message)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        values = {RENAMED.get(k, k): v for k, v in values.items()}
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
        if isinstance(values.get("verdict_thresholds"), dict):
            values["verdict_thresholds"] = Thresholds(**values["verdict_thresholds"])
        return cls(**values)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        return cls.from_dict(json.loads(Path(path).read_text()))

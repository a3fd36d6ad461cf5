"""Sources by mode."""

from __future__ import annotations

from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from . import api, fixture, saved_files


class NewsSource(Protocol):
    def __call__(self, spark: SparkSession, config: Config) -> DataFrame: ...


class PriceSource(Protocol):
    def __call__(self, spark: SparkSession, config: Config) -> DataFrame: ...


VENDORS = {"fixture": ["fixture"], "saved_files": ["massive", "gdelt", "alpaca"], "api": ["massive", "gdelt", "alpaca"]}


def client(config: Config) -> api.Client:
    """The client that the sources of a run share, so that pacing and log are the run's."""
    return api.Client(Path(config.output_root) / "cache")


def _landed(config: Config) -> Path:
    return Path(config.output_root) / "landed"


def news_source(config: Config, shared: api.Client | None = None) -> NewsSource:
    own = {"fixture": fixture.raw_articles, "saved_files": saved_files.raw_articles, "api": lambda s, c: api.raw_articles(s, c, shared or client(c), _landed(c))}
    return own[config.news_source]


def price_source(config: Config, shared: api.Client | None = None) -> PriceSource:
    own = {"fixture": fixture.price_bars, "saved_files": saved_files.price_bars, "api": lambda s, c: api.price_bars(s, c, shared or client(c), _landed(c))}
    return own[config.price_source]


def vendor_names(config: Config) -> list[str]:
    return list(dict.fromkeys(VENDORS[config.news_source] + VENDORS[config.price_source]))

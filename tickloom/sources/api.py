"""Vendor clients: paced, retried and cached requests that land raw JSON.

Landed payloads are then read like saved files.  The transport is a function
(url, query, headers) -> (status, body), so nothing here needs a network to test.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..schemas import INGEST_LOG
from . import saved_files

# Requests a minute, attempts, time-out, and page sizes.
PER_MINUTE = {"massive": 5, "alpaca": 150, "gdelt": 10}
ATTEMPTS, TIMEOUT = 5, 60
MASSIVE_PAGE, GDELT_PAGE, ALPACA_PAGE = 1000, 250, 10000
TIMEFRAMES = {60: "1Hour", 120: "2Hour", 240: "4Hour", 1440: "1Day"}
ADDRESS = {
    "massive": "https://api.massive.com/v2/reference/news",
    "gdelt": "https://api.gdeltproject.org/api/v2/doc/doc",
    "alpaca": "https://data.alpaca.markets/v2/stocks/bars",
}

Transport = Callable[[str, dict[str, str], dict[str, str]], tuple[int, str]]


def timeframe(minutes: int) -> str:
    if 1 <= minutes <= 59:
        return f"{minutes}Min"
    if minutes not in TIMEFRAMES:
        raise ValueError(f"no timeframe of {minutes} minutes")
    return TIMEFRAMES[minutes]


def credential(name: str) -> str:
    value = os.environ.get(name, "")
    if not value:
        raise RuntimeError(f"environment variable {name} is not set")
    return value


def cursor_of(url: str | None) -> str | None:
    return (urllib.parse.parse_qs(urllib.parse.urlsplit(url).query).get("cursor") or [None])[0] if url else None


def over_http(url: str, query: dict[str, str], headers: dict[str, str]) -> tuple[int, str]:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(query)}", headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except OSError as e:
        return 0, str(e)


@dataclass
class Client:
    cache: Path
    transport: Transport = over_http
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    log: list[tuple] = field(default_factory=list)
    _last: dict[str, float] = field(default_factory=dict)

    def get(self, vendor: str, query: dict[str, str], headers: dict[str, str] | None = None) -> str:
        """Body of a request: from the cache, else paced and retried."""
        label = json.dumps([vendor, sorted(query.items())])
        file = self.cache / vendor / f"{hashlib.sha256(label.encode()).hexdigest()}.json"
        if file.exists():
            body = file.read_text()
            self.log.append((vendor, label, 200, 0, False, True, 0, len(body), ""))
            return body
        limited, began = False, self.clock()
        for attempt in range(1, ATTEMPTS + 1):
            wait = self._last.get(vendor, -1e9) + 60 / PER_MINUTE[vendor] - self.clock()
            if wait > 0:
                self.sleep(wait)
            self._last[vendor] = self.clock()
            status, body = self.transport(ADDRESS[vendor], query, headers or {})
            limited = limited or status == 429
            took = int((self.clock() - began) * 1000)
            if status == 200:
                file.parent.mkdir(parents=True, exist_ok=True)
                part = file.with_suffix(".part")
                part.write_text(body)
                part.replace(file)
                self.log.append((vendor, label, status, attempt, limited, False, took, len(body), ""))
                return body
            again = status == 0 or status == 429 or status >= 500
            if not again or attempt == ATTEMPTS:
                self.log.append((vendor, label, status, attempt, limited, False, took, len(body), body[:200]))
                raise RuntimeError(f"{vendor} answered {status}: {body[:200]}")
            self.sleep(float(2 ** min(attempt, 5)))
        raise AssertionError

    def massive(self, symbol: str, start: str, end: str, key: str) -> list[str]:
        """Pages of a symbol's news, by cursor."""
        query = {"ticker": symbol, "published_utc.gte": start, "published_utc.lte": end, "limit": str(MASSIVE_PAGE), "order": "asc"}
        pages, cursor = [], None
        while True:
            body = self.get("massive", query | ({"cursor": cursor} if cursor else {}), {"Authorization": f"Bearer {key}"})
            pages.append(body)
            cursor = cursor_of(json.loads(body).get("next_url"))
            if not cursor:
                return pages

    def gdelt(self, search: str, start: str, end: str) -> list[str]:
        days = {"startdatetime": start.replace("-", "") + "000000", "enddatetime": end.replace("-", "") + "235959"}
        query = {"query": search, "mode": "ArtList", "format": "json", "maxrecords": str(GDELT_PAGE)} | days
        return [self.get("gdelt", query)]

    def alpaca(self, symbols: list[str], minutes: int, start: str, end: str, key: str, secret: str) -> list[str]:
        """Pages of bars, by token."""
        query = {"symbols": ",".join(symbols), "timeframe": timeframe(minutes), "start": start, "end": end, "limit": str(ALPACA_PAGE), "feed": "iex", "adjustment": "all"}
        pages, token = [], None
        while True:
            body = self.get("alpaca", query | ({"page_token": token} if token else {}), {"APCA-API-KEY-ID": key, "APCA-API-SECRET-KEY": secret})
            pages.append(body)
            token = json.loads(body).get("next_page_token")
            if not token:
                return pages


# Fixed value: what the macro news request asks for.
GDELT_QUERY = '(stocks OR "federal reserve" OR inflation OR "interest rates") sourcelang:english'


def land(folder: Path, name: str, pages: list[str]) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    for i, body in enumerate(pages):
        (folder / f"{name}_{i:04d}.json").write_text(body)


def raw_articles(spark: SparkSession, config: Config, client: Client, folder: Path) -> DataFrame:
    start, end = config.dataset_start, config.dataset_end
    for symbol in config.symbols:
        land(folder, f"massive_{symbol}", client.massive(symbol, start, end, credential("MASSIVE_API_KEY")))
    land(folder, "gdelt_news", client.gdelt(GDELT_QUERY, start, end))
    rows = saved_files.massive_articles(spark, str(folder)).unionByName(saved_files.gdelt_articles(spark, str(folder)))
    if rows.isEmpty():
        raise ValueError("the vendors returned no articles")
    return rows


def price_bars(spark: SparkSession, config: Config, client: Client, folder: Path) -> DataFrame:
    keys = credential("ALPACA_API_KEY"), credential("ALPACA_API_SECRET")
    land(folder, "alpaca_bars", client.alpaca(config.symbols, config.price_interval_minutes, config.dataset_start, config.dataset_end, *keys))
    from dataclasses import replace

    bars = saved_files.price_bars(spark, replace(config, saved_files_dir=str(folder)))
    gone = [r["symbol"] for r in saved_files.missing_symbols(config, bars).collect()]  # at most the configured symbols
    if gone:
        raise ValueError(f"no bars came back for {', '.join(sorted(gone))}")
    return bars


def ingest_log(spark: SparkSession, client: Client) -> DataFrame:
    return spark.createDataFrame(client.log, INGEST_LOG)

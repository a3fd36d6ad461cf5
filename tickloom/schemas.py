"""Explicit schemas of the stored relations; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """A flat schema from "name type, ..."."""
    pairs = (c.split(" ") for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_ARTICLES = _struct(
    "ordinal bigint, vendor_id string, source string, source_kind string, published_at timestamp_ntz, published_at_raw string, "
    "title string, summary string, url string, tickers array<string>, themes array<string>, vendor_sentiment double"
)
NORMALIZED_ARTICLES = _struct(
    "article_id string, vendor_id string, source string, source_kind string, published_at timestamp_ntz, available_at timestamp_ntz, "
    "title string, summary string, url string, tickers array<string>, themes array<string>, scope string, "
    "relevant_symbols array<string>, sentiment_score double, sentiment_label string, vendor_sentiment double, "
    "vendor_sentiment_available boolean, lexicon_hit boolean, dedupe_key string"
)
SET_ASIDE = _struct(
    "vendor_id string, source string, published_at_raw string, title string, url string, disposition string, reason string, duplicate_of string"
)
PRICE_BARS = _struct(
    "bar_id string, symbol string, start_time timestamp_ntz, end_time timestamp_ntz, open double, high double, low double, close double, volume bigint"
)
INGEST_LOG = _struct(
    "vendor string, request string, status int, attempts int, rate_limited boolean, from_cache boolean, duration_ms bigint, bytes bigint, error string"
)
# Vendor payloads, as DDL.
MASSIVE_PAYLOAD = (
    "results array<struct<id string, publisher struct<name string>, title string, description string, published_utc string, article_url string, "
    "tickers array<string>, insights array<struct<ticker string, sentiment string>>>>, status string"
)
GDELT_PAYLOAD = ("articles array<struct<url string, title string, domain string, seendate string>>")
ALPACA_PAYLOAD = ("bars map<string, array<struct<t string, o double, h double, l double, c double, v bigint>>>, next_page_token string")

"""Stable identifiers: prefix and 16 hexadecimal digits of a compact JSON array's SHA-256."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stable_id(prefix: str, *parts: Column) -> Column:
    """``parts`` as JSON strings."""
    return of_json(prefix, F.to_json(F.array(*parts)))


def of_json(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 16))


def stable_id_of(prefix: str, value: object) -> str:
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return f"{prefix}_{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def sha256_hex(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()

"""Durations, byte quantities and times, as text and as columns."""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of each unit.
NANOS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000, "w": 604_800_000_000_000, "y": 31_536_000_000_000_000}
BYTES = {"B": 1, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "KiB": 1024, "MiB": 1024**2, "GiB": 1024**3}


def duration_ns(text: str, units: str = "ns us µs ms s m h", fraction: bool = False) -> int:
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)(ns|us|µs|ms|s|m|h|d|w|y)", text.strip())
    if not m or m[2] not in units.split() or ("." in m[1] and not fraction):
        raise ValueError(f"not a duration: {text!r}")
    return int(float(m[1]) * NANOS[m[2]]) if "." in m[1] else int(m[1]) * NANOS[m[2]]


def compound_ns(text: str) -> int:
    """Durations such as 1h30m."""
    parts = re.findall(r"([0-9]+)(ms|s|m|h|d|w|y)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(a) * NANOS[b] for a, b in parts)


def _quantity(text: Column, scale: dict[str, int], pattern: str) -> Column:
    number, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    factor = F.lit(None).cast("double")
    for name, value in scale.items():
        factor = F.when(unit == name, float(value)).otherwise(factor)
    return F.try_to_number(number, F.lit("999999999999999999")).cast("double") * factor


def duration_column(text: Column) -> Column:
    """Nanoseconds of a whole-number duration, or NULL."""
    return _quantity(text, {u: NANOS[u] for u in "ns us µs ms s m h".split()}, r"^([0-9]{1,18})(ns|us|µs|ms|s|m|h)$")


def bytes_column(text: Column) -> Column:
    return _quantity(text, BYTES, r"^([0-9]{1,18})(B|KB|MB|GB|KiB|MiB|GiB)$")


def number_column(text: Column) -> Column:
    """Finite decimal text as a double, or NULL."""
    value = text.try_cast("double")
    return F.when(F.rlike(text, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")) & (F.abs(value) < float("inf")), value)


def measured(text: Column, seconds: bool = False) -> Column:
    """A number, else a duration (in nanoseconds or seconds), else bytes."""
    span = duration_column(text)
    return F.coalesce(number_column(text), span / 1e9 if seconds else span, bytes_column(text))


def parse_time_ns(text: str) -> int:
    """RFC 3339 with up to nine digits of fraction, whole nanoseconds, or seconds with a fraction."""
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"-?[0-9]*\.[0-9]+", text):
        return round(float(text) * 1e9)
    m = re.fullmatch(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,9}))?(Z|[+-][0-9]{2}:[0-9]{2})", text)
    if not m:
        raise ValueError(f"not a time: {text!r}")
    at = datetime.fromisoformat(m[1] + ("+00:00" if m[3] == "Z" else m[3])).astimezone(timezone.utc)
    return int(at.timestamp()) * 1_000_000_000 + int((m[2] or "0").ljust(9, "0"))


def prometheus_time_ms(text: str) -> int:
    """Seconds with a fraction, as milliseconds; halves round away from zero."""
    seconds = float(text)
    if not math.isfinite(seconds) or abs(seconds) * 1000 > 1 << 63:
        raise ValueError(f"not a time: {text!r}")
    ms = seconds * 1000
    return int(math.floor(abs(ms) + 0.5)) * (1 if ms >= 0 else -1)


def trace_time_ns(text: str) -> int:
    """Whole seconds below 10**10, whole nanoseconds from there on, or RFC 3339; no time is negative."""
    if re.fullmatch(r"[0-9]+", text):
        return int(text) * (1_000_000_000 if int(text) < 10**10 else 1)
    at = parse_time_ns(text) if "T" in text else -1
    if at < 0:
        raise ValueError(f"not a time: {text!r}")
    return at


def delete_time_ns(text: str) -> int:
    """As parse_time_ns(), but whole numbers are seconds."""
    return int(text) * 1_000_000_000 if re.fullmatch(r"-?[0-9]+", text) else parse_time_ns(text)

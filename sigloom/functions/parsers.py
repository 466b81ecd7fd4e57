"""Label extraction from lines whose shape is known only at run time: nested JSON, logfmt, packed JSON.

These build maps with names that depend on the data and on the labels already
there, so they are Arrow-batched functions; everything else stays built-in.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())
UNPACKED = T.StructType([T.StructField("line", T.StringType()), T.StructField("labels", LABELS)])
ERROR = "__error__"
PAIR = re.compile(r'([^\s="]+)=(?:"((?:[^"\\]|\\.)*)"|(\S*))')


def _name(raw: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", raw)


def _scalar(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value)


def _add(labels: dict, name: str, value: str, taken: set[str]) -> None:
    while name in taken:
        name += "_extracted"
    labels[name] = value


def flatten(value: dict, prefix: str = "") -> dict[str, str]:
    """Nested objects joined by _, arrays left out."""
    out = {}
    for key, inner in value.items():
        name = _name(f"{prefix}_{key}" if prefix else key)
        if isinstance(inner, dict):
            out |= flatten(inner, name)
        elif not isinstance(inner, list):
            out[name] = _scalar(inner)
    return out


def _object(line: str | None) -> dict | None:
    try:
        value = json.loads(line or "")
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _each(lines: pd.Series, labels: pd.Series, parse) -> pd.Series:
    return pd.Series([parse(line, dict(have or {})) for line, have in zip(lines, labels)], dtype=object)


@F.pandas_udf(LABELS)
def json_labels(lines: pd.Series, labels: pd.Series) -> pd.Series:
    def parse(line, have):
        found, taken = _object(line), set(have)
        if found is None:
            return have | {ERROR: "JSONParserErr"}
        for name, value in flatten(found).items():
            _add(have, name, value, taken)
        return have

    return _each(lines, labels, parse)


@F.pandas_udf(LABELS)
def logfmt_labels(lines: pd.Series, labels: pd.Series) -> pd.Series:
    def parse(line, have):
        taken, any_found = set(have), False
        for key, quoted, plain in PAIR.findall(line or ""):
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key):
                continue
            any_found = True
            value = plain
            if quoted:
                try:
                    value = json.loads(f'"{quoted}"')
                except ValueError:
                    value = ""
            _add(have, key, value, taken)
        return have if any_found else have | {ERROR: "LogfmtParserErr"}

    return _each(lines, labels, parse)


@F.pandas_udf(UNPACKED)
def unpacked(lines: pd.Series, labels: pd.Series) -> pd.DataFrame:
    out = []
    for line, have in zip(lines, labels):
        have, found = dict(have or {}), _object(line)
        if found is None or not isinstance(found.get("_entry"), str):
            out.append((line, have | {ERROR: "UnpackParserErr"}))
            continue
        taken = set(have)
        for key, value in found.items():
            if key != "_entry" and not isinstance(value, (dict, list)):
                _add(have, _name(key), _scalar(value), taken)
        out.append((found["_entry"], have))
    return pd.DataFrame(out, columns=["line", "labels"])

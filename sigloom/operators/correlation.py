"""Correlation: from a trace, resource or attribute to the records of every signal that carry it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 1000
#: Where a record is; also the order of results, and the cursor.
ADDRESS = ["tenant", "signal", "partition", "offset"]


def fingerprint(kind: str, key: Column, value: Column) -> Column:
    """Typed identity of an attribute: equal renderings of different types differ."""
    return F.sha2(F.concat_ws("\x1f", key, F.lit(kind), value), 256)


def _rows(df: DataFrame, kind: str, keys: Column) -> DataFrame:
    return df.select("tenant", F.lit(kind).alias("key_type"), keys.alias("key"), "signal", "partition", "offset", "timestamp").filter("key <> ''")


def _attributes(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    have = [c for c in columns if c in df.columns]
    return [_rows(df.select("*", F.explode(c).alias("_k", "_v")), "attribute", fingerprint("string", F.col("_k"), F.col("_v"))) for c in have]


def postings(logs: DataFrame | None = None, spans: DataFrame | None = None, points: DataFrame | None = None, links: DataFrame | None = None, exemplars: DataFrame | None = None) -> DataFrame:
    """(tenant, key_type, key, signal, partition, offset, timestamp) of everything a record can be found by."""
    parts = []
    for df in (logs, spans, points, links, exemplars):
        if df is None:
            continue
        for column, kind in (("trace_id", "trace"), ("linked_trace_id", "trace"), ("resource_id", "resource"), ("scope_id", "scope")):
            if column in df.columns:
                parts.append(_rows(df, kind, F.col(column)))
        parts += _attributes(df, ["attributes", "filtered_attributes", "resource_attributes", "scope_attributes", "metadata"])
    return reduce(DataFrame.unionByName, parts)


def lookup(found: DataFrame, keys: list[tuple[str, str]], signal: str | None = None, start: int | None = None, end: int | None = None, after: tuple | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Records that carry all keys, by address; times are inclusive, `after` is an address to go on from. No keys find nothing."""
    if not keys:
        return found.limit(0).select(*ADDRESS)
    wanted = reduce(lambda a, b: a | b, [(F.col("key_type") == t) & (F.col("key") == k) for t, k in keys])
    rows = found.filter(wanted)
    if signal is not None:
        rows = rows.filter(F.col("signal") == signal)
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= start)
    if end is not None:
        rows = rows.filter(F.col("timestamp") <= end)
    every = rows.groupBy("tenant", "signal", "partition", "offset").agg(F.countDistinct("key_type", "key").alias("n")).filter(F.col("n") == len(set(keys)))
    if after is not None:
        kinds = dict(every.dtypes)
        every = every.filter(F.struct(*ADDRESS) > F.struct(*[F.lit(a).cast(kinds[c]) for c, a in zip(ADDRESS, after)]))
    out = every.orderBy(*ADDRESS).select(*ADDRESS)
    return out if limit is None else out.limit(limit)


def page(found: DataFrame, keys: list[tuple[str, str]], limit: int = DEFAULT_LIMIT, after: tuple | None = None, **bounds) -> tuple[list, tuple | None]:
    """A page of lookup(), at most `limit` records, and the cursor to go on with if there are more."""
    rows = lookup(found, keys, after=after, limit=limit + 1, **bounds).collect()
    return rows[:limit], tuple(rows[limit - 1]) if len(rows) > limit else None

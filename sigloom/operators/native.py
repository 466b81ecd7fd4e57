"""Native lookups: spans and metric points by their keys, in offset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _equal(df: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def _holding(column: str, wanted: dict[str, str] | None) -> Column:
    out = F.lit(True)
    for key, value in (wanted or {}).items():
        out &= F.coalesce(F.try_element_at(F.col(column), F.lit(key)) == value, F.lit(False))
    return out


def _page(df: DataFrame, order: list[str], after: int | None, limit: int | None) -> DataFrame:
    df = df if after is None else df.filter(F.col("offset") >= after)
    df = df.orderBy(*order)
    return df if limit is None else df.limit(max(limit, 1))


def spans(df: DataFrame, tenant: str | None = None, trace_id: str | None = None, span_id: str | None = None, name: str | None = None, attributes: dict[str, str] | None = None, resource: dict[str, str] | None = None, start: int | None = None, end: int | None = None, min_duration: int | None = None, first_offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Spans that overlap [start, end): they end at start or later and start before end."""
    df = _equal(df, tenant=tenant, trace_id=trace_id, span_id=span_id, name=name)
    df = df.filter(_holding("attributes", attributes) & _holding("resource_attributes", resource))
    if start is not None:
        df = df.filter(F.col("end_timestamp") >= start)
    if end is not None:
        df = df.filter(F.col("timestamp") < end)
    if min_duration is not None:
        df = df.filter(F.col("duration_nanos") >= min_duration)
    return _page(df, ["offset"], first_offset, limit)


def points(df: DataFrame, tenant: str | None = None, series_id: str | None = None, name: str | None = None, labels: dict[str, str] | None = None, start: int | None = None, end: int | None = None, first_offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Points of [start, end], both ends included, in order of time."""
    df = _equal(df, tenant=tenant, series_id=series_id, name=name).filter(_holding("labels", labels))
    if start is not None:
        df = df.filter(F.col("timestamp") >= start)
    if end is not None:
        df = df.filter(F.col("timestamp") <= end)
    return _page(df, ["timestamp", "offset"], first_offset, limit)


def points_at(df: DataFrame, timestamps: list[int], tenant: str | None = None, series_id: str | None = None) -> DataFrame:
    """The points at exactly these times; the times are part of the request."""
    return _equal(df, tenant=tenant, series_id=series_id).filter(F.col("timestamp").isin(sorted(set(timestamps))) if timestamps else F.lit(False))


def label_names(points: DataFrame) -> DataFrame:
    """Names of all labels, __name__ among them."""
    return points.select(F.explode(F.concat(F.array(F.lit("__name__")), F.map_keys("labels"))).alias("name")).distinct()


def exemplars(found: DataFrame, name: str, labels: dict[str, str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Exemplars of a metric's series in [start, end]."""
    found = found.filter((F.col("name") == name) & _holding("labels", labels))
    if start is not None:
        found = found.filter(F.col("timestamp") >= start)
    if end is not None:
        found = found.filter(F.col("timestamp") <= end)
    return found


def deletions(requests: DataFrame, tenant: str = "default") -> list[tuple[str, int, int]]:
    """(query, start, end) of a tenant's open delete requests (tenant, request_id, query, start, end, status), for logql.deleted()."""
    rows = requests.filter((F.col("tenant") == tenant) & (F.col("status") != "cancelled")).orderBy("request_id").select("query", "start", "end").collect()
    return [tuple(r) for r in rows]


def cancelled(requests: DataFrame, tenant: str, request_id: str) -> DataFrame:
    """The requests with one of them cancelled; unknown ids change nothing."""
    hit = (F.col("tenant") == tenant) & (F.col("request_id") == request_id)
    return requests.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))

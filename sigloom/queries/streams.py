"""Streaming jobs, run over bounded inputs; and rollups that streams keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.catalog import register
from sigloom.operators import rollup
from sigloom.sources import relations as R
from sigloom.streaming import live
from sigloom.streaming.run import drain, stream_of


def streamed(spark, sf_dir, source):
    """A relation adapter over the event stream."""
    return source(spark, sf_dir, stream_of(spark, sf_dir, "events")).withColumn("ts", F.timestamp_micros(F.expr("timestamp DIV 1000")))


@register("stream_tail", f"WITH {R.LOGS_SQL} SELECT off AS offset, message AS line FROM logs WHERE event_type = 'error' AND contains(message, 'user=1')")
def stream_tail(spark, sf_dir):
    return drain(live.tail(streamed(spark, sf_dir, R.logs).drop("ts"), '{event_type="error"} |= "user=1"').select("offset", "line"))


@register("stream_minute_counts", f"WITH {R.LOGS_SQL} SELECT CAST(ts_ns // 60000000000 AS BIGINT) AS minute, sev_text AS severity_text, count(*) AS n FROM logs GROUP BY 1, 2")
def stream_minute_counts(spark, sf_dir):
    counts = live.minute_counts(streamed(spark, sf_dir, R.logs))
    return drain(counts.select((F.unix_micros("minute") / 60_000_000).cast("long").alias("minute"), "severity_text", "n"), "complete")


@register(
    "stream_in_order",
    f"""WITH {R.GAUGE_SQL}, s AS (SELECT 'event_value/' || event_type || '/' || usr AS series_id, ts_ns - CASE off % 9 WHEN 0 THEN 900000000000 WHEN 4 THEN 300000000000 ELSE 0 END AS ts, off, value FROM points),
    l AS (SELECT *, max(ts) OVER (PARTITION BY series_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM s),
    k AS (SELECT *, coalesce(latest - ts > 600000000000, false) AS late FROM l),
    o AS (SELECT *, lag(off) OVER (PARTITION BY series_id, ts, late ORDER BY off) AS po, lag(value) OVER (PARTITION BY series_id, ts, late ORDER BY off) AS pv FROM k),
    d AS (SELECT *, CASE WHEN late THEN 'rejected' WHEN po IS NOT NULL AND pv = value THEN 'duplicate' WHEN po IS NOT NULL THEN 'replaced' WHEN ts < latest THEN 'out_of_order' ELSE 'inserted' END AS outcome FROM o)
    SELECT 'default' AS tenant, series_id, ts AS timestamp, off AS offset, round(value, 4) AS value, round(coalesce(sum(CASE WHEN outcome NOT IN ('rejected', 'duplicate') THEN value END) OVER (PARTITION BY series_id ORDER BY off), 0), 4) AS cumulative, outcome FROM d""",
)
def stream_in_order(spark, sf_dir):
    late = F.when(F.col("offset") % 9 == 0, 900_000_000_000).when(F.col("offset") % 9 == 4, 300_000_000_000).otherwise(0)
    points = streamed(spark, sf_dir, R.gauge_points).withColumn("timestamp", F.col("timestamp") - late)
    return drain(live.in_order(points).select("tenant", "series_id", "timestamp", "offset", F.round("value", 4).alias("value"), F.round("cumulative", 4).alias("cumulative"), "outcome"))


@register(
    "stream_sealed_traces",
    f"""WITH {R.LOGS_SQL}, g AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY trace_id ORDER BY ts_ns) < 7200000000000 THEN 0 ELSE 1 END AS opens FROM logs),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY trace_id ORDER BY ts_ns, off ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT trace_id, count(*) AS spans, min(ts_ns) AS start_timestamp, max(ts_ns + 5) AS end_timestamp FROM s GROUP BY trace_id, n HAVING max(ts_ns) + 7200000000000 <= (SELECT max(ts_ns) FROM logs) - 900000000000""",
)
def stream_sealed_traces(spark, sf_dir):
    spans = streamed(spark, sf_dir, R.logs).withColumn("end_timestamp", F.col("timestamp") + 5)
    return drain(live.sealed_traces(spans, "2 hours"))


@register("stream_without_retries", "SELECT event_id AS offset FROM events")
def stream_without_retries(spark, sf_dir):
    logs = streamed(spark, sf_dir, R.logs).select("ts", "offset")
    return drain(live.without_retries(logs.union(logs), ["offset"]).select("offset"))


@register("rollup_merge", f"WITH {R.GAUGE_SQL} SELECT 'event_value/' || event_type || '/' || usr AS series_id, round(sum(value), 4) AS total, max(off) AS offset, count(*) AS points FROM points GROUP BY 1")
def rollup_merge(spark, sf_dir):
    points = R.gauge_points(spark, sf_dir).select("tenant", "series_id", "offset", "value")
    first = live.merge_rollup(points.filter("offset < 6000"), None)
    return live.merge_rollup(points.filter("offset >= 4000"), first).withColumn("total", F.round("total", 4)).drop("tenant")


@register("usage_counters", "SELECT event_type AS feature, CAST(date_trunc('month', ts) AS VARCHAR) AS month, count(*) AS n FROM events GROUP BY 1, 2")
def usage_counters(spark, sf_dir):
    events = R.table(spark, sf_dir, "events").withColumnRenamed("event_type", "feature")
    return rollup.usage(events).withColumn("month", F.date_format("month", "yyyy-MM-dd HH:mm:ss"))

"""The fixed relations over the star-schema tables, and their DuckDB twins for the oracles.

Only base tables are read and every expression is a built-in, so filters and
columns reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import labels as L
from sigloom.operators.winners import winning_spans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_id(number: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), width, "0")


def no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def logs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, message: Column | None = None) -> DataFrame:
    """Log records from `events`: one line `type=… user=… cents=…` each, or another column of the table."""
    e = table(spark, sf_dir, "events") if events is None else events
    error = F.col("event_type") == "error"
    line = F.concat(F.lit("type="), "event_type", F.lit(" user="), "user_id", F.lit(" cents="), F.round(F.col("value") * 100).cast("long")) if message is None else message
    user = (F.col("user_id") % 10).cast("string")
    return e.select(
        F.lit("default").alias("tenant"),
        F.lit("logs").alias("signal"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
        F.when(error, 17).otherwise(9).alias("severity_number"),
        F.when(error, "ERROR").otherwise("INFO").alias("severity_text"),
        line.alias("message"),
        L.make(event_type=F.col("event_type"), user=user).alias("labels"),
        L.make(k=F.get_json_object("props", "$.k")).alias("metadata"),
        no_map().alias("attributes"),
        L.make(**{"service.name": F.concat(F.lit("svc-"), user)}).alias("resource_attributes"),
        no_map().alias("scope_attributes"),
        hex_id(F.col("user_id"), 32).alias("trace_id"),
        hex_id(F.col("event_id"), 16).alias("span_id"),
        F.concat(F.lit("r"), user).alias("resource_id"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records from `documents`, a second apart, for searches over prose."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit("default").alias("tenant"),
        F.lit("logs").alias("signal"),
        F.lit(0).alias("partition"),
        F.col("doc_id").alias("offset"),
        (F.col("doc_id") * 1_000_000_000).alias("timestamp"),
        F.lit(9).alias("severity_number"),
        F.lit("INFO").alias("severity_text"),
        F.col("text").alias("message"),
        L.make(lang=F.col("lang"), source=F.col("source")).alias("labels"),
        no_map().alias("metadata"),
        no_map().alias("attributes"),
        no_map().alias("resource_attributes"),
        no_map().alias("scope_attributes"),
        F.lit(None).cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("resource_id"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each order: its root span is the order, its children the lines."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    root = o.select(
        hex_id(F.col("o_orderkey") + 1, 32).alias("trace_id"),
        F.lpad(F.lit("1"), 16, "0").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("order").alias("name"),
        start.alias("timestamp"),
        F.lit(100_000_000_000).alias("duration_nanos"),
        F.lit(2).alias("kind"),
        F.lit(0).alias("status_code"),
        L.make(priority=F.col("o_orderpriority"), status=F.col("o_orderstatus")).alias("attributes"),
        F.lit("shop").alias("service"),
        F.col("o_orderkey").alias("offset"),
    )
    begun = F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000
    child = l.select(
        hex_id(F.col("l_orderkey") + 1, 32).alias("trace_id"),
        F.lpad(F.lower(F.hex(F.col("l_linenumber") + 1)), 16, "0").alias("span_id"),
        F.lpad(F.lit("1"), 16, "0").alias("parent_span_id"),
        F.lit("line").alias("name"),
        begun.alias("timestamp"),
        (F.col("l_quantity").cast("long") * 1_000_000_000).alias("duration_nanos"),
        F.lit(3).alias("kind"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("status_code"),
        L.make(flag=F.col("l_returnflag"), quantity=F.col("l_quantity").cast("long").cast("string")).alias("attributes"),
        F.concat(F.lit("wh-"), (F.col("l_suppkey") % 5)).alias("service"),
        (F.lit(1_000_000_000) + F.col("l_orderkey") * 1_000_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long") * 100 + F.col("l_suppkey") % 100).alias("offset"),
    )
    every = root.unionByName(child)
    return winning_spans(
        every.select(
            F.lit("default").alias("tenant"),
            F.lit("spans").alias("signal"),
            F.lit(0).alias("partition"),
            "*",
            (F.col("timestamp") + F.col("duration_nanos")).alias("end_timestamp"),
            L.make(**{"service.name": F.col("service")}).alias("resource_attributes"),
        )
    )


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each conversation, each turn the child of the one before: deep chains for ancestry."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.lit("default").alias("tenant"),
        F.lit("spans").alias("signal"),
        F.lit(0).alias("partition"),
        hex_id(F.col("conv_id") + 1, 32).alias("trace_id"),
        hex_id(F.col("turn") + 1, 16).alias("span_id"),
        F.when(F.col("turn") > 0, hex_id(F.col("turn"), 16)).alias("parent_span_id"),
        F.col("role").alias("name"),
        (F.col("conv_id") * 1_000_000_000_000 + F.col("turn") * 1_000_000_000).alias("timestamp"),
        (F.char_length("text") * 1_000_000).cast("long").alias("duration_nanos"),
        F.lit(1).alias("kind"),
        F.lit(0).alias("status_code"),
        L.make(role=F.col("role")).alias("attributes"),
        F.lit("chat").alias("service"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("offset"),
        (F.col("conv_id") * 1_000_000_000_000 + F.col("turn") * 1_000_000_000 + F.char_length("text") * 1_000_000).alias("end_timestamp"),
        L.make(**{"service.name": F.lit("chat")}).alias("resource_attributes"),
    )


def nested_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each order with an event and a link for each of its lines, for readers.span_events() and span_links()."""
    line = F.struct("l_linenumber", "l_returnflag", "l_suppkey", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    at = F.unix_micros(F.get("l", F.lit(0))["l_shipdate"].cast("timestamp")) * 1000
    return orders.select(
        F.lit("default").alias("tenant"),
        F.lit(0).alias("partition"),
        F.col("l_orderkey").alias("offset"),
        at.alias("timestamp"),
        hex_id(F.col("l_orderkey") + 1, 32).alias("trace_id"),
        F.lpad(F.lit("1"), 16, "0").alias("span_id"),
        F.transform("l", lambda x: F.struct((F.unix_micros(x["l_shipdate"].cast("timestamp")) * 1000).alias("timestamp"), F.concat(F.lit("shipped-"), x["l_returnflag"]).alias("name"), no_map().alias("attributes"))).alias("events"),
        F.transform("l", lambda x: F.struct(hex_id(x["l_suppkey"] + 1, 32).alias("trace_id"), F.lpad(F.lit("1"), 16, "0").alias("span_id"), F.lit("").alias("trace_state"), no_map().alias("attributes"))).alias("links"),
    )


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exemplar for each event: the trace it was measured in, at the point of its series."""
    e = logs(spark, sf_dir)
    return e.select("tenant", F.lit("metrics").alias("signal"), "partition", "offset", "timestamp", F.lit(0).alias("ordinal"), F.concat(F.lit("event_value/"), F.col("labels")["event_type"], F.lit("/"), F.col("labels")["user"]).alias("series_id"), F.lit("event_value").alias("name"), "trace_id", "span_id", "labels", "attributes")


def gauge_points(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Points of the gauge `event_value`, a series for each event type and user group."""
    e = table(spark, sf_dir, "events") if events is None else events
    user = (F.col("user_id") % 10).cast("string")
    return e.select(
        F.lit("default").alias("tenant"),
        F.lit("metrics").alias("signal"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
        F.concat(F.lit("event_value/"), "event_type", F.lit("/"), user).alias("series_id"),
        F.lit("event_value").alias("name"),
        F.lit("gauge").alias("metric_kind"),
        F.lit("double").alias("value_type"),
        F.lit("1").alias("unit"),
        F.lit("Value of an event").alias("description"),
        L.make(event_type=F.col("event_type"), user=user).alias("labels"),
        F.col("value"),
        F.concat(F.lit("r"), user).alias("resource_id"),
    )


def counter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the counter `events_total`: the count of a type's events, starting anew after every 50."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return e.select(
        F.lit("default").alias("tenant"),
        F.lit("metrics").alias("signal"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
        F.concat(F.lit("events_total/"), "event_type").alias("series_id"),
        F.lit("events_total").alias("name"),
        F.lit("sum").alias("metric_kind"),
        F.lit("double").alias("value_type"),
        F.lit("1").alias("unit"),
        F.lit("Events so far").alias("description"),
        L.make(event_type=F.col("event_type")).alias("labels"),
        (F.row_number().over(order) % 50 + 1).cast("double").alias("value"),
        F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("resource_id"),
    )


#: DuckDB twins, as common table expressions.
LOGS_SQL = """logs AS (SELECT event_id AS off, epoch_us(ts) * 1000 AS ts_ns, event_type, CAST(user_id % 10 AS VARCHAR) AS usr, json_extract_string(props, '$.k') AS k,
  CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS sev, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS sev_text,
  'type=' || event_type || ' user=' || user_id || ' cents=' || CAST(round(value * 100) AS BIGINT) AS message,
  lpad(lower(to_hex(user_id)), 32, '0') AS trace_id, lpad(lower(to_hex(event_id)), 16, '0') AS span_id, user_id, value FROM events)"""
SPANS_SQL = """all_spans AS (SELECT lpad(lower(to_hex(o_orderkey + 1)), 32, '0') AS trace_id, '0000000000000001' AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 'order' AS name,
   epoch_us(o_orderdate) * 1000 AS ts, CAST(100000000000 AS BIGINT) AS duration, 2 AS kind, 0 AS status, o_orderpriority AS priority, o_orderstatus AS ostatus, NULL AS flag, NULL AS quantity, 'shop' AS service, o_orderkey AS off FROM orders
  UNION ALL SELECT lpad(lower(to_hex(l_orderkey + 1)), 32, '0'), lpad(lower(to_hex(l_linenumber + 1)), 16, '0'), '0000000000000001', 'line', epoch_us(l_shipdate) * 1000, CAST(l_quantity AS BIGINT) * 1000000000, 3,
   CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END, NULL, NULL, l_returnflag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'wh-' || (l_suppkey % 5), 1000000000 + l_orderkey * 1000000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) * 100 + l_suppkey % 100 FROM lineitem),
 spans AS (SELECT trace_id, span_id, arg_max(parent_span_id, k) AS parent_span_id, arg_max(name, k) AS name, arg_max(ts, k) AS ts, arg_max(duration, k) AS duration, arg_max(kind, k) AS kind, arg_max(status, k) AS status,
   arg_max(priority, k) AS priority, arg_max(ostatus, k) AS ostatus, arg_max(flag, k) AS flag, arg_max(quantity, k) AS quantity, arg_max(service, k) AS service, max(off) AS off
  FROM (SELECT *, (off, ts, duration, status, coalesce(flag, ''), service) AS k FROM all_spans) GROUP BY trace_id, span_id)"""
CONVERSATIONS_SQL = """cspans AS (SELECT conv_id, turn, role, conv_id * 1000000000000 + turn * 1000000000 AS ts, length(text) * 1000000 AS duration FROM conversations)"""
GAUGE_SQL = """points AS (SELECT event_id AS off, epoch_us(ts) * 1000 AS ts_ns, epoch_us(ts) // 1000 AS ts_ms, event_type, CAST(user_id % 10 AS VARCHAR) AS usr, value FROM events)"""
COUNTER_SQL = """points AS (SELECT event_id AS off, epoch_us(ts) * 1000 AS ts_ns, epoch_us(ts) // 1000 AS ts_ms, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) % 50 + 1 AS DOUBLE) AS value FROM events)"""

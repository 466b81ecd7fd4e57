"""Wire formats: bodies made of the tables, read by the readers; results in response encodings; native lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.catalog import register
from sigloom.functions import labels as L
from sigloom.operators import native, search
from sigloom.plans import logql, promql, traceql
from sigloom.sinks import encode
from sigloom.sources import readers
from sigloom.sources import relations as R

L_SQL = f"WITH {R.LOGS_SQL} "
#: Records of a body.
BODY = 100


def _value(**typed):
    return F.struct(*[c.alias(n) for n, c in typed.items()])


def _attribute(key: str, **typed):
    """An attribute as JSON text, so that attributes of several types stand in one list."""
    return F.to_json(F.struct(F.lit(key).alias("key"), _value(**typed).alias("value")))


def _listed(*attributes):
    return F.concat(F.lit("["), F.concat_ws(",", *attributes), F.lit("]"))


def _object(**fields):
    """A JSON object of fields that are JSON already."""
    parts = [F.concat(F.lit(f'"{n}":'), c) for n, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _text(column):
    return readers.quoted(column.cast("string"))


def _events(spark, sf_dir):
    return R.table(spark, sf_dir, "events").withColumn("body", F.expr(f"event_id DIV {BODY}")).withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)


def _joined(rows, key, order, piece):
    """The pieces of a key as one JSON list, in order."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), piece.alias("p")))), lambda x: x["p"]), ","), F.lit("]"))


# Readers


@register("read_pushed_logs", f"{L_SQL} SELECT off // {BODY} * {BODY} + row_number() OVER (PARTITION BY off // {BODY} ORDER BY event_type, off) - 1 AS offset, ts_ns AS timestamp, message, event_type, k FROM logs")
def read_pushed_logs(spark, sf_dir):
    logs = R.logs(spark, sf_dir).withColumn("body", F.expr(f"offset DIV {BODY}"))
    line = F.concat(F.lit("["), _text(F.col("timestamp")), F.lit(","), _text(F.col("message")), F.lit(","), F.to_json("metadata"), F.lit("]"))
    streams = logs.groupBy("body", F.col("labels")["event_type"].alias("kind")).agg(_joined(logs, "body", F.col("offset"), line).alias("lines"))
    bodies = streams.groupBy("body").agg(_joined(streams, "body", F.col("kind"), _object(stream=_object(event_type=_text(F.col("kind"))), values=F.col("lines"))).alias("s"))
    found = readers.pushed_logs(bodies.select((F.col("body") * BODY).alias("offset"), _object(streams=F.col("s")).alias("body")))
    return found.select("offset", "timestamp", "message", F.col("labels")["event_type"].alias("event_type"), F.col("metadata")["k"].alias("k"))


@register("read_container_logs", f"{L_SQL} SELECT off AS offset, ts_ns + off % 1000 AS timestamp, message || chr(10) AS message, CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream FROM logs")
def read_container_logs(spark, sf_dir):
    logs = R.logs(spark, sf_dir)
    micros = F.timestamp_micros(F.expr("timestamp DIV 1000"))
    time = F.concat(F.date_format(micros, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad((F.col("offset") % 1000).cast("string"), 3, "0"), F.lit("Z"))
    body = F.to_json(F.struct(F.concat("message", F.lit("\n")).alias("log"), F.when(F.col("labels")["event_type"] == "error", "stderr").otherwise("stdout").alias("stream"), time.alias("time")))
    found = readers.container_logs(logs.select("offset", body.alias("body")))
    return found.select("offset", "timestamp", "message", F.col("metadata")["stream"].alias("stream"))


@register(
    "read_otlp_logs",
    f"""{L_SQL} SELECT off // {BODY} * {BODY} + row_number() OVER (PARTITION BY off // {BODY} ORDER BY usr, off) - 1 AS offset, ts_ns AS timestamp, CAST(NULL AS BIGINT) AS observed, message, sev AS severity_number, trace_id, 'svc-' || usr AS service,
    CAST(user_id AS VARCHAR) AS n, CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS bad, '["' || event_type || '",' || usr || ']' AS list, '{{"user":' || usr || ',"in":{{"kind":"' || event_type || '"}}}}' AS nested, 'last' AS twice FROM logs""",
)
def read_otlp_logs(spark, sf_dir):
    e = R.logs(spark, sf_dir).withColumn("body", F.expr(f"offset DIV {BODY}")).withColumn("user", F.col("labels")["user"]).withColumn("kind", F.col("labels")["event_type"])
    kind, user = F.col("kind"), F.col("user")
    attributes = _listed(
        _attribute("n", intValue=F.conv("trace_id", 16, 10)),
        _attribute("bad", boolValue=kind == "error"),
        _attribute("list", arrayValue=F.struct(F.array(F.struct(kind.alias("stringValue"), F.lit(None).cast("string").alias("intValue")), F.struct(F.lit(None).cast("string").alias("stringValue"), user.alias("intValue"))).alias("values"))),
        F.concat(F.lit('{"key":"nested","value":{"kvlistValue":{"values":[{"key":"user","value":{"intValue":"'), user, F.lit('"}},{"key":"in","value":{"kvlistValue":{"values":[{"key":"kind","value":{"stringValue":"'), kind, F.lit('"}}]}}}]}}}')),
        _attribute("twice", stringValue=F.lit("first")),
        _attribute("twice", stringValue=F.lit("last")),
    )
    record = _object(timeUnixNano=_text(F.col("timestamp")), observedTimeUnixNano=F.lit('"0"'), severityNumber=F.col("severity_number").cast("string"), body=F.to_json(_value(stringValue=F.col("message"))), traceId=_text(F.col("trace_id")), attributes=attributes)
    groups = e.groupBy("body", "user").agg(_joined(e, "body", F.col("offset"), record).alias("records"))
    resource = _object(resource=_object(attributes=_listed(_attribute("service.name", stringValue=F.concat(F.lit("svc-"), "user")))), scopeLogs=F.concat(F.lit('[{"scope":{"name":"lib"},"logRecords":'), F.col("records"), F.lit("}]")))
    bodies = groups.groupBy("body").agg(_joined(groups, "body", F.col("user"), resource).alias("r"))
    found = readers.otlp_logs(bodies.select((F.col("body") * BODY).alias("offset"), _object(resourceLogs=F.col("r")).alias("body")))
    a = F.col("attributes")
    return found.select("offset", "timestamp", F.col("observed_timestamp").alias("observed"), "message", "severity_number", "trace_id", F.col("resource_attributes")["service.name"].alias("service"), *[a[n].alias(n) for n in ("n", "bad", "list", "nested", "twice")])


def _span_bodies(spark, sf_dir):
    """A body for each order: its lines are spans with an event each, and a link for every second one."""
    l = R.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_shipdate").alias("ship"), F.max("l_suppkey").alias("supp"))
    start = F.unix_micros(F.col("ship").cast("timestamp")) * 1000
    event = F.concat(F.lit('[{"timeUnixNano":'), _text(start + 5), F.lit(',"name":"ship","attributes":'), _listed(_attribute("flag", stringValue=F.col("flag"))), F.lit("}]"))
    link = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('[{"traceId":'), _text(R.hex_id(F.col("supp") + 1, 32)), F.lit(',"spanId":"00000000000000aa"}]'))).otherwise("[]")
    span = _object(
        traceId=_text(R.hex_id(F.col("l_orderkey") + 1, 32)), spanId=_text(R.hex_id(F.col("l_linenumber") + 1, 16)), name=F.lit('"line"'), kind=F.lit("3"), startTimeUnixNano=_text(start), endTimeUnixNano=_text(start + F.col("l_linenumber") * 1000),
        attributes=_listed(_attribute("supp", intValue=F.col("supp").cast("string"))), events=event, links=link, status=F.concat(F.lit('{"code":'), F.when(F.col("flag") == "R", "2").otherwise("1"), F.lit("}")),
    )
    per = l.groupBy("l_orderkey").agg(_joined(l, "l_orderkey", F.col("l_linenumber"), span).alias("s"))
    body = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeSpans":[{"scope":{"name":"lib","version":"2"},"spans":'), F.col("s"), F.lit("}]}]}"))
    return per.select((F.col("l_orderkey") * 10).alias("offset"), body.alias("body"))


LINES_SQL = """lines AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, epoch_us(max(l_shipdate)) * 1000 AS ts, max(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2),
 numbered AS (SELECT *, l_orderkey * 10 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS off, lpad(lower(to_hex(l_orderkey + 1)), 32, '0') AS trace_id, lpad(lower(to_hex(l_linenumber + 1)), 16, '0') AS span_id FROM lines)"""


@register("read_otlp_spans", f"WITH {LINES_SQL} SELECT off AS offset, trace_id, span_id, CAST(NULL AS VARCHAR) AS parent_span_id, ts AS timestamp, CAST(l_linenumber AS BIGINT) * 1000 AS duration_nanos, CASE WHEN flag = 'R' THEN 2 ELSE 1 END AS status_code, CAST(supp AS VARCHAR) AS supp, 'shop' AS service FROM numbered")
def read_otlp_spans(spark, sf_dir):
    found = readers.otlp_spans(_span_bodies(spark, sf_dir))
    return found.select("offset", "trace_id", "span_id", "parent_span_id", "timestamp", "duration_nanos", "status_code", F.col("attributes")["supp"].alias("supp"), F.col("resource_attributes")["service.name"].alias("service"))


@register("relation_span_events", f"WITH {LINES_SQL} SELECT off AS offset, 0 AS ordinal, trace_id, span_id, ts AS parent_timestamp, ts + 5 AS timestamp, 'ship' AS name, flag FROM numbered")
def relation_span_events(spark, sf_dir):
    found = readers.span_events(readers.otlp_spans(_span_bodies(spark, sf_dir)))
    return found.select("offset", "ordinal", "trace_id", "span_id", "parent_timestamp", "timestamp", "name", F.col("attributes")["flag"].alias("flag"))


@register("relation_span_links", f"WITH {LINES_SQL} SELECT off AS offset, 0 AS ordinal, trace_id, span_id, lpad(lower(to_hex(supp + 1)), 32, '0') AS linked_trace_id, '00000000000000aa' AS linked_span_id FROM numbered WHERE l_linenumber % 2 = 0")
def relation_span_links(spark, sf_dir):
    found = readers.span_links(readers.otlp_spans(_span_bodies(spark, sf_dir)))
    return found.select("offset", "ordinal", "trace_id", "span_id", "linked_trace_id", "linked_span_id")


@register("traceql_event_fields", f"WITH {LINES_SQL} SELECT trace_id, span_id FROM numbered WHERE flag = 'R'")
def traceql_event_fields(spark, sf_dir):
    return traceql.selected(readers.otlp_spans(_span_bodies(spark, sf_dir)), traceql.parse('{ event:name = "ship" && event.flag = "R" }')).select("trace_id", "span_id")


@register("traceql_link_fields", f"WITH {LINES_SQL} SELECT trace_id, span_id FROM numbered WHERE l_linenumber % 2 = 0 AND supp = 7")
def traceql_link_fields(spark, sf_dir):
    return traceql.selected(readers.otlp_spans(_span_bodies(spark, sf_dir)), traceql.parse('{ link:traceID = "00000000000000000000000000000008" }')).select("trace_id", "span_id")


def _metric_bodies(spark, sf_dir):
    """A body for each event, with a metric of every kind."""
    e = _events(spark, sf_dir)
    kind, n, v = F.col("event_type"), F.col("event_id"), F.col("value")
    point = [F.concat(F.lit('"timeUnixNano":'), _text(F.col("ns"))), F.concat(F.lit('"attributes":'), _listed(_attribute("event.type", stringValue=kind)))]
    exemplar = F.concat(F.lit('"exemplars":[{"timeUnixNano":'), _text(F.col("ns") - 1), F.lit(',"asInt":"3","traceId":'), _text(R.hex_id(F.col("user_id"), 32)), F.lit(',"filteredAttributes":'), _listed(_attribute("who", stringValue=F.col("user_id").cast("string"))), F.lit("}]"))

    def metric(name: str, field: str, extra: str, *parts):
        return F.concat(F.lit(f'{{"name":"{name}","unit":"1","{field}":{{{extra}"dataPoints":[{{'), F.concat_ws(",", *point, *parts), F.lit("}]}}"))

    metrics = F.concat_ws(
        ",",
        metric("g", "gauge", "", F.concat(F.lit('"asDouble":'), (F.round(v * 100).cast("long") / 4).cast("string"))),
        metric("c", "sum", '"aggregationTemporality":2,"isMonotonic":true,', F.concat(F.lit('"asInt":'), _text(n)), exemplar),
        metric("h", "histogram", '"aggregationTemporality":1,', F.lit('"count":"3","sum":4.5,"bucketCounts":["1","2"],"explicitBounds":[1.5]')),
        metric("e", "exponentialHistogram", '"aggregationTemporality":1,', F.lit('"count":"3","scale":2,"zeroCount":"1","positive":{"offset":4,"bucketCounts":["2"]}')),
        metric("s", "summary", "", F.lit('"count":"3","sum":4.5,"quantileValues":[{"quantile":0.5,"value":1.5}]')),
    )
    body = F.concat(F.lit('{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeMetrics":[{"metrics":['), metrics, F.lit("]}]}]}"))
    return e.select((n * 10).alias("offset"), body.alias("body"))


KINDS_SQL = """(VALUES (0, 'g', 'gauge', 'double', NULL, NULL, NULL), (1, 'c', 'sum', 'integer', 2, true, NULL), (2, 'h', 'histogram', 'explicit_histogram', 1, NULL, '{"count":"3","sum":4.5,"bucketCounts":["1","2"],"explicitBounds":[1.5]}'),
 (3, 'e', 'exponential_histogram', 'exponential_histogram', 1, NULL, '{"count":"3","scale":2,"zeroCount":"1","positive":{"offset":4,"bucketCounts":["2"]}}'), (4, 's', 'summary', 'summary', NULL, NULL, '{"count":"3","sum":4.5,"quantileValues":[{"quantile":0.5,"value":1.5}]}')) k(nth, name, metric_kind, value_type, temporality, monotonic, value_json)"""


@register(
    "read_otlp_points",
    f"""SELECT event_id * 10 + nth AS offset, epoch_us(ts) * 1000 AS timestamp, name, metric_kind, value_type, temporality, monotonic, CASE name WHEN 'c' THEN event_id END AS scalar_integer,
    CASE name WHEN 'c' THEN CAST(event_id AS DOUBLE) WHEN 'g' THEN CAST(round(value * 100) AS BIGINT) / 4 END AS value, value_json, event_type, 'shop' AS service FROM events, {KINDS_SQL}""",
)
def read_otlp_points(spark, sf_dir):
    found = readers.otlp_points(_metric_bodies(spark, sf_dir))
    return found.select("offset", "timestamp", "name", "metric_kind", "value_type", "temporality", "monotonic", "scalar_integer", "value", "value_json", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["service_name"].alias("service"))


@register("relation_metric_exemplars", "SELECT event_id * 10 + 1 AS offset, 0 AS ordinal, 'c' AS name, epoch_us(ts) * 1000 - 1 AS timestamp, CAST(3 AS DOUBLE) AS value, lpad(lower(to_hex(user_id)), 32, '0') AS trace_id, CAST(user_id AS VARCHAR) AS who FROM events")
def relation_metric_exemplars(spark, sf_dir):
    found = readers.metric_exemplars(readers.otlp_points(_metric_bodies(spark, sf_dir)))
    return found.select("offset", "ordinal", "name", "timestamp", "value", "trace_id", F.col("attributes")["who"].alias("who"))


@register("prom_exemplars", "SELECT epoch_us(ts) * 1000 - 1 AS timestamp, lpad(lower(to_hex(user_id)), 32, '0') AS trace_id FROM events WHERE event_type = 'error'")
def prom_exemplars(spark, sf_dir):
    found = readers.metric_exemplars(readers.otlp_points(_metric_bodies(spark, sf_dir)))
    return native.exemplars(found, "c", {"event_type": "error"}).select("timestamp", "trace_id")


@register("prom_label_names", "SELECT * FROM (VALUES ('__name__'), ('event_type'), ('user')) v(name)")
def prom_label_names(spark, sf_dir):
    return native.label_names(R.gauge_points(spark, sf_dir))


# Encodings

DAY = 86_400_000
T0 = 1_704_153_600_000
PROM_COUNT = 'count by (event_type) (last_over_time(event_value[1d]))'
COUNT_SQL = f"c AS (SELECT t, event_type, count(DISTINCT usr) AS n FROM (SELECT {T0} + i * {DAY} AS t FROM range(0, 4) r(i)) JOIN points ON ts_ns > (t - {DAY}) * 1000000 AND ts_ns <= t * 1000000 GROUP BY 1, 2)"


@register("encode_matrix", f"""WITH {R.GAUGE_SQL}, {COUNT_SQL} SELECT '{{"metric":{{"event_type":"' || event_type || '"}},"values":[' || string_agg('[' || (t // 1000) || ',"' || n || '"]', ',' ORDER BY t) || ']}}' AS json FROM c GROUP BY event_type""")
def encode_matrix(spark, sf_dir):
    return encode.matrix(promql.range_query(R.gauge_points(spark, sf_dir), PROM_COUNT, T0, T0 + 3 * DAY, DAY), 1000).select("json")


@register("encode_vector", f"""WITH {R.GAUGE_SQL}, {COUNT_SQL} SELECT '{{"metric":{{"event_type":"' || event_type || '"}},"value":[' || ({T0 + 500} // 1000) || '.5,"' || CASE event_type WHEN 'click' THEN 'NaN' WHEN 'view' THEN '+Inf' ELSE '-Inf' END || '"]}}' AS json FROM (SELECT DISTINCT event_type FROM points WHERE ts_ns > ({T0 + 500} - {DAY}) * 1000000 AND ts_ns <= {T0 + 500} * 1000000) WHERE event_type IN ('click', 'view', 'error')""")
def encode_vector(spark, sf_dir):
    one = "(count by (event_type) (last_over_time(event_value{event_type=`%s`}[1d])) * 0 + %d) / 0"
    text = " or ".join(one % pair for pair in (("click", 0), ("view", 1), ("error", -1)))
    return encode.vector(promql.instant_query(R.gauge_points(spark, sf_dir), text, T0 + 500), 1000).select("json")


@register(
    "encode_streams",
    f"""{L_SQL}, s AS (SELECT *, '{{"detected_level":"' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'unknown' END || '","event_type":"' || event_type || '","k":"' || k || '","user":"' || usr || '"}}' AS labels FROM logs WHERE event_type = 'error' AND usr = '3' ORDER BY ts_ns DESC, off DESC LIMIT 50)
    SELECT '{{"stream":' || labels || ',"values":[' || string_agg('["' || ts_ns || '","' || message || '"]', ',' ORDER BY ts_ns DESC, off DESC) || ']}}' AS json FROM s GROUP BY labels""",
)
def encode_streams(spark, sf_dir):
    found = logql.stream_query(R.logs(spark, sf_dir), '{event_type="error", user="3"}', 0, 1 << 62, 50)
    return encode.streams(found).select("json")


@register("encode_json_lines", f"""{L_SQL} SELECT '{{"timestamp":' || ts_ns || ',"offset":' || off || ',"trace_id":"' || trace_id || '","parent":null,"labels":{{"event_type":"' || event_type || '","user":"' || usr || '"}}}}' AS json FROM logs""")
def encode_json_lines(spark, sf_dir):
    return encode.json_lines(R.logs(spark, sf_dir).select("timestamp", "offset", "trace_id", F.lit(None).cast("string").alias("parent"), "labels"))


@register(
    "encode_traces",
    f"""WITH {R.SPANS_SQL}, f AS (SELECT trace_id, min(ts) AS start, max(ts + duration) AS stop, count(*) AS n, count(*) FILTER (status = 2) AS bad, coalesce(arg_min(name, (ts, span_id)) FILTER (parent_span_id IS NULL), '') AS root FROM spans WHERE flag = 'R' OR ostatus = 'F' GROUP BY 1 ORDER BY start DESC, trace_id LIMIT 30)
    SELECT '{{"traceID":"' || trace_id || '","rootTraceName":"' || root || '","startTimeUnixNano":"' || start || '","durationMs":' || ((stop - start) // 1000000) || ',"spanCount":' || n || ',"errorCount":' || bad || '}}' AS json FROM f""",
)
def encode_traces(spark, sf_dir):
    return encode.traces(traceql.search(R.spans(spark, sf_dir), '{ span.flag = "R" || span.status = "F" }', limit=30)).select("json")


@register("encode_arrow", f"{L_SQL} SELECT count(*) AS rows FROM logs WHERE event_type = 'error'")
def encode_arrow(spark, sf_dir):
    found = R.logs(spark, sf_dir).filter(F.col("labels")["event_type"] == "error").select("timestamp", "offset", "message", "labels")
    return encode.arrow_streams(found).agg(F.sum("rows").alias("rows"))


def _relations(spark, sf_dir):
    nested = R.nested_spans(spark, sf_dir)
    return {"logs": R.logs(spark, sf_dir), "spans": R.spans(spark, sf_dir), "span_events": readers.span_events(nested), "span_links": readers.span_links(nested), "metric_points": R.gauge_points(spark, sf_dir), "metric_exemplars": R.exemplars(spark, sf_dir)}


EVENTS_SQL = "SELECT l_orderkey AS off, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_suppkey, l_partkey, l_shipdate) - 1 AS n, * FROM lineitem"


def _scan(name: str, pairs: str, sql: str) -> None:
    @register(name, sql)
    def run(spark, sf_dir):
        return search.scan_relations(_relations(spark, sf_dir), [tuple(p.split("=", 1)) for p in pairs.split("&")])


_scan("scan_span_events", "relation=span_events&columns=offset,ordinal,name,timestamp,scope_id&name=shipped-R", f"SELECT off AS offset, CAST(n AS INT) AS ordinal, 'shipped-R' AS name, epoch_us(l_shipdate) * 1000 AS timestamp, CAST(NULL AS VARCHAR) AS scope_id FROM ({EVENTS_SQL}) WHERE l_returnflag = 'R'")
_scan("scan_span_links", "relation=span_links&columns=offset,ordinal,linked_trace_id&offset_start=100&offset_end=900", f"SELECT off AS offset, CAST(n AS INT) AS ordinal, lpad(lower(to_hex(l_suppkey + 1)), 32, '0') AS linked_trace_id FROM ({EVENTS_SQL}) WHERE off >= 100 AND off < 900")
_scan("scan_metric_exemplars", "relation=metric_exemplars&columns=offset,series_id,trace_id&label.user=3", f"{L_SQL} SELECT off AS offset, 'event_value/' || event_type || '/3' AS series_id, trace_id FROM logs WHERE usr = '3'")
_scan("scan_metric_points", "relation=metrics&columns=offset,value&series_id=event_value/click/4", "SELECT event_id AS offset, value FROM events WHERE event_type = 'click' AND user_id % 10 = 4")

# Native lookups

FROM, TO = 1_704_412_800_000_000_000, 1_704_844_800_000_000_000


@register("native_points", f"WITH {R.GAUGE_SQL} SELECT off AS offset, ts_ns AS timestamp FROM points WHERE event_type = 'click' AND ts_ns BETWEEN {FROM} AND {TO} AND off >= 500 ORDER BY ts_ns, off LIMIT 300")
def native_points(spark, sf_dir):
    return native.points(R.gauge_points(spark, sf_dir), "default", name="event_value", labels={"event_type": "click"}, start=FROM, end=TO, first_offset=500, limit=300).select("offset", "timestamp")


@register("native_points_at", f"WITH {R.GAUGE_SQL} SELECT off AS offset FROM points WHERE event_type = 'error' AND usr = '2' AND ts_ns IN (SELECT epoch_us(ts) * 1000 FROM events WHERE event_id % 50 = 2)")
def native_points_at(spark, sf_dir):
    points = R.gauge_points(spark, sf_dir)
    times = [r.timestamp for r in points.filter("offset % 50 = 2").select("timestamp").collect()]
    return native.points_at(points, times, "default", "event_value/error/2").select("offset")


@register("native_spans", f"WITH {R.SPANS_SQL} SELECT trace_id, span_id FROM spans WHERE name = 'line' AND flag = 'R' AND service = 'wh-2' AND ts + duration >= 800000000000000000 AND ts < 820000000000000000 AND duration >= 30000000000")
def native_spans(spark, sf_dir):
    return native.spans(R.spans(spark, sf_dir), "default", name="line", attributes={"flag": "R"}, resource={"service.name": "wh-2"}, start=800_000_000_000_000_000, end=820_000_000_000_000_000, min_duration=30_000_000_000).select("trace_id", "span_id")


@register("delete_requests", f"{L_SQL} SELECT off AS offset FROM logs WHERE NOT (event_type = 'click' AND ts_ns BETWEEN {FROM} AND {TO})")
def delete_requests(spark, sf_dir):
    rows = [("default", "1", '{event_type="click"}', FROM, TO, "received"), ("default", "2", "{}", 0, TO, "received"), ("other", "3", "{}", 0, TO, "received")]
    asked = spark.createDataFrame(rows, "tenant string, request_id string, query string, start bigint, end bigint, status string")
    return logql.deleted(logql.entries(R.logs(spark, sf_dir)), native.deletions(native.cancelled(asked, "default", "2"))).select("offset")


@register("label_map_keys", f"{L_SQL} SELECT DISTINCT unnest(['event_type', 'user']) AS name FROM logs")
def label_map_keys(spark, sf_dir):
    return R.logs(spark, sf_dir).select(F.explode(F.map_keys(L.only(F.col("labels"), ["event_type", "user", "none"]))).alias("name")).distinct()

"""Readers of JSON wire formats: pushed log streams, OTLP logs, traces and metrics, and container log files.

Each takes a table of bodies (`body`, a JSON text; `offset`, the offset of its
first record; optionally `tenant`) and gives rows of the fixed relations. The
structure is read by built-in functions; attribute values, which nest to any
depth, are rendered in Arrow batches. A body that is malformed is an error;
nothing of it is dropped silently. Attribute maps hold rendered text: strings as they are,
numbers and booleans in JSON form, arrays and maps as JSON; the last of equal
keys wins.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attribute lists stay JSON text until they are rendered.
_ATTRIBUTES = "string"
_RESOURCE = f"struct<attributes:{_ATTRIBUTES}>"
_SCOPE = f"struct<name:string,version:string,attributes:{_ATTRIBUTES}>"
_EXEMPLARS = f"array<struct<timeUnixNano:string,asDouble:double,asInt:string,traceId:string,spanId:string,filteredAttributes:{_ATTRIBUTES}>>"
_POINT = f"attributes:{_ATTRIBUTES},startTimeUnixNano:string,timeUnixNano:string,flags:int"
# Field names of the OTLP JSON encoding.
LOGS = f"struct<resourceLogs:array<struct<resource:{_RESOURCE},scopeLogs:array<struct<scope:{_SCOPE},logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:string,attributes:{_ATTRIBUTES},droppedAttributesCount:int,flags:int,traceId:string,spanId:string,eventName:string>>>>>>>"
SPANS = (
    f"struct<resourceSpans:array<struct<resource:{_RESOURCE},scopeSpans:array<struct<scope:{_SCOPE},spans:array<struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{_ATTRIBUTES}>>,links:array<struct<traceId:string,spanId:string,traceState:string,attributes:{_ATTRIBUTES}>>,status:struct<code:int,message:string>>>>>>>>"
)
_NUMBER = f"array<struct<{_POINT},asDouble:double,asInt:string,exemplars:{_EXEMPLARS}>>"
_HISTOGRAM = f"array<struct<{_POINT},count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,min:double,max:double,exemplars:{_EXEMPLARS}>>"
_SPAN_OF_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
_EXPONENTIAL = f"array<struct<{_POINT},count:string,sum:double,scale:int,zeroCount:string,positive:{_SPAN_OF_BUCKETS},negative:{_SPAN_OF_BUCKETS},exemplars:{_EXEMPLARS}>>"
_SUMMARY = f"array<struct<{_POINT},count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>>"
METRICS = (
    f"struct<resourceMetrics:array<struct<resource:{_RESOURCE},scopeMetrics:array<struct<scope:{_SCOPE},metrics:array<struct<name:string,description:string,unit:string,gauge:struct<dataPoints:{_NUMBER}>,sum:struct<dataPoints:{_NUMBER},aggregationTemporality:int,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:{_HISTOGRAM},aggregationTemporality:int>,exponentialHistogram:struct<dataPoints:{_EXPONENTIAL},aggregationTemporality:int>,summary:struct<dataPoints:{_SUMMARY}>>>>>>>>"
)
PUSH = "struct<streams:array<struct<stream:map<string,string>,`values`:array<array<string>>>>>"


def wrong(reason: str, kind: str) -> Column:
    return F.raise_error(F.lit(reason)).cast(kind)


def parsed(bodies: DataFrame, schema: str) -> DataFrame:
    """bodies with `j`, the parsed body."""
    if "tenant" not in bodies.columns:
        bodies = bodies.withColumn("tenant", F.lit("default"))
    found = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    readable = F.is_valid_json("body") if hasattr(F, "is_valid_json") else F.get_json_object("body", "$").isNotNull()
    return bodies.select("tenant", F.col("offset").cast("long").alias("_first"), F.when(readable & F.col("body").startswith("{"), found).otherwise(wrong("the body is no JSON object", schema)).alias("j"))


def nanos(text: Column) -> Column:
    """Unix nanoseconds given as text; nothing and 0 are null."""
    return F.nullif(F.coalesce(text.cast("long"), F.lit(0)), F.lit(0))


# Attribute values


def plain(value: dict | None):
    """An attribute value without its type wrappers."""
    for kind, inner in (value or {}).items():
        if kind == "arrayValue":
            return [plain(v) for v in inner.get("values") or []]
        if kind == "kvlistValue":
            return {f["key"]: plain(f.get("value")) for f in inner.get("values") or []}
        if kind == "intValue":
            return int(inner)
        return inner
    return None


def as_text(value: dict | None) -> str:
    """An attribute value as text: strings bare, the rest as JSON; no value is empty."""
    found = plain(value)
    return "" if found is None else found if isinstance(found, str) else json.dumps(found, ensure_ascii=False, separators=(",", ":"))


def rendered(lists: Column) -> Column:
    """For each JSON text of an attribute list: `m`, its map of rendered values, and `j`, the JSON object by key with types kept.

    Values nest to any depth, which built-in functions cannot follow, so this runs in Arrow batches.
    """
    def render(texts: pa.Array) -> pa.Array:
        out = []
        for row in texts.to_pylist():
            found = []
            for text in row or []:
                each = {a["key"]: a.get("value") for a in json.loads(text)} if text else {}
                found.append({"m": [(k, as_text(v)) for k, v in each.items()], "j": json.dumps({k: plain(each[k]) for k in sorted(each)}, ensure_ascii=False, separators=(",", ":"))})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("m", pa.map_(pa.string(), pa.string())), ("j", pa.string())])))

    render.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(render, "array<struct<m:map<string,string>,j:string>>")(lists)


def text_of(value: Column) -> Column:
    """The text of a JSON-encoded attribute value."""
    def render(texts: pa.Array) -> pa.Array:
        return pa.array([as_text(json.loads(t)) if t else "" for t in texts.to_pylist()], pa.string())

    render.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(render, "string")(value)


def quoted(text: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, 2, F.length(inside) - 2)


def inner_attributes(records: Column) -> Column:
    """rendered() of the attributes of nested records."""
    return rendered(F.transform(F.coalesce(records, F.array()), lambda e: e["attributes"]))


# Formats


def pushed_logs(bodies: DataFrame) -> DataFrame:
    """Log records of pushed streams: {"streams": [{"stream": labels, "values": [[nanoseconds, line, metadata?], ...]}, ...]}."""
    def of_stream(s: Column) -> Column:
        return F.transform(F.coalesce(s["values"], F.array().cast("array<array<string>>")), lambda v: F.struct(s["stream"].alias("labels"), v.alias("v")))

    rows = parsed(bodies, PUSH).select("tenant", "_first", F.posexplode(F.flatten(F.transform("j.streams", of_stream))).alias("_n", "e"))
    v = F.col("e.v")
    at = F.when(F.size(v).between(2, 3), F.try_element_at(v, F.lit(1)).try_cast("long"))
    metadata = F.from_json(F.try_element_at(v, F.lit(3)), "map<string,string>")
    return rows.select(
        "tenant",
        F.lit("logs").alias("signal"),
        F.lit(0).alias("partition"),
        (F.col("_first") + F.col("_n")).alias("offset"),
        F.coalesce(at, wrong("a pushed value needs nanoseconds, a line and at most metadata", "bigint")).alias("timestamp"),
        F.coalesce(F.try_element_at(v, F.lit(2)), wrong("a pushed value needs a line", "string")).alias("message"),
        F.coalesce("e.labels", F.create_map().cast("map<string,string>")).alias("labels"),
        F.coalesce(metadata, F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def container_logs(bodies: DataFrame) -> DataFrame:
    """Log records of container log lines: {"log": message, "stream": name, "time": RFC 3339 with up to nine decimals}."""
    line = parsed(bodies, "struct<log:string,stream:string,time:string>").select("tenant", "_first", "j.*")
    second = F.to_timestamp(F.concat(F.substring("time", 1, 19), F.coalesce(F.nullif(F.regexp_extract("time", r"([+-]\d\d:\d\d)$", 1), F.lit("")), F.lit("Z"))))
    decimals = F.rpad(F.regexp_extract("time", r"\.(\d{1,9})", 1), 9, "0").try_cast("long")
    return line.select(
        "tenant",
        F.lit("logs").alias("signal"),
        F.lit(0).alias("partition"),
        F.col("_first").alias("offset"),
        (F.unix_seconds(second) * 1_000_000_000 + F.coalesce(decimals, F.lit(0))).alias("timestamp"),
        F.coalesce("log", wrong("a container log line needs a message", "string")).alias("message"),
        F.create_map().cast("map<string,string>").alias("labels"),
        F.when(F.coalesce("stream", F.lit("")) != "", F.create_map(F.lit("stream"), F.col("stream"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _records(bodies: DataFrame, schema: str, resources: str, scopes: str, records: str) -> DataFrame:
    """(tenant, offset, resource, scope, r) of each record, numbered through the body."""
    def of_scope(resource: Column):
        def inner(s: Column) -> Column:
            return F.transform(F.coalesce(s[records], F.array()), lambda r: F.struct(resource.alias("resource"), s["scope"].alias("scope"), r.alias("r")))

        return inner

    each = F.flatten(F.transform(F.col(f"j.{resources}"), lambda x: F.flatten(F.transform(x[scopes], of_scope(x["resource"])))))
    rows = parsed(bodies, schema).select("tenant", "_first", F.posexplode(each).alias("_n", "e"))
    rows = rows.select("tenant", (F.col("_first") + F.col("_n")).alias("offset"), "e.resource", "e.scope", "e.r")
    own = F.col("r.attributes") if "attributes" in rows.schema["r"].dataType.names else F.lit(None).cast("string")
    return rows.withColumn("a", rendered(F.array(own, "resource.attributes", "scope.attributes")))


def identity(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def _context() -> list[Column]:
    a = F.col("a")
    return [
        identity(a[1]["j"]).alias("resource_id"),
        identity(a[2]["j"], F.col("scope.name"), F.col("scope.version")).alias("scope_id"),
        a[1]["m"].alias("resource_attributes"),
        a[2]["m"].alias("scope_attributes"),
    ]


def otlp_logs(bodies: DataFrame) -> DataFrame:
    rows = _records(bodies, LOGS, "resourceLogs", "scopeLogs", "logRecords")
    return rows.select(
        "tenant",
        F.lit("logs").alias("signal"),
        F.lit(0).alias("partition"),
        "offset",
        F.coalesce(nanos(F.col("r.timeUnixNano")), nanos(F.col("r.observedTimeUnixNano")), F.lit(0)).alias("timestamp"),
        nanos(F.col("r.observedTimeUnixNano")).alias("observed_timestamp"),
        F.nullif("r.traceId", F.lit("")).alias("trace_id"),
        F.nullif("r.spanId", F.lit("")).alias("span_id"),
        F.col("r.severityNumber").alias("severity_number"),
        F.col("r.severityText").alias("severity_text"),
        F.col("r.eventName").alias("event_name"),
        text_of(F.col("r.body")).alias("message"),
        F.create_map().cast("map<string,string>").alias("labels"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.col("a")[0]["m"].alias("attributes"),
        F.col("a")[0]["j"].alias("attributes_json"),
        *_context(),
    )


def otlp_spans(bodies: DataFrame) -> DataFrame:
    """Spans, with their `events` and `links` as arrays for span_events() and span_links()."""
    rows = _records(bodies, SPANS, "resourceSpans", "scopeSpans", "spans")
    rows = rows.withColumn("ea", inner_attributes(F.col("r.events"))).withColumn("la", inner_attributes(F.col("r.links")))
    start, end = F.col("r.startTimeUnixNano").cast("long"), F.col("r.endTimeUnixNano").cast("long")
    return rows.select(
        "tenant",
        F.lit("spans").alias("signal"),
        F.lit(0).alias("partition"),
        "offset",
        start.alias("timestamp"),
        start.alias("start_timestamp"),
        end.alias("end_timestamp"),
        F.when(end < start, wrong("a span ends before it starts", "bigint")).otherwise(end - start).alias("duration_nanos"),
        "r.traceId",
        F.col("r.spanId").alias("span_id"),
        F.nullif("r.parentSpanId", F.lit("")).alias("parent_span_id"),
        F.col("r.traceState").alias("trace_state"),
        F.col("r.name").alias("name"),
        F.coalesce("r.kind", F.lit(0)).alias("kind"),
        F.coalesce("r.status.code", F.lit(0)).alias("status_code"),
        F.col("r.status.message").alias("status_message"),
        F.col("a")[0]["m"].alias("attributes"),
        F.col("a")[0]["j"].alias("attributes_json"),
        F.zip_with(F.coalesce("r.events", F.array()), "ea", lambda e, a: F.struct(e["timeUnixNano"].cast("long").alias("timestamp"), e["name"].alias("name"), a["m"].alias("attributes"))).alias("events"),
        F.zip_with(F.coalesce("r.links", F.array()), "la", lambda e, a: F.struct(e["traceId"].alias("trace_id"), e["spanId"].alias("span_id"), e["traceState"].alias("trace_state"), a["m"].alias("attributes"))).alias("links"),
        *_context(),
    ).withColumnRenamed("traceId", "trace_id")


CONTEXT = ["resource_id", "scope_id", "resource_attributes", "scope_attributes"]


def span_events(spans: DataFrame) -> DataFrame:
    """The events of spans, a row each."""
    kept = [c for c in CONTEXT if c in spans.columns]
    rows = spans.select("tenant", "partition", "offset", F.col("timestamp").alias("parent_timestamp"), "trace_id", "span_id", *kept, F.posexplode("events").alias("ordinal", "e"))
    return rows.select("tenant", F.lit("spans").alias("signal"), "partition", "offset", F.col("e.timestamp").alias("timestamp"), "parent_timestamp", "ordinal", "trace_id", "span_id", F.col("e.name").alias("name"), F.col("e.attributes").alias("attributes"), *kept)


def span_links(spans: DataFrame) -> DataFrame:
    """The links of spans, a row each, at their spans' times."""
    kept = [c for c in CONTEXT if c in spans.columns]
    rows = spans.select("tenant", "partition", "offset", "timestamp", "trace_id", "span_id", *kept, F.posexplode("links").alias("ordinal", "e"))
    return rows.select("tenant", F.lit("spans").alias("signal"), "partition", "offset", "timestamp", "ordinal", "trace_id", "span_id", F.col("e.trace_id").alias("linked_trace_id"), F.col("e.span_id").alias("linked_span_id"), "e.trace_state", F.col("e.attributes").alias("attributes"), *kept)


def otlp_points(bodies: DataFrame) -> DataFrame:
    """Metric points of all five kinds, with their `exemplars` as an array for metric_exemplars()."""
    rows = _records(bodies, METRICS, "resourceMetrics", "scopeMetrics", "metrics")
    exemplar = "array<struct<timestamp:bigint,value:double,trace_id:string,span_id:string,attributes:string>>"

    def exemplars(p: Column) -> Column:
        return F.transform(
            F.coalesce(p["exemplars"], F.array()),
            lambda e: F.struct(e["timeUnixNano"].cast("long").alias("timestamp"), F.coalesce(e["asDouble"], e["asInt"].cast("double")).alias("value"), F.nullif(e["traceId"], F.lit("")).alias("trace_id"), F.nullif(e["spanId"], F.lit("")).alias("span_id"), e["filteredAttributes"].alias("attributes")),
        )

    def point(field: str, value_type, number, integer, json, temporality: Column, monotonic: Column, linked: bool) -> Column:
        return F.transform(
            F.coalesce(F.col(f"r.{field}.dataPoints"), F.array()),
            lambda p: F.struct(
                p["attributes"].alias("attributes"),
                p["timeUnixNano"].cast("long").alias("timestamp"),
                nanos(p["startTimeUnixNano"]).alias("start_timestamp"),
                F.lit(KINDS[field]).alias("metric_kind"),
                value_type(p).alias("value_type"),
                temporality.cast("int").alias("temporality"),
                monotonic.cast("boolean").alias("monotonic"),
                integer(p).cast("long").alias("scalar_integer"),
                number(p).cast("double").alias("value"),
                json(p).cast("string").alias("value_json"),
                (exemplars(p) if linked else F.array()).cast(exemplar).alias("exemplars"),
            ),
        )

    none = F.lit(None)
    whole = lambda p: F.when(p["asInt"].isNotNull(), p["asInt"])
    scalar = (lambda p: F.when(p["asInt"].isNotNull(), "integer").otherwise("double"), lambda p: F.coalesce(p["asDouble"], p["asInt"].cast("double")), whole, lambda p: none)
    nested = lambda kind: (lambda p: F.lit(kind), lambda p: none, lambda p: none, lambda p: F.to_json(p.dropFields("attributes", "startTimeUnixNano", "timeUnixNano", "flags", "exemplars") if kind != "summary" else p.dropFields("attributes", "startTimeUnixNano", "timeUnixNano", "flags")))
    every = F.concat(
        point("gauge", *scalar, none, none, True),
        point("sum", *scalar, F.col("r.sum.aggregationTemporality"), F.coalesce("r.sum.isMonotonic", F.lit(False)), True),
        point("histogram", *nested("explicit_histogram"), F.col("r.histogram.aggregationTemporality"), none, True),
        point("exponentialHistogram", *nested("exponential_histogram"), F.col("r.exponentialHistogram.aggregationTemporality"), none, True),
        point("summary", *nested("summary"), none, none, False),
    )
    # A metric may hold many points: offsets go on inside it.
    rows = rows.select("tenant", "offset", *_context(), F.col("r.name").alias("name"), F.col("r.description").alias("description"), F.col("r.unit").alias("unit"), F.posexplode(every).alias("ordinal", "p"))
    rows = rows.withColumn("a", rendered(F.array("p.attributes"))[0]).withColumn("ea", inner_attributes(F.col("p.exemplars")))
    return rows.select(
        "tenant",
        F.lit("metrics").alias("signal"),
        F.lit(0).alias("partition"),
        "offset",
        "ordinal",
        "p.timestamp",
        "p.start_timestamp",
        identity(F.col("a.j"), F.col("resource_id"), F.col("scope_id"), F.col("name"), F.col("p.metric_kind"), F.col("unit")).alias("series_id"),
        "name",
        "description",
        "unit",
        "p.metric_kind",
        "p.value_type",
        "p.temporality",
        "p.monotonic",
        "p.scalar_integer",
        "p.value",
        "p.value_json",
        prometheus_labels(F.col("a.m"), F.col("resource_attributes")).alias("labels"),
        F.col("a.m").alias("attributes"),
        F.zip_with("p.exemplars", "ea", lambda e, a: e.withField("attributes", a["m"])).alias("exemplars"),
        *CONTEXT,
    )


#: Metric kinds by their OTLP field.
KINDS = {"gauge": "gauge", "sum": "sum", "histogram": "histogram", "exponentialHistogram": "exponential_histogram", "summary": "summary"}


def prometheus_labels(attributes: Column, resource: Column) -> Column:
    """Labels of a point: its attributes, and those of the resource that it has not itself; names with _ for what a label name may not hold."""
    def named(m: Column) -> Column:
        return F.transform_keys(m, lambda k, _: F.regexp_replace(F.regexp_replace(k, "[^a-zA-Z0-9_]", "_"), "^([0-9])", "_$1"))

    return F.map_concat(named(resource), named(attributes))


def metric_exemplars(points: DataFrame) -> DataFrame:
    """The exemplars of metric points, a row each."""
    kept = [c for c in CONTEXT if c in points.columns]
    rows = points.select("tenant", "partition", "offset", "series_id", "name", "labels", *kept, F.posexplode("exemplars").alias("_n", "e"))
    return rows.select("tenant", F.lit("metrics").alias("signal"), "partition", "offset", F.col("e.timestamp").alias("timestamp"), F.col("_n").alias("ordinal"), "series_id", "name", "e.trace_id", "e.span_id", "e.value", "labels", F.col("e.attributes").alias("attributes"), *kept)

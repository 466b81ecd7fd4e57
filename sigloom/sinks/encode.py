"""Query results as the JSON of the protocols: a row for each stream, series or trace, and json_lines for whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import ieee


def label_object(labels: Column) -> Column:
    """JSON object of labels, by name."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def labels_of(text: Column) -> Column:
    """The labels of a vector's label text."""
    return F.when(text == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(","), F.lit("=")))


def seconds(t: Column, per_second: int) -> Column:
    """A time as JSON seconds, with decimals only where there are some."""
    whole, rest = F.call_function("div", t, F.lit(per_second).cast("long")).cast("string"), F.pmod(t, F.lit(per_second).cast("long"))
    decimals = F.rtrim(F.lpad(rest.cast("string"), len(str(per_second)) - 1, "0"), F.lit("0"))
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), decimals))


def sample(t: Column, value: Column, per_second: int) -> Column:
    return F.concat(F.lit("["), seconds(t, per_second), F.lit(',"'), ieee.rendered(value), F.lit('"]'))


def matrix(found: DataFrame, per_second: int) -> DataFrame:
    """(labels, json) of a range query's (t, labels, value): {"metric": ..., "values": [[seconds, "value"], ...]} for each series."""
    rows = found.groupBy("labels").agg(F.array_sort(F.collect_list(F.struct("t", sample(F.col("t"), F.col("value"), per_second).alias("v")))).alias("s"))
    return rows.select("labels", F.concat(F.lit('{"metric":'), label_object(labels_of(F.col("labels"))), F.lit(',"values":['), F.array_join(F.transform("s", lambda x: x["v"]), ","), F.lit("]}")).alias("json"))


def vector(found: DataFrame, per_second: int) -> DataFrame:
    """(labels, json) of an instant query's result: {"metric": ..., "value": [seconds, "value"]} for each sample."""
    return found.select("labels", F.concat(F.lit('{"metric":'), label_object(labels_of(F.col("labels"))), F.lit(',"value":'), sample(F.col("t"), F.col("value"), per_second), F.lit("}")).alias("json"))


def streams(found: DataFrame, forward: bool = False) -> DataFrame:
    """(labels, json) of log lines (ts, offset, labels, line): {"stream": ..., "values": [["nanoseconds", "line"], ...]} for each stream."""
    one = F.to_json(F.array(F.col("ts").cast("string"), F.col("line")))
    rows = found.groupBy(label_object(F.col("labels")).alias("labels")).agg(F.sort_array(F.collect_list(F.struct("ts", "offset", one.alias("v"))), forward).alias("s"))
    return rows.select("labels", F.concat(F.lit('{"stream":'), F.col("labels"), F.lit(',"values":['), F.array_join(F.transform("s", lambda x: x["v"]), ","), F.lit("]}")).alias("json"))


def traces(found: DataFrame) -> DataFrame:
    """(trace_id, json) of a trace search's result."""
    fields = F.struct(
        F.col("trace_id").alias("traceID"),
        F.coalesce("root_name", F.lit("")).alias("rootTraceName"),
        F.col("start").cast("string").alias("startTimeUnixNano"),
        F.call_function("div", F.col("end") - F.col("start"), F.lit(1_000_000).cast("long")).alias("durationMs"),
        F.col("spans").alias("spanCount"),
        F.col("errors").alias("errorCount"),
    )
    return found.select("trace_id", F.to_json(fields).alias("json"))


def trace(spans: DataFrame) -> DataFrame:
    """(trace_id, json) of whole traces: {"spans": [...]} in order of time."""
    one = F.struct("timestamp", "span_id", "parent_span_id", "name", "kind", "status_code", "duration_nanos", F.map_from_entries(F.array_sort(F.map_entries("attributes"))).alias("attributes"))
    rows = spans.select("trace_id", "timestamp", "span_id", F.to_json(one).alias("v")).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "span_id", "v"))).alias("s"))
    return rows.select("trace_id", F.concat(F.lit('{"spans":['), F.array_join(F.transform("s", lambda x: x["v"]), ","), F.lit("]}")).alias("json"))


def json_lines(df: DataFrame) -> DataFrame:
    """(json) of every row: integers as numbers, maps as objects in order of their keys, nulls kept."""
    def shown(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        return (F.map_from_entries(F.array_sort(F.map_entries(column))) if kind.startswith("map<string") else column).alias(name)

    return df.select(F.to_json(F.struct(*[shown(n, k) for n, k in df.dtypes]), {"ignoreNullFields": "false"}).alias("json"))


def arrow_streams(df: DataFrame) -> DataFrame:
    """(rows, stream) of the table in parts: each a complete Arrow IPC stream, written where the rows are."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["rows", "stream"])

    return df.mapInArrow(write, "rows bigint, stream binary")


def arrow_table(parts: DataFrame) -> Iterator[pa.RecordBatch]:
    """The batches of arrow_streams(), one after another."""
    for part in parts.select("stream").toLocalIterator():
        yield from pa.ipc.open_stream(part.stream)


def enveloped(rows: DataFrame, kind: str) -> DataFrame:
    """One row, the whole response. The result is one string, so it is for results that a client can hold."""
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rows.columns[0], "json"))), lambda x: x["json"]), ",").alias("b"))
    return body.select(F.concat(F.lit(f'{{"status":"success","data":{{"resultType":"{kind}","result":['), F.col("b"), F.lit("]}}")).alias("json"))

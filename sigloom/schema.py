"""The fixed relations, column by column. Times are nanoseconds as BIGINT; ids are lower-case hex."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_M = T.MapType(_S, _S)

#: The type of every column of the public schema.
COLUMNS: dict[str, T.DataType] = (
    dict.fromkeys("tenant signal resource_id scope_id trace_id span_id parent_span_id linked_trace_id linked_span_id series_id message body_json name event_name severity_text status_message trace_state description unit metric_kind value_type attributes_json resource_attributes_json scope_attributes_json events_json links_json value_json exemplars_json".split(), _S)
    | dict.fromkeys("partition ordinal severity_number kind status_code temporality flags dropped_attributes_count dropped_events_count dropped_links_count".split(), _I)
    | dict.fromkeys("offset timestamp parent_timestamp observed_timestamp start_timestamp end_timestamp duration_nanos scalar_integer scalar_double_bits".split(), _L)
    | {"score": _D, "value": _D, "monotonic": _B}
    | dict.fromkeys("labels metadata attributes resource_attributes scope_attributes attribute_ids resource_attribute_ids scope_attribute_ids".split(), _M)
)
_KEYS = "tenant signal partition offset timestamp "
_CONTEXT = " resource_id scope_id resource_attributes scope_attributes"
RELATIONS: dict[str, list[str]] = {
    "logs": (_KEYS + "observed_timestamp trace_id span_id severity_number severity_text flags event_name message body_json labels metadata attributes attributes_json score" + _CONTEXT).split(),
    "spans": (_KEYS + "start_timestamp end_timestamp duration_nanos trace_id span_id parent_span_id trace_state name kind status_code status_message attributes attributes_json events_json links_json" + _CONTEXT).split(),
    "span_events": (_KEYS + "parent_timestamp ordinal trace_id span_id name attributes" + _CONTEXT).split(),
    "span_links": (_KEYS + "ordinal trace_id span_id linked_trace_id linked_span_id trace_state attributes" + _CONTEXT).split(),
    "metric_points": (_KEYS + "start_timestamp series_id name description unit metric_kind value_type temporality monotonic scalar_integer scalar_double_bits value value_json labels attributes" + _CONTEXT).split(),
    "metric_exemplars": (_KEYS + "ordinal series_id name trace_id span_id value labels attributes" + _CONTEXT).split(),
}
ALIASES = {"metrics": "metric_points"}
#: Columns that are never null.
REQUIRED = {"tenant", "signal", "timestamp", "partition", "offset"} | {c for c, t in COLUMNS.items() if t == _M}


def relation(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in RELATIONS:
        raise ValueError(f"unknown relation: {name}")
    return name


def struct(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, COLUMNS[c], c not in REQUIRED) for c in RELATIONS[relation(name)]])

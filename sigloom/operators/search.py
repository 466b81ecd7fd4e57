"""Log search: scan requests as name/value pairs, compiled to one DataFrame.

Every predicate is a boolean column that is never null, so negation is safe.
What a request cannot express is refused, never approximated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom import schema
from sigloom.functions import tokens as T
from sigloom.functions.labels import check_regex

NUMERIC = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
GROUPS = ("severity_text", "scope_name", "minute")


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def field_values(key: str) -> list[Column]:
    """All values that a normalised key may have; a predicate on it holds if it holds for one of them."""
    def at(column: str, name: str) -> Column:
        return F.try_element_at(F.col(column), F.lit(name))

    direct = {"otel.severity_number": F.col("severity_number").cast("string"), "otel.severity_text": F.col("severity_text"), "otel.trace_id": F.col("trace_id"), "otel.span_id": F.col("span_id")}
    if key == "otel.severity_number":
        return [direct[key], at("metadata", "severity_number")]
    if key in direct:
        return [direct[key]]
    for prefix, column in (("resource.loki.label.", "labels"), ("attr.loki.metadata.", "metadata"), ("resource.", "resource_attributes"), ("scope.", "scope_attributes")):
        if key.startswith(prefix):
            return [at(column, key[len(prefix) :])]
    return [at("attributes", key)]


def on_field(key: str, test) -> Column:
    return either([sure(test(v)) for v in field_values(key)])


def numeric_test(op: str, wanted: str):
    if not re.fullmatch(r"[+-]?[0-9]{1,38}", wanted):
        raise ValueError(f"not an integer: {wanted!r}")
    return lambda v: F.rlike(v, F.lit(r"^[+-]?[0-9]+$")) & sure(_compare(v.try_cast("decimal(38,0)"), op, F.lit(wanted).cast("decimal(38,0)")))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


def message() -> Column:
    return F.coalesce(F.col("message"), F.lit(""))


def _pair(value: str, name: str) -> tuple[str, str]:
    left, mark, right = value.rpartition(":")
    if not mark:
        raise ValueError(f"{name} needs value:number")
    return left, right


@dataclass
class Scan:
    """A parsed request."""

    relation: str = "logs"
    filters: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    tokens: list[tuple[str, bool]] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    min_match: int | None = None
    any_part: bool = False
    score_terms: list[str] = field(default_factory=list)
    start: int | None = None
    end: int | None = None
    limit: int | None = None
    order: str | None = None
    columns: list[str] | None = None
    count_only: bool = False
    distinct_trace: bool = False
    join_service: str | None = None
    group_by: list[str] = field(default_factory=list)
    group_order: str = "key_asc"
    group_limit: int | None = None
    after: tuple[int, int] | None = None
    offsets: tuple[int | None, int | None] = (None, None)


def parse(pairs: list[tuple[str, str]]) -> Scan:
    """A request from name/value pairs; unknown names and repeated single values are refused."""
    s, seen = Scan(), set()
    many = {"term", "message_token", "message_token_ci", "message_any", "message_contains", "message_prefix", "message_suffix", "message_regex", "message_regex_ci", "message_token_regex", "message_token_regex_ci", "message_token_prefix", "message_token_prefix_ci", "message_phrase", "message_proximity", "message_fuzzy", "message_like", "message_not"}
    for name, value in pairs:
        if name in seen and name not in many and not name.startswith("field_"):
            raise ValueError(f"{name} is given twice")
        seen.add(name)
        if name == "relation":
            s.relation = schema.relation(value)
        elif name in ("start_ns", "end_ns"):
            setattr(s, name[:-3], int(value))
        elif name in ("limit", "group_limit", "message_min_match"):
            setattr(s, {"message_min_match": "min_match"}.get(name, name), int(value))
        elif name in ("offset_start", "offset_end"):
            s.offsets = (int(value), s.offsets[1]) if name == "offset_start" else (s.offsets[0], int(value))
        elif name == "after":
            at, offset = value.split(":")
            s.after = int(at), int(offset)
        elif name in ("cardinality_only", "distinct_trace_id"):
            if value not in ("1", "true", "0", "false"):
                raise ValueError(f"{name} is a boolean")
            setattr(s, "count_only" if name == "cardinality_only" else "distinct_trace", value in ("1", "true"))
        elif name == "order":
            known = {"timestamp_asc": "asc", "timestamp_desc": "desc", "score_desc": "score", "relevance_desc": "score"}
            if value not in known:
                raise ValueError(f"unknown order: {value}")
            s.order = known[value]
        elif name == "predicate_operator":
            if value not in ("and", "or"):
                raise ValueError("predicate_operator is and or or")
            s.any_part = value == "or"
        elif name == "term":
            s.terms.append(value)
            s.score_terms.append(value)
        elif name in ("message_token", "message_token_ci"):
            s.tokens.append((value, name.endswith("_ci")))
            s.score_terms.append(value)
        elif name == "message_any":
            s.any_of.append(value)
            s.score_terms.append(value)
        elif name == "message_exact":
            s.parts.append(lambda v=value: sure(message() == v))
        elif name in ("message_contains", "message_prefix", "message_suffix"):
            how = {"message_contains": "contains", "message_prefix": "startswith", "message_suffix": "endswith"}[name]
            s.parts.append(lambda v=value, h=how: getattr(F.lower(message()), h)(v.lower()))
        elif name in ("message_regex", "message_regex_ci"):
            pattern = ("(?iu)" if name.endswith("_ci") else "") + check_regex(value)
            s.parts.append(lambda p=pattern: F.rlike(message(), F.lit(p)))
        elif name in ("message_token_regex", "message_token_regex_ci"):
            s.parts.append(lambda p=check_regex(value), ci=name.endswith("_ci"): T.has_token_like(message(), p, ci))
        elif name in ("message_token_prefix", "message_token_prefix_ci"):
            s.parts.append(lambda v=value, ci=name.endswith("_ci"): T.has_token_prefix(message(), v, ci))
        elif name in ("message_phrase", "message_proximity"):
            words, gap = _pair(value, name) if ":" in value else (value, "0")
            s.parts.append(lambda w=words.split("|"), g=int(gap): T.has_phrase(message(), w, g))
            s.score_terms += words.split("|")
        elif name == "message_fuzzy":
            word, distance = _pair(value, name)
            s.parts.append(lambda w=word, d=int(distance): T.has_fuzzy(message(), w, d))
            s.score_terms.append(word)
        elif name == "message_like":
            s.parts.append(lambda p=T.wildcard(value): T.has_token_like(message(), p, True))
        elif name == "message_not":
            s.parts.append(lambda v=value: ~T.has_token(message(), v, True))
            s.score_terms.append(value)
        elif name == "field_exists":
            s.parts.append(lambda v=value: on_field(v, lambda x: x.isNotNull()))
        elif name.startswith("field_"):
            s.parts.append(_field(name, value))
        elif name == "trace_join_service":
            s.join_service = value
        elif name in ("trace_id", "span_id"):
            if not re.fullmatch("[0-9a-f]{%d}" % (32 if name == "trace_id" else 16), value) or not value.strip("0"):
                raise ValueError(f"not a {name}: {value!r}")
            s.filters.append(lambda n=name, v=value: sure(F.col(n) == v))
        elif name in ("series_id", "name", "tenant"):
            s.filters.append(lambda n=name, v=value: sure(F.col(n) == v))
        elif "." in name and name.split(".")[0] in MAPS:
            prefix, key = name.split(".", 1)
            s.filters.append(lambda c=MAPS[prefix], k=key, v=value: sure(F.try_element_at(F.col(c), F.lit(k)) == v))
        elif name == "group_by":
            s.group_by = value.split(",")
            if bad := [g for g in s.group_by if g not in GROUPS] or len(set(s.group_by)) < len(s.group_by):
                raise ValueError(f"cannot group by {bad}")
        elif name == "group_order":
            if value not in ("count_desc", "key_asc"):
                raise ValueError(f"unknown group_order: {value}")
            s.group_order = value
        elif name == "columns":
            s.columns = value.split(",")
        else:
            raise ValueError(f"unknown parameter: {name}")
    return validated(s)


MAPS = {"label": "labels", "metadata": "metadata", "attribute": "attributes", "resource": "resource_attributes", "scope": "scope_attributes"}


def _field(name: str, value: str):
    how = name[len("field_") :]
    if how == "numeric":
        key, op, wanted = value.split(":", 2)
        if op not in NUMERIC:
            raise ValueError(f"unknown comparison: {op}")
        return lambda t=numeric_test(op, wanted), k=key: on_field(k, t)
    key, mark, wanted = value.partition("=")
    if not mark:
        raise ValueError(f"{name} needs key=value")
    tests = {
        "equals": lambda v: v == wanted,
        "contains": lambda v: v.contains(wanted),
        "prefix": lambda v: v.startswith(wanted),
        "suffix": lambda v: v.endswith(wanted),
        "in": lambda v: v.isin(wanted.split("|")),
        "regex": lambda v: F.rlike(v, F.lit(check_regex(wanted))),
    }
    if how not in tests:
        raise ValueError(f"unknown parameter: {name}")
    return lambda: on_field(key, tests[how])


def validated(s: Scan) -> Scan:
    known = schema.RELATIONS[s.relation]
    if s.columns is not None:
        if len(set(s.columns)) < len(s.columns):
            raise ValueError("a column is given twice")
        if bad := [c for c in s.columns if c not in known]:
            raise ValueError(f"{s.relation} has no column {bad}")
    if s.start is not None and s.end is not None and s.start >= s.end:
        raise ValueError("start_ns must be before end_ns")
    if s.order and s.limit is None:
        raise ValueError("an order needs a limit")
    if s.relation != "logs" and (s.order or s.group_by or s.join_service or s.parts or s.terms or s.tokens or s.any_of):
        raise ValueError("searching, ordering and grouping are for logs")
    if s.min_match is not None and s.min_match > len(s.any_of):
        raise ValueError("message_min_match exceeds the number of message_any")
    if s.count_only and (s.group_by or s.order or s.columns):
        raise ValueError("cardinality_only returns a count alone")
    return s


def condition(s: Scan) -> Column:
    parts = [make() for make in s.parts] + [T.has_term(message(), t) for t in s.terms] + [T.has_token(message(), t, ci) for t, ci in s.tokens]
    if s.any_of:
        each = [T.has_token(message(), t, True) for t in s.any_of]
        least = 1 if s.min_match is None else s.min_match
        parts.append(reduce(lambda a, b: a + b, [m.cast("int") for m in each]) >= least)
    matched = either(parts) if s.any_part else every(parts)
    return every([make() for make in s.filters] + [matched])


def bounded(df: DataFrame, s: Scan) -> DataFrame:
    if s.start is not None:
        df = df.filter(F.col("timestamp") >= s.start)
    if s.end is not None:
        df = df.filter(F.col("timestamp") < s.end)
    for at, test in zip(s.offsets, ("offset >= {}", "offset < {}")):
        if at is not None:
            df = df.filter(test.format(at))
    return df


def scan(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The request's answer over its relation."""
    s = parse(pairs)
    inside = bounded(df, s)
    found = inside.filter(condition(s))
    if s.after is not None:
        here, cursor = F.struct("timestamp", "offset"), F.struct(F.lit(s.after[0]).cast("long"), F.lit(s.after[1]).cast("long"))
        found = found.filter(here < cursor if s.order == "desc" else here > cursor)
    if s.join_service is not None:
        found = joined_to_service(found, inside, s.join_service)
    if s.distinct_trace:
        found = found.filter("trace_id <> ''")
        if s.count_only:
            return found.agg(F.countDistinct("trace_id").alias("rows"))
        found = found.select("trace_id").distinct()
        return found if s.limit is None else found.orderBy("trace_id").limit(s.limit)
    if s.count_only:
        return found.agg(F.count("*").alias("rows"))
    if s.group_by:
        return grouped(found, s)
    if s.order == "score":
        found = found.withColumn("score", T.relevance(message(), s.score_terms)).orderBy(F.desc("score"), F.desc("timestamp"), F.desc("offset"))
    elif s.order:
        found = found.orderBy(*(F.desc(c) if s.order == "desc" else F.asc(c) for c in ("timestamp", "offset")))
    if s.limit is not None:
        found = found.limit(s.limit)
    if s.columns:
        have = set(found.columns)
        found = found.select(*[F.col(c) if c in have else F.lit(None).cast(schema.COLUMNS[c]).alias(c) for c in s.columns])
    return found


def scan_relations(relations: dict[str, DataFrame], pairs: list[tuple[str, str]]) -> DataFrame:
    """The request's answer over the relation that it names; logs if it names none."""
    name = parse(pairs).relation
    if name not in relations:
        raise ValueError(f"no such relation here: {name}")
    return scan(relations[name], pairs)


def joined_to_service(found: DataFrame, inside: DataFrame, service: str) -> DataFrame:
    """Rows of traces that also have a row of the service, in the same time range."""
    of_service = sure(F.try_element_at(F.col("labels"), F.lit("service_name")) == service) | sure(F.try_element_at(F.col("resource_attributes"), F.lit("service.name")) == service)
    traces = inside.filter(of_service).filter("trace_id <> ''").select("trace_id")
    return found.filter("trace_id <> ''").join(traces, "trace_id", "left_semi")


def grouped(found: DataFrame, s: Scan) -> DataFrame:
    """Counts by the keys; a missing key is NULL and comes first."""
    keys = {
        "severity_text": F.coalesce(F.nullif(F.col("severity_text"), F.lit("")), F.try_element_at(F.col("metadata"), F.lit("severity_text"))),
        "scope_name": F.coalesce(F.try_element_at(F.col("metadata"), F.lit("scope_name")), F.try_element_at(F.col("scope_attributes"), F.lit("name"))),
        "minute": F.expr("CAST(timestamp DIV 60000000000 AS STRING)"),
    }
    out = found.groupBy(*[keys[g].alias(g) for g in s.group_by]).agg(F.count("*").alias("count"))
    by_key = [F.col(g).asc_nulls_first() for g in s.group_by]
    out = out.orderBy(*([F.desc("count")] if s.group_order == "count_desc" else []), *by_key)
    return out if s.group_limit is None else out.limit(s.group_limit)


def page_by_bytes(df: DataFrame, budget: int, after: tuple[int, int] | None = None) -> DataFrame:
    """The first rows in (timestamp, offset) order whose messages fit the budget, and always one. Null messages take no bytes.

    Bytes are summed per minute first; only minutes that begin within the budget are read row by row, each by itself.
    """
    if after is not None:
        df = df.filter(F.struct("timestamp", "offset") > F.struct(F.lit(after[0]).cast("long"), F.lit(after[1]).cast("long")))
    df = df.withColumn("_minute", F.expr("timestamp DIV 60000000000")).withColumn("_bytes", F.coalesce(F.octet_length("message"), F.lit(0)).cast("long"))
    # A row for each minute in one task.
    earlier = Window.orderBy("_minute")
    minutes = df.groupBy("_minute").agg(F.sum("_bytes").alias("_sum"))
    minutes = minutes.select("_minute", F.coalesce(F.sum("_sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.row_number().over(earlier).alias("_nth"))
    inside = Window.partitionBy("_minute").orderBy("timestamp", "offset")
    rows = df.join(minutes.filter(F.col("_ahead") <= budget), "_minute")
    rows = rows.withColumn("_through", F.col("_ahead") + F.sum("_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(inside))
    page = rows.filter((F.col("_through") <= budget) | (F.col("_n") == 1) & (F.col("_nth") == 1))
    return page.drop("_minute", "_bytes", "_ahead", "_nth", "_through", "_n")

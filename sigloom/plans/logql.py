"""LogQL: text to AST to one DataFrame, for log pipelines and for metric queries.

Operators of equal precedence group from the left. Label filters are joined by
`and`; `or` between them, template functions, `distinct` and `ip()` are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import labels as L
from sigloom.functions import parsers, units
from sigloom.functions.tokens import quoted
from sigloom.plans import vectors as V
from sigloom.plans.lexing import Parser, Token
from sigloom.plans.vectors import QueryError

SECOND = 1_000_000_000
MOST_STEPS = 11_000
DEFAULT_LIMIT, MOST_LIMIT = 100, 5000
LEVEL_NAMES = ("detected_level", "level", "severity", "severity_text", "lvl")
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")


@dataclass
class Selector:
    matchers: list[tuple[str, str, str]]
    stages: list[tuple] = field(default_factory=list)
    unwrap: str | None = None


@dataclass
class RangeCall:
    name: str
    selector: Selector
    width: int
    parameter: float | None = None


@dataclass
class Aggregation:
    op: str
    inner: object
    by: list[str] | None = None
    without: list[str] | None = None
    k: int | None = None


@dataclass
class Sorted:
    inner: object
    descending: bool


@dataclass
class Binary:
    op: str
    left: object
    right: object
    matching: V.Matching
    as_bool: bool


@dataclass
class Number:
    value: float


PRECEDENCE = {"or": 1, "unless": 1, "and": 1, "==": 2, "!=": 2, ">": 2, ">=": 2, "<": 2, "<=": 2, "+": 3, "-": 3, "*": 4, "/": 4, "%": 4, "^": 5}
SETS = ("and", "or", "unless")
COUNTING = {"count_over_time", "rate", "bytes_over_time", "bytes_rate", "absent_over_time"}
UNWRAPPED = {"sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "first_over_time", "last_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "rate_counter"}
AGGREGATIONS = {"sum": "sum", "avg": "avg", "average": "avg", "min": "min", "minimum": "min", "max": "max", "maximum": "max", "count": "count", "stddev": "stddev", "stdvar": "stdvar", "topk": "topk", "bottomk": "bottomk"}


class LogParser(Parser):
    def selector(self) -> Selector:
        self.take("{")
        found = Selector([(n, o, L.check_regex(v) if "~" in o else v) for n, o, v in self.matchers()])
        while self.has("|", "|=", "|~", "!=", "!~"):
            self.stage(found)
        return found

    def stage(self, to: Selector) -> None:
        token = self.take()
        if token.text in ("|=", "!=", "|~", "!~"):
            value = str(self.of("string").value)
            to.stages.append(("line", token.text, L.check_regex(value) if "~" in token.text else value))
            return
        name = self.of("name").text
        if name == "json" and self.now.kind == "name" and not self.has("and"):
            paths = []
            while True:
                label = self.of("name").text
                self.take("=")
                paths.append((label, str(self.of("string").value)))
                if not self.maybe(","):
                    break
            to.stages.append(("json_paths", paths))
        elif name in ("json", "logfmt", "unpack", "decolorize"):
            to.stages.append((name,))
        elif name in ("regexp", "pattern", "line_format"):
            to.stages.append((name, str(self.of("string").value)))
        elif name == "unwrap":
            if to.unwrap:
                raise QueryError("unwrap is given twice")
            to.unwrap = self.of("name").text
        elif name == "label_format":
            changes = []
            while True:
                label = self.of("name").text
                self.take("=")
                value = self.take()
                if value.kind not in ("name", "string"):
                    raise QueryError(f"label_format needs a label or a template at {value.at}")
                changes.append((label, value.kind == "string", str(value.value)))
                if not self.maybe(","):
                    break
            to.stages.append(("label_format", changes))
        elif name in ("drop", "keep"):
            names = [self.of("name").text]
            while self.maybe(","):
                names.append(self.of("name").text)
            to.stages.append((name, names))
        elif self.has("=", "==", "!=", "=~", "!~", ">", ">=", "<", "<="):
            self.i -= 1
            tests = [self.label_test()]
            while self.maybe("and"):
                tests.append(self.label_test())
            if self.has("or"):
                raise QueryError("label filters are joined by `and` alone")
            to.stages.append(("filter", tests))
        else:
            raise QueryError(f"unknown stage {name!r}")

    def label_test(self) -> tuple[str, str, Token]:
        name = self.of("name").text
        op = self.take("=", "==", "!=", "=~", "!~", ">", ">=", "<", "<=").text
        value = self.take()
        if value.kind not in ("string", "number", "duration"):
            raise QueryError(f"a label filter compares with a value, at {value.at}")
        return name, "=" if op == "==" else op, value

    # Metric queries

    def expression(self, least: int = 0):
        left = self.unit()
        while (op := self.now.text) in PRECEDENCE and self.now.kind != "string" and PRECEDENCE[op] > least:
            self.take()
            as_bool = bool(self.maybe("bool"))
            matching = self.matching()
            right = self.expression(PRECEDENCE[op])
            left = Binary(op, left, right, matching, as_bool)
        return left

    def matching(self) -> V.Matching:
        m = V.Matching()
        if self.has("on", "ignoring"):
            m.given, m.on = True, self.take().text == "on"
            m.names = self.names()
            if self.has("group_left", "group_right"):
                m.many = "left" if self.take().text == "group_left" else "right"
                m.include = self.names() if self.has("(") else []
        return m

    def unit(self):
        if self.maybe("("):
            inner = self.expression()
            self.take(")")
            return inner
        sign = -1.0 if self.maybe("-") else 1.0
        if self.now.kind == "number":
            return Number(sign * float(self.take().value))
        if sign < 0:
            raise QueryError("a sign stands before a number alone")
        name = self.of("name").text
        if name in AGGREGATIONS:
            return self.aggregation(name)
        if name in ("sort", "sort_desc"):
            self.take("(")
            inner = self.expression()
            self.take(")")
            return Sorted(inner, name == "sort_desc")
        if name in COUNTING | UNWRAPPED:
            return self.range_call(name)
        raise QueryError(f"unknown function {name!r}")

    def aggregation(self, name: str) -> Aggregation:
        found = Aggregation(AGGREGATIONS[name], None)
        if self.has("by", "without"):
            kind = self.take().text
            setattr(found, kind, self.names())
        self.take("(")
        if found.op in ("topk", "bottomk"):
            k = float(self.of("number").value)
            if k != int(k) or k < 1:
                raise QueryError("k must be a whole number of 1 or more")
            found.k = int(k)
            self.take(",")
        found.inner = self.expression()
        self.take(")")
        return found

    def range_call(self, name: str) -> RangeCall:
        self.take("(")
        parameter = None
        if name == "quantile_over_time":
            parameter = float(self.of("number").value)
            self.take(",")
        selector = self.selector()
        self.take("[")
        width = units.compound_ns(self.of("duration").text) if not re.fullmatch(r"[0-9]+(ns|us|µs)", self.now.text) else units.duration_ns(self.take().text)
        self.take("]")
        while self.has("|", "|=", "|~", "!=", "!~"):
            self.stage(selector)
        self.take(")")
        if (name in UNWRAPPED) != (selector.unwrap is not None):
            raise QueryError(f"{name} {'needs' if name in UNWRAPPED else 'takes no'} unwrap")
        return RangeCall(name, selector, width, parameter)


def parse_selector(text: str) -> Selector:
    p = LogParser(text)
    found = p.selector()
    p.finish()
    if found.unwrap:
        raise QueryError("unwrap belongs in a metric query")
    return found


def parse(text: str):
    """A log pipeline or a metric query, by its first character."""
    if text.lstrip().startswith("{"):
        return parse_selector(text)
    p = LogParser(text)
    found = p.expression()
    p.finish()
    return found


def validate(text: str) -> str:
    """The query unchanged if it parses."""
    parse(text)
    return text


# Pipelines


def entries(logs: DataFrame) -> DataFrame:
    """The reduced form pipelines run on: ts, offset, line, labels, meta."""
    return logs.select(F.col("timestamp").alias("ts"), "offset", F.coalesce("message", F.lit("")).alias("line"), "labels", F.col("metadata").alias("meta"))


def pipeline(rows: DataFrame, selector: Selector) -> DataFrame:
    for name, op, value in selector.matchers:
        rows = rows.filter(L.matches(F.col("labels"), name, op, value))
    for stage in selector.stages:
        rows = STAGES[stage[0]](rows, *stage[1:])
    return rows


def _line(rows: DataFrame, op: str, value: str) -> DataFrame:
    found = F.col("line").contains(value) if op in ("|=", "!=") else F.rlike("line", F.lit(value))
    return rows.filter(found if op.startswith("|") else ~found)


def _with_labels(rows: DataFrame, labels: Column) -> DataFrame:
    return rows.withColumn("labels", labels)


def _json_paths(rows: DataFrame, paths: list[tuple[str, str]]) -> DataFrame:
    parsed = F.get_json_object("line", "$").isNotNull()
    parts = []
    for label, path in paths:
        steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in re.findall(r"[^.\[\]\"]+", path))
        value = F.get_json_object("line", f"${steps}")
        scalar = F.when(~F.rlike(value, F.lit(r"^\s*[\[{]")), value)
        parts.append((label, F.coalesce(scalar, F.lit(""))))
    found = L.make(**dict(parts))
    return _with_labels(rows, L.merged("labels", F.when(parsed, found).otherwise(L.make(__error__="JSONParserErr"))))


def _groups(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """The pattern with numbered groups, and the number of each name."""
    names, number, out, i = [], 0, [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if m := re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", pattern[i:]):
            number += 1
            names.append((m[1], number))
            out.append("(")
            i += m.end()
            continue
        if pattern[i] == "(" and not pattern.startswith("(?", i):
            number += 1
        out.append(pattern[i])
        i += 1
    return "".join(out), names


def _regexp(rows: DataFrame, pattern: str, error: str = "RegexpParserErr", whole: bool = False) -> DataFrame:
    numbered, names = _groups(L.check_regex(pattern))
    numbered = rf"\A(?:{numbered})\z" if whole else numbered
    if not names:
        raise QueryError("the pattern names no capture")
    found = L.make(**{n: F.regexp_extract("line", numbered, i) for n, i in names})
    hit = F.rlike("line", F.lit(numbered))
    return _with_labels(rows, F.when(hit, L.merged("labels", found)).otherwise(L.merged("labels", L.make(__error__=error))))


def _pattern(rows: DataFrame, template: str) -> DataFrame:
    parts = re.split(r"<([A-Za-z_][A-Za-z0-9_]*)>", template)
    if not any(n != "_" for n in parts[1::2]):
        raise QueryError("the pattern names no capture")
    out = [quoted(p) if i % 2 == 0 else "(?s:.*?)" if p == "_" else f"(?P<{p}>(?s:.*?))" for i, p in enumerate(parts)]
    return _regexp(rows, "".join(out), "PatternParserErr", whole=True)


def _unpack(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_u", parsers.unpacked("line", "labels"))
    return rows.withColumn("line", F.col("_u.line")).withColumn("labels", F.col("_u.labels")).drop("_u")


def _filter(rows: DataFrame, tests: list[tuple[str, str, Token]]) -> DataFrame:
    for name, op, value in tests:
        have = F.coalesce(F.try_element_at("labels", F.lit(name)), F.try_element_at("meta", F.lit(name)), F.lit(""))
        wanted = str(value.value)
        if op in ("=", "!="):
            holds = have == wanted if op == "=" else have != wanted
        elif op in ("=~", "!~"):
            found = F.rlike(have, F.lit(rf"\A(?:{L.check_regex(wanted)})\z"))
            holds = found if op == "=~" else ~found
        else:
            holds = _measured_test(have, op, wanted)
        rows = rows.filter(holds)
    return rows


def _measured_test(have: Column, op: str, wanted: str) -> Column:
    """Both sides as durations, else as bytes, else as numbers; otherwise false."""
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
    for column in (units.duration_column, units.bytes_column):
        if (literal := _constant(column, wanted)) is not None:
            return F.coalesce(compare(column(have), F.lit(literal)), F.lit(False))
    try:
        return F.coalesce(compare(units.number_column(have), F.lit(float(wanted))), F.lit(False))
    except ValueError:
        return F.lit(False)


def _constant(column, text: str) -> float | None:
    m = re.fullmatch(r"([0-9]{1,18})([a-zA-Zµ]+)", text)
    scale = {u: units.NANOS[u] for u in "ns us µs ms s m h".split()} if column is units.duration_column else units.BYTES
    return float(m[1]) * scale[m[2]] if m and m[2] in scale else None


def template(text: str) -> Column:
    """{{.label}}, {{__line__}} and {{__timestamp__}}; anything else between braces is refused."""
    parts: list[Column] = []
    for i, part in enumerate(re.split(r"\{\{(.*?)\}\}", text)):
        name = part.strip()
        if i % 2 == 0:
            parts.append(F.lit(part))
        elif name == "__line__":
            parts.append(F.col("line"))
        elif name == "__timestamp__":
            parts.append(F.col("ts").cast("string"))
        elif re.fullmatch(r"\.[A-Za-z_][A-Za-z0-9_]*", name):
            parts.append(L.value(F.col("labels"), name[1:]))
        else:
            raise QueryError(f"template functions are not supported: {part!r}")
    return F.concat(*parts)


def _label_format(rows: DataFrame, changes: list[tuple[str, bool, str]]) -> DataFrame:
    for label, is_template, value in changes:
        new = template(value) if is_template else L.value(F.col("labels"), value)
        base = F.col("labels") if is_template else L.without(F.col("labels"), [value])
        rows = _with_labels(rows, L.merged(base, F.create_map(F.lit(label), new)))
    return rows


STAGES = {
    "line": _line,
    "json": lambda rows: _with_labels(rows, parsers.json_labels("line", "labels")),
    "logfmt": lambda rows: _with_labels(rows, parsers.logfmt_labels("line", "labels")),
    "json_paths": _json_paths,
    "regexp": _regexp,
    "pattern": _pattern,
    "unpack": _unpack,
    "decolorize": lambda rows: rows.withColumn("line", F.regexp_replace("line", "\\x1b\\[[^@-~]*[@-~]?", "")),
    "line_format": lambda rows, text: rows.withColumn("line", template(text)),
    "label_format": _label_format,
    "drop": lambda rows, names: _with_labels(rows, L.without(F.col("labels"), names)),
    "keep": lambda rows, names: _with_labels(rows, L.only(F.col("labels"), names)),
    "filter": _filter,
}


def deleted(rows: DataFrame, requests: list[tuple[str, int, int]]) -> DataFrame:
    """Rows (of entries()) without those that a delete request hides: its selector matches, at a time in [start, end]."""
    for text, start, end in requests:
        selector = parse_selector(text)
        hidden = F.col("ts").between(start, end)
        for name, op, value in selector.matchers:
            hidden &= L.matches(F.col("labels"), name, op, value)
        for stage in selector.stages:
            if stage[0] != "line":
                raise QueryError("delete requests take line filters alone")
            found = F.col("line").contains(stage[2]) if stage[1] in ("|=", "!=") else F.rlike("line", F.lit(stage[2]))
            hidden &= found if stage[1].startswith("|") else ~found
        rows = rows.filter(~hidden)
    return rows


def detected_level() -> Column:
    named = F.coalesce(*[F.nullif(L.value(F.col("labels"), n), F.lit("")) for n in LEVEL_NAMES])
    level = F.lit("unknown")
    for name in reversed(LEVELS):
        level = F.when(F.rlike("line", F.lit(f"(?i)(?<![0-9a-z]){name}(?![0-9a-z])")), name).otherwise(level)
    return F.coalesce(named, level)


def stream_query(logs: DataFrame, text: str, start: int, end: int, limit: int = DEFAULT_LIMIT, forward: bool = False, deletes=()) -> DataFrame:
    """The log lines of [start, end], newest first unless forward, with labels, metadata and level as one map."""
    if not 0 < limit <= MOST_LIMIT:
        raise QueryError(f"limit is from 1 to {MOST_LIMIT}")
    rows = entries(logs).filter(F.col("ts").between(start, end))
    rows = pipeline(deleted(rows, list(deletes)), parse_selector(text))
    order = [F.asc("ts"), F.asc("offset")] if forward else [F.desc("ts"), F.desc("offset")]
    shown = L.merged("labels", "meta", L.make(detected_level=detected_level()))
    return rows.orderBy(*order).limit(limit).select("ts", "offset", shown.alias("labels"), "line")


def streams(found: DataFrame) -> DataFrame:
    """Lines gathered by stream, as a response holds them."""
    return found.groupBy(L.canonical(F.col("labels")).alias("stream")).agg(F.sort_array(F.collect_list(F.struct("ts", "offset", "line"))).alias("values"))


# Metric queries


class Evaluator:
    def __init__(self, logs: DataFrame, grid: V.Grid, deletes=()):
        self.rows, self.grid, self.spark = deleted(entries(logs), list(deletes)), grid, logs.sparkSession

    def eval(self, node):
        if isinstance(node, Number):
            return V.scalar(node.value)
        if isinstance(node, RangeCall):
            return self.range(node)
        if isinstance(node, Sorted):
            return self.vector(node.inner)
        if isinstance(node, Aggregation):
            inner = self.vector(node.inner)
            if node.k is not None:
                return V.top(inner, node.k, node.op == "topk", node.by, node.without)
            return V.aggregate(inner, node.op, node.by, node.without)
        return self.binary(node)

    def vector(self, node) -> DataFrame:
        found = self.eval(node)
        if isinstance(found, V.Scalar):
            raise QueryError("a vector is needed here")
        return found

    def binary(self, node: Binary):
        left, right = self.eval(node.left), self.eval(node.right)
        one, other = isinstance(left, V.Scalar), isinstance(right, V.Scalar)
        if node.op in SETS:
            if one or other:
                raise QueryError(f"{node.op} takes vectors")
            return V.set_operation(left, right, node.op, node.matching)
        if one and other:
            return V.scalars(node.op, left, right, node.as_bool)
        if one or other:
            return V.with_scalar(right if one else left, node.op, left if one else right, one, node.as_bool)
        return V.combine(left, right, node.op, node.matching, node.as_bool, result="full")

    def range(self, call: RangeCall) -> DataFrame:
        g, name = self.grid, call.name
        rows = pipeline(self.rows.filter((F.col("ts") > g.start - call.width) & (F.col("ts") <= g.end)), call.selector)
        seconds = call.width / SECOND
        if name == "absent_over_time":
            present = V.placed(rows.select("ts"), g, call.width).select("lo", "hi").distinct().select(F.explode(F.sequence("lo", "hi")).alias("i")).distinct()
            return g.steps(self.spark).join(present, "i", "left_anti").select("i", V.nothing().alias("lk"), F.lit(1.0).alias("value"))
        value = F.octet_length("line").cast("double") if "bytes" in name else F.lit(1.0)
        labels = F.col("labels")
        if call.selector.unwrap:
            have = F.coalesce(F.try_element_at("labels", F.lit(call.selector.unwrap)), F.try_element_at("meta", F.lit(call.selector.unwrap)))
            value = units.measured(have, seconds=True)
        rows = rows.select("ts", "offset", L.canonical(labels).alias("lk"), value.alias("value")).filter("value IS NOT NULL")
        placed = V.placed(rows, g, call.width)
        if name == "quantile_over_time":
            return V.quantile_over(placed, call.parameter)
        if name == "rate_counter":
            grown = V.counter_parts(lambda a, b: F.when(b >= a, b - a).otherwise(F.greatest(b, F.lit(0.0))))
            return V.over_windows(V.steps_between(placed), grown, F.sum("s") / seconds)
        parts, found = V.SIMPLE[SUMMED.get(name, name.removesuffix("_over_time"))]()
        return V.over_windows(placed, parts, found / seconds if name in ("rate", "bytes_rate") else found)


#: Functions that add up what they count.
SUMMED = {"count_over_time": "sum", "bytes_over_time": "sum", "rate": "sum", "bytes_rate": "sum"}


def metric_query(logs: DataFrame, text: str, start: int, end: int, step: int | None = None, deletes=()) -> DataFrame:
    """A metric query over the grid from start to end (nanoseconds), as (t, labels, value)."""
    step = step or max((end - start) // 250, SECOND)
    g = V.grid(start, end, step, SECOND, MOST_STEPS)
    node = parse(text)
    if isinstance(node, Selector):
        raise QueryError("a log pipeline has no samples")
    found = Evaluator(logs, g, deletes).eval(node)
    if isinstance(found, V.Scalar):
        found = g.steps(logs.sparkSession).select("i", V.nothing().alias("lk"), found.column(F.col("i")).alias("value"))
    out = V.tall(found, g)
    if isinstance(node, Sorted):
        return out.orderBy(F.desc("value") if node.descending else F.asc("value"), "labels")
    return out


def instant_query(logs: DataFrame, text: str, at: int, deletes=()) -> DataFrame:
    return metric_query(logs, text, at, at, SECOND, deletes)

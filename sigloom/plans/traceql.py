"""TraceQL: span sets, structure, pipelines and metrics over spans.

A span set is a boolean column over the spans of the time range. Numbers are
compared as numbers where both sides are, everything else as text; `kind` and
`status` are numbers. Parentheses and negation inside braces, compare() and
histogram_over_time() are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import labels as L
from sigloom.functions import units
from sigloom.plans import vectors as V
from sigloom.plans.lexing import unquoted
from sigloom.plans.vectors import QueryError

SECOND = 1_000_000_000
MOST_LIMIT = 1000
VALUES = "array<struct<s:string,n:double>>"
TOKEN = re.compile(
    r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|`[^`]*`)|(?P<duration>[0-9]+(?:\.[0-9]+)?(?:ns|us|µs|ms|s|m|h)\b)|(?P<number>-?[0-9]+(?:\.[0-9]+)?)
    |(?P<op>&>>|&<<|!>>|!<<|&>|&<|&~|!>|!<|!~|=~|!=|>=|<=|>>|<<|&&|\|\||[{}()=<>~|,])|(?P<name>[a-zA-Z_.][a-zA-Z0-9_.:\-/]*))""",
    re.X,
)
STRUCTURAL = (">", "<", ">>", "<<", "~", "!>", "!<", "!>>", "!<<", "!~", "&>", "&<", "&>>", "&<<", "&~")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str | None
    value: object = None


@dataclass
class Select:
    """{ a && b || c }: an OR of ANDs."""

    any_of: list[list[Condition]]


@dataclass
class Combined:
    op: str
    left: object
    right: object


@dataclass
class Query:
    spans: object
    by: list[str] = field(default_factory=list)
    steps: list[tuple] = field(default_factory=list)
    select: list[str] = field(default_factory=list)
    metric: tuple | None = None


class TraceParser:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at:].strip()[:12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    def has(self, *texts: str) -> bool:
        return self.tokens[self.i][0] != "string" and self.tokens[self.i][1] in texts

    def take(self, *texts: str) -> tuple[str, str]:
        if texts and not self.has(*texts):
            raise QueryError(f"expected {' or '.join(texts)}, not {self.tokens[self.i][1]!r}")
        self.i += 1
        return self.tokens[self.i - 1]

    def query(self) -> Query:
        found = Query(self.spanset())
        while self.has("|"):
            self.take()
            self.stage(found)
        if self.tokens[self.i][0] != "end":
            raise QueryError(f"unexpected {self.tokens[self.i][1]!r}")
        return found

    def spanset(self, level: int = 0):
        """|| binds least, then &&, then structure; equal ones group from the right."""
        if level == 3:
            if self.has("("):
                self.take()
                inner = self.spanset()
                self.take(")")
                return inner
            return self.braces()
        left = self.spanset(level + 1)
        if self.has(*(("||",), ("&&",), STRUCTURAL)[level]):
            return Combined(self.take()[1], left, self.spanset(level))
        return left

    def braces(self) -> Select:
        self.take("{")
        any_of = [[]]
        while not self.has("}"):
            if self.has("(", "!"):
                raise QueryError("parentheses and negation inside braces are not supported")
            any_of[-1].append(self.condition())
            if self.has("||"):
                self.take()
                any_of.append([])
            elif not self.has("}"):
                self.take("&&")
        self.take("}")
        return Select(any_of)

    def condition(self) -> Condition:
        kind, name = self.take()
        if kind != "name":
            raise QueryError(f"expected a field, not {name!r}")
        op = self.take("=", "!=", "=~", "!~", ">", ">=", "<", "<=")[1]
        return Condition(name, op, self.value())

    def value(self):
        kind, text = self.take()
        if kind == "string":
            return text[1:-1] if text[0] == "`" else unquoted(text)
        if kind == "duration":
            return float(units.duration_ns(text, fraction=True))
        if kind == "number":
            return float(text)
        if kind == "name":
            return None if text == "nil" else {"true": "true", "false": "false"}.get(text, text)
        raise QueryError(f"expected a value, not {text!r}")

    def fields(self) -> list[str]:
        self.take("(")
        out = []
        while not self.has(")"):
            out.append(self.take()[1])
            if self.has(","):
                self.take()
        self.take(")")
        return out

    def stage(self, to: Query) -> None:
        name = self.take()[1]
        if name == "by":
            to.by += self.fields()
        elif name == "select":
            to.select = list(dict.fromkeys(self.fields()))
        elif name in ("count", "sum", "avg", "min", "max"):
            args = self.fields()
            if len(args) != (name != "count"):
                raise QueryError(f"{name} takes {int(name != 'count')} field")
            op = self.take("=", "!=", ">", ">=", "<", "<=")[1]
            to.steps.append((name, args[0] if args else None, op, self.value(), list(to.by)))
        elif name in ("rate", "count_over_time", "sum_over_time", "min_over_time", "max_over_time", "avg_over_time", "quantile_over_time"):
            args = self.fields()
            plain = name in ("rate", "count_over_time")
            if plain == bool(args) or name == "quantile_over_time" and len(args) < 2:
                raise QueryError(f"wrong arguments of {name}")
            by = self.fields() if self.has("by") and self.take() else []
            rest = []
            while self.has(">", ">=", "<", "<=", "=", "!=", "|"):
                if self.has("|"):
                    self.take()
                    which = self.take("topk", "bottomk")[1]
                    rest.append((which, int(self.fields()[0])))
                else:
                    rest.append(("filter", self.take()[1], self.value()))
            to.metric = (name, args[0] if args else None, [float(q) for q in args[1:]], by, rest)
        else:
            raise QueryError(f"{name} is not supported")


def parse(text: str) -> Query:
    return TraceParser(text).query()


# Fields


def _text(c: Column) -> Column:
    return F.when(c.isNull(), F.array().cast(VALUES)).otherwise(F.array(F.struct(c.cast("string").alias("s"), units.number_column(c.cast("string")).alias("n"))))


def _number(c: Column) -> Column:
    return F.when(c.isNull(), F.array().cast(VALUES)).otherwise(F.array(F.struct(c.cast("string").alias("s"), c.cast("double").alias("n"))))


def _attribute(map_: str, key: str) -> Column:
    """The value of an attribute; one that is rendered as an array has all its elements."""
    value = F.try_element_at(F.col(map_), F.lit(key))
    items = F.from_json(value, "array<string>")
    return F.when(value.startswith("[") & items.isNotNull(), F.transform(items, lambda x: F.struct(x.alias("s"), units.number_column(x).alias("n")))).otherwise(_text(value))


def by_trace():
    return Window.partitionBy("tenant", "trace_id")



TRACE_FIELDS = {
    "traceDuration": lambda: F.max("end_timestamp").over(by_trace()) - F.min("timestamp").over(by_trace()),
    "rootName": lambda: F.min(F.when(F.col("parent_span_id").isNull(), F.struct("timestamp", "span_id", F.col("name").alias("v")))).over(by_trace())["v"],
    "rootServiceName": lambda: F.min(F.when(F.col("parent_span_id").isNull(), F.struct("timestamp", "span_id", L.value(F.col("resource_attributes"), "service.name").alias("v")))).over(by_trace())["v"],
}


def values(name: str, columns: set[str]) -> Column:
    """All values of a field, as array<struct<s, n>>; empty where it is missing."""
    def have(column: str, build) -> Column:
        return build(F.col(column)) if column in columns else F.array().cast(VALUES)

    plain = {"name": ("name", _text), "duration": ("duration_nanos", _number), "kind": ("kind", _number), "status": ("status_code", _number), "statusMessage": ("status_message", _text), "trace:id": ("trace_id", _text), "span:id": ("span_id", _text), "parent": ("parent_span_id", _text), "instrumentation:name": ("scope_name", _text), "instrumentation:version": ("scope_version", _text)}
    if name in plain:
        return have(*plain[name])
    if name in TRACE_FIELDS:
        return (_number if name == "traceDuration" else _text)(F.col(f"_{name}"))
    if name in ("event:name", "link:traceID", "link:spanID"):
        array, item = {"event:name": ("events", "name"), "link:traceID": ("links", "trace_id"), "link:spanID": ("links", "span_id")}[name]
        return have(array, lambda c: F.transform(c, lambda e: F.struct(e[item].cast("string").alias("s"), F.lit(None).cast("double").alias("n"))))
    for prefix, column in (("resource.", "resource_attributes"), ("span.", "attributes"), ("instrumentation.", "scope_attributes"), (".", "attributes")):
        if name.startswith(prefix):
            return _attribute(column, name[len(prefix) :]) if column in columns else F.array().cast(VALUES)
    for prefix, array in (("event.", "events"), ("link.", "links")):
        if name.startswith(prefix):
            key = name[len(prefix) :]
            return have(array, lambda c: F.flatten(F.transform(c, lambda e: _text(F.try_element_at(e["attributes"], F.lit(key))))))
    return _attribute("attributes", name)


def test(c: Condition, columns: set[str]) -> Column:
    found = values(c.field, columns)
    if c.value is None:
        return F.size(found) == 0 if c.op == "=" else F.size(found) > 0
    if c.op in ("=~", "!~"):
        pattern = rf"\A(?:{L.check_regex(str(c.value))})\z"
        hit = F.exists(found, lambda v: F.coalesce(F.rlike(v["s"], F.lit(pattern)), F.lit(False)))
        return hit if c.op == "=~" else (F.size(found) > 0) & ~hit
    number = c.value if isinstance(c.value, float) else None
    text = str(c.value) if number is None else None

    def same(v: Column) -> Column:
        return F.coalesce(v["n"] == number, F.lit(False)) if number is not None else F.coalesce(v["s"] == text, F.lit(False))

    if c.op == "=":
        return F.exists(found, same)
    if c.op == "!=":
        return (F.size(found) > 0) & ~F.exists(found, same)
    if number is None:
        return F.lit(False)
    compare = {">": lambda n: n > number, ">=": lambda n: n >= number, "<": lambda n: n < number, "<=": lambda n: n <= number}[c.op]
    return F.exists(found, lambda v: F.coalesce(compare(v["n"]), F.lit(False)))


# Span sets


def used_fields(node) -> set[str]:
    if isinstance(node, Select):
        return {c.field for group in node.any_of for c in group}
    return used_fields(node.left) | used_fields(node.right)


class SpanSets:
    """Adds a boolean column for each node of a span-set expression."""

    def __init__(self, spans: DataFrame, fields: set[str]):
        for name in fields & set(TRACE_FIELDS):
            spans = spans.withColumn(f"_{name}", TRACE_FIELDS[name]())
        self.spans, self.count = spans, 0
        self.columns = set(spans.columns)

    def add(self, condition: Column) -> str:
        self.count += 1
        name = f"_f{self.count}"
        self.spans = self.spans.withColumn(name, F.coalesce(condition, F.lit(False)))
        return name

    def eval(self, node) -> str:
        if isinstance(node, Select):
            any_of = F.lit(False)
            for group in node.any_of:
                every = F.lit(True)
                for c in group:
                    every &= test(c, self.columns)
                any_of |= every
            return self.add(any_of)
        left, right = self.eval(node.left), self.eval(node.right)
        if node.op == "||":
            return self.add(F.col(left) | F.col(right))
        if node.op == "&&":
            both = F.max(left).over(by_trace()) & F.max(right).over(by_trace())
            return self.add((F.col(left) | F.col(right)) & both)
        return self.related(node.op, left, right)

    def related(self, op: str, left: str, right: str) -> str:
        kind, base = (op[0], op[1:]) if op[0] in "!&" else ("", op)
        near = self.relation(base, left)
        if kind == "!":
            return self.add(F.col(right) & ~F.col(near))
        if kind == "":
            return self.add(F.col(right) & F.col(near))
        back = {">": "<", "<": ">", ">>": "<<", "<<": ">>", "~": "~"}[base]
        hit = self.add(F.col(right) & F.col(near))
        other = self.relation(back, right)
        return self.add(F.col(hit) | F.col(left) & F.col(other))

    def relation(self, op: str, of: str) -> str:
        """Whether a span stands in `op` to a span of the set `of`: as its child (>), parent (<), descendant, ancestor or sibling."""
        chosen = self.spans.filter(F.col(of))
        if op in (">>", "<<"):
            column = "below" if op == ">>" else "above"
            found = ancestry(self.spans.select("tenant", "trace_id", "span_id", "parent_span_id", F.col(of).alias("chosen"))).filter(column).select("tenant", "trace_id", "span_id")
            return self.joined(found, "span_id", "span_id")
        if op == ">":
            return self.joined(chosen.select("tenant", "trace_id", "span_id").distinct(), "parent_span_id", "span_id")
        if op == "<":
            return self.joined(chosen.filter("parent_span_id IS NOT NULL").select("tenant", "trace_id", "parent_span_id").distinct(), "span_id", "parent_span_id")
        siblings = chosen.filter("parent_span_id IS NOT NULL").groupBy("tenant", "trace_id", "parent_span_id").agg(F.min("span_id").alias("_lo"), F.max("span_id").alias("_hi"))
        return self.joined(siblings, "parent_span_id", "parent_span_id", (F.col("_lo") != F.col("span_id")) | (F.col("_hi") != F.col("span_id")))

    def joined(self, found: DataFrame, own: str, other: str, condition: Column | None = None) -> str:
        self.count += 1
        name = f"_r{self.count}"
        found = found.select(F.col("tenant").alias("_jt"), F.col("trace_id").alias("_ji"), F.col(other).alias("_js"), *[c for c in found.columns if c in ("_lo", "_hi")], F.lit(True).alias("_hit"))
        both = self.spans.join(found, (F.col("tenant") == F.col("_jt")) & (F.col("trace_id") == F.col("_ji")) & (F.col(own) == F.col("_js")), "left")
        hit = F.col("_hit").isNotNull() if condition is None else F.col("_hit").isNotNull() & condition
        self.spans = both.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_jt", "_ji", "_js", "_lo", "_hi", "_hit")
        return name


def ancestry(spans: DataFrame) -> DataFrame:
    """(tenant, trace_id, span_id, below, above): whether a chosen span lies above or below each span.

    Built-in operators have no walk along parents, so traces are streamed one at a time; the walk is linear in a trace.
    """

    def settle(keys: tuple, rows: list[tuple]) -> list[tuple]:
        parent = {s: p for s, p, _ in rows}
        chosen = {s for s, _, c in rows if c}
        below: dict = {}
        above: set = set()
        for span, _, _ in rows:
            path, at = [], span
            while at not in below and at in parent and at not in path[-1:]:
                below[at] = None  # being walked; a cycle ends here
                path.append(at)
                at = parent[at]
            for s in reversed(path):
                p = parent[s]
                below[s] = p in parent and (p in chosen or bool(below.get(p)))
        for span in chosen:
            at = parent.get(span)
            while at in parent and at not in above:
                above.add(at)
                at = parent[at]
        return [(*keys, s, bool(below[s]), s in above) for s, _, _ in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c) for c in zip(*out)]
            return pa.RecordBatch.from_arrays([*[c.cast(pa.string()) for c in columns[:3]], *columns[3:]], ["tenant", "trace_id", "span_id", "below", "above"])

        for batch in batches:
            for tenant, trace, span, parent, chosen in zip(*(c.to_pylist() for c in batch.columns)):
                if (tenant, trace) != now:
                    if rows:
                        out += settle(now, rows)
                    now, rows = (tenant, trace), []
                    if len(out) > 10_000:
                        yield emit()
                        out = []
                rows.append((span, parent, chosen))
        if rows:
            out += settle(now, rows)
        if out:
            yield emit()

    dealt = spans.select("tenant", "trace_id", "span_id", "parent_span_id", "chosen").repartition("tenant", "trace_id").sortWithinPartitions("tenant", "trace_id", "span_id")
    return dealt.mapInArrow(run, "tenant string, trace_id string, span_id string, below boolean, above boolean")


def in_range(spans: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Spans that overlap [start, end)."""
    if start is not None:
        spans = spans.filter(F.col("end_timestamp") >= start)
    return spans if end is None else spans.filter(F.col("timestamp") < end)


def exact_trace(node) -> str | None:
    """The trace id that a query without || is about."""
    if isinstance(node, Select):
        if len(node.any_of) == 1:
            for c in node.any_of[0]:
                if c.field == "trace:id" and c.op == "=":
                    return str(c.value)
        return None
    return None if node.op == "||" else exact_trace(node.left) or exact_trace(node.right)


def selected(spans: DataFrame, query: Query, start: int | None = None, end: int | None = None) -> DataFrame:
    """The spans that a query selects, after its pipeline; by() adds the group's value as `group`."""
    spans = in_range(spans, start, end)
    if (trace := exact_trace(query.spans)) is not None:
        spans = spans.filter(F.col("trace_id") == trace)
    needed = used_fields(query.spans) | set(query.by) | set(query.select) | {s[1] for s in query.steps if s[1]}
    sets = SpanSets(spans, needed)
    flag = sets.eval(query.spans)
    rows = sets.spans.filter(F.col(flag))
    for n, name in enumerate(query.by):
        rows = rows.withColumn(f"_g{n}", F.explode(F.array_distinct(F.transform(values(name, sets.columns), lambda v: v["s"]))))
    for op, name, compare, value, by in query.steps:
        group = Window.partitionBy("tenant", "trace_id", *[f"_g{n}" for n in range(len(by))])
        number = F.get(F.filter(F.transform(values(name, sets.columns), lambda v: v["n"]), lambda n: n.isNotNull()), F.lit(0)) if name else None
        total = {"count": lambda: F.count("*").over(group).cast("double"), "sum": lambda: F.coalesce(F.sum(number).over(group), F.lit(0.0)), "avg": lambda: F.avg(number).over(group), "min": lambda: F.min(number).over(group), "max": lambda: F.max(number).over(group)}[op]()
        rows = rows.withColumn("_total", total)
        t = F.col("_total")
        rows = rows.filter({"=": t == value, "!=": t != value, ">": t > value, ">=": t >= value, "<": t < value, "<=": t <= value}[compare]).drop("_total")
    if query.by:
        rows = rows.withColumn("group", F.concat_ws(",", *[f"_g{n}" for n in range(len(query.by))]))
    for name in query.select:
        rows = rows.withColumn(f"select:{name}", F.array_join(F.transform(values(name, sets.columns), lambda v: v["s"]), ","))
    return rows.drop(*[c for c in rows.columns if re.fullmatch(r"_[frg]\d+", c)])


def search(spans: DataFrame, text: str, start: int | None = None, end: int | None = None, limit: int = 20) -> DataFrame:
    """Traces with their selected spans summed up, newest first."""
    if not 0 < limit <= MOST_LIMIT:
        raise QueryError(f"limit is from 1 to {MOST_LIMIT}")
    query = parse(text)
    if query.metric:
        raise QueryError("a metrics query has no traces")
    rows = selected(spans, query, start, end)
    if query.by:
        rows = rows.drop("group").dropDuplicates(["tenant", "trace_id", "span_id"])
    root = F.when(F.col("parent_span_id").isNull(), F.struct("timestamp", "span_id"))
    return (
        rows.groupBy("trace_id")
        .agg(F.min("timestamp").alias("start"), F.max("end_timestamp").alias("end"), F.count("*").alias("spans"), F.count_if(F.col("status_code") == 2).alias("errors"), F.min_by("name", root).alias("root_name"))
        .orderBy(F.desc("start"), "trace_id")
        .limit(limit)
    )


def metrics(spans: DataFrame, text: str, start: int, end: int, step: int, exemplars: bool = False) -> DataFrame:
    """A metrics query as (t, labels, value); a bucket's time is its end."""
    query = parse(text)
    if query.metric is None:
        raise QueryError("the query has no metric")
    if step <= 0 or start >= end:
        raise QueryError("the range needs a positive step and an end after its start")
    name, of, quantiles, by, rest = query.metric
    columns = set(spans.columns)
    fields = used_fields(query.spans) | set(by) | ({of} if of else set())
    bare = Query(query.spans, query.by, query.steps)
    for f in fields & set(TRACE_FIELDS):
        spans = spans.withColumn(f"_{f}", TRACE_FIELDS[f]())
    rows = selected(spans, bare, start, end)
    bucket = F.call_function("div", F.greatest(F.col("timestamp") - start, F.lit(0)), F.lit(step).cast("long")) + 1
    rows = rows.withColumn("t", F.least(F.lit(start) + bucket * step, F.lit(end)).cast("long"))
    for n, label in enumerate(by):
        rows = rows.withColumn(f"_l{n}", F.get(F.transform(values(label, columns), lambda v: v["s"]), F.lit(0))).filter(F.col(f"_l{n}").isNotNull())
    pairs = [F.struct(F.lit(label).alias("key"), F.col(f"_l{n}").alias("value")) for n, label in enumerate(by)]
    lk = F.array_sort(F.array(*pairs)) if pairs else V.nothing()
    number = F.get(F.transform(values(of, columns), lambda v: v["n"]), F.lit(0)) if of else F.lit(1.0)
    rows = rows.select("t", lk.alias("lk"), number.alias("v"), "trace_id", "span_id", "timestamp").filter("v IS NOT NULL")
    v = F.col("v")
    if name == "quantile_over_time":
        many = rows.groupBy("t", "lk").agg(F.percentile(v, F.array(*map(F.lit, quantiles))).alias("q"))
        found = many.select("t", "lk", F.posexplode("q").alias("n", "value"))
        label = F.element_at(F.array(*[F.lit(f"{q:g}") for q in quantiles]), F.col("n") + 1)
        found = found.select("t", F.array_sort(F.concat("lk", F.array(F.struct(F.lit("p").alias("key"), label.alias("value"))))).alias("lk"), "value")
    else:
        seconds = step / SECOND
        total = {"rate": F.count("*") / seconds, "count_over_time": F.count("*").cast("double"), "sum_over_time": F.sum(v), "min_over_time": F.min(v), "max_over_time": F.max(v), "avg_over_time": F.avg(v)}[name]
        extra = [F.min_by(F.struct("trace_id", "span_id"), F.struct("timestamp", "trace_id", "span_id")).alias("exemplar")] if exemplars else []
        found = rows.groupBy("t", "lk").agg(total.alias("value"), *extra)
    for stage in rest:
        if stage[0] == "filter":
            _, op, limit = stage
            value = F.col("value")
            found = found.filter({">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit, "=": value == limit, "!=": value != limit}[op])
        else:
            last = found.groupBy("lk").agg(F.max_by("value", "t").alias("last"))
            order = F.desc("last") if stage[0] == "topk" else F.asc("last")
            best = last.orderBy(order, "lk").limit(stage[1]).select("lk")
            found = found.join(best, "lk", "left_semi")
    return found.select("t", V.label_text(F.col("lk")).alias("labels"), "value", *(["exemplar"] if "exemplar" in found.columns else []))


def tag_names(spans: DataFrame, scope: str) -> DataFrame:
    column = {"span": "attributes", "resource": "resource_attributes", "instrumentation": "scope_attributes"}[scope]
    return spans.select(F.explode(F.map_keys(column)).alias("name")).distinct()


def tag_values(spans: DataFrame, name: str) -> DataFrame:
    return spans.select(F.explode(F.transform(values(name, set(spans.columns)), lambda v: v["s"])).alias("value")).distinct()

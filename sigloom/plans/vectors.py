"""Vectors over an evaluation grid, and their algebra.

A vector is a DataFrame (i, lk, value): the step's number, the labels as
key-ordered entries, and a sample. A whole range query is one plan; steps are
rows, never a loop.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import ieee

ENTRIES = "array<struct<key:string,value:string>>"


class QueryError(ValueError):
    """The query is malformed, or asks for what is not supported."""


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ..., n of them, in units of `per_second` a second."""

    start: int
    step: int
    n: int
    per_second: int

    def time(self, i: Column) -> Column:
        return F.lit(self.start).cast("long") + i * F.lit(self.step).cast("long")

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select(F.col("id").alias("i"))

    @property
    def end(self) -> int:
        return self.start + self.step * (self.n - 1)


def grid(start: int, end: int, step: int, per_second: int, most: int) -> Grid:
    if step <= 0 or end < start:
        raise QueryError("the range needs a positive step and an end that is not before its start")
    n = (end - start) // step + 1
    if n > most:
        raise QueryError(f"{n} steps exceed the limit of {most}")
    return Grid(start, step, n, per_second)


@dataclass(frozen=True)
class Scalar:
    """A number for each step: a function of the step, or of nothing."""

    at: object  # Column -> Column, from i to value

    def column(self, i: Column) -> Column:
        return self.at(i)


def scalar(value: float) -> Scalar:
    return Scalar(lambda i: F.lit(float(value)))


@dataclass
class Matching:
    """How two vectors are matched: on or ignoring labels, which side is many, and labels taken from the other."""

    on: bool = False
    names: list[str] = field(default_factory=list)
    many: str | None = None
    include: list[str] = field(default_factory=list)
    given: bool = False


def keep(lk: Column, names: list[str]) -> Column:
    return F.filter(lk, lambda e: e["key"].isin(names)) if names else nothing()


def drop(lk: Column, names: list[str]) -> Column:
    return F.filter(lk, lambda e: ~e["key"].isin(names)) if names else lk


def nothing() -> Column:
    return F.array().cast(ENTRIES)


def label_text(lk: Column) -> Column:
    return F.array_join(F.transform(lk, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


# Windows


def covering(samples: DataFrame, grid: Grid, width: int, closed: bool = False, shift: int = 0) -> DataFrame:
    """samples (ts, ...), each once for every step whose window (t - shift - width, t - shift] holds it; closed adds the left end.

    The steps follow from ts by division, so this is a projection and no range join.
    """
    start = grid.start - shift
    inside = samples.filter((F.col("ts") >= start - width if closed else F.col("ts") > start - width) & (F.col("ts") <= grid.end - shift))
    first = F.greatest(_up(F.col("ts") - start, grid.step), F.lit(0))
    last = F.least(_down(F.col("ts") + (width if closed else width - 1) - start, grid.step), F.lit(grid.n - 1))
    return inside.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")).filter("_last >= _first").withColumn("i", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def _down(a: Column, step: int) -> Column:
    """Floor of a / step in whole numbers."""
    step = F.lit(step).cast("long")
    return F.call_function("div", a - F.pmod(a, step), step)


def _up(a: Column, step: int) -> Column:
    return _down(a + (step - 1), step)


def placed(samples: DataFrame, grid: Grid, width: int, shift: int = 0, ready: Column | None = None) -> DataFrame:
    """samples with the first and last step (`lo`, `hi`) whose window holds them; `ready` is when a sample is there, if not at ts."""
    start = grid.start - shift
    first = F.greatest(_up((F.col("ts") if ready is None else ready) - start, grid.step), F.lit(0))
    last = F.least(_down(F.col("ts") + (width - 1) - start, grid.step), F.lit(grid.n - 1))
    inside = samples.filter((F.col("ts") > start - width) & (F.col("ts") <= grid.end - shift))
    return inside.withColumn("lo", first.cast("long")).withColumn("hi", last.cast("long")).filter("hi >= lo")


def only_step(ts: Column, grid: Grid) -> Column:
    """The step at the time ts, if there is one."""
    i = _down(ts - grid.start, grid.step)
    return F.when((F.pmod(ts - grid.start, F.lit(grid.step).cast("long")) == 0) & (i >= 0) & (i < grid.n), i).cast("long")


def over_windows(rows: DataFrame, parts: dict[str, Column], found: Column) -> DataFrame:
    """`found` of each step and label set, from `parts` of the rows (lo, hi, lk, ...): rows of the same windows are combined before
    they are spread over them, so a sample that a thousand windows hold is not copied a thousand times."""
    near = rows.groupBy("lo", "hi", "lk").agg(*[c.alias(n) for n, c in parts.items()])
    return near.withColumn("i", F.explode(F.sequence("lo", "hi"))).groupBy("i", "lk").agg(found.alias("value"))


def moments(root: bool) -> tuple[dict[str, Column], Column]:
    """Population variance (or its root) for over_windows(): counts, means and squared deviations, merged without cancellation."""
    parts = {"n": F.count("*").cast("double"), "mean": F.avg("value"), "m2": F.var_pop("value") * F.count("*")}
    each = F.collect_list(F.struct("n", "mean", "m2"))

    def merge(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))

    whole = F.aggregate(F.slice(each, F.lit(2), F.size(each)), F.element_at(each, 1), merge)
    variance = whole["m2"] / whole["n"]
    return parts, F.sqrt(variance) if root else variance


SIMPLE = {
    "sum": lambda: ({"a": F.sum("value")}, F.sum("a")),
    "count": lambda: ({"a": F.count("*").cast("double")}, F.sum("a")),
    "avg": lambda: ({"a": F.sum("value"), "b": F.count("*")}, F.sum("a") / F.sum("b")),
    "min": lambda: ({"a": ieee.f_min(F.col("value"))}, ieee.f_min(F.col("a"))),
    "max": lambda: ({"a": ieee.f_max(F.col("value"))}, ieee.f_max(F.col("a"))),
    "first": lambda: ({"a": F.min(F.struct("ts", "offset", "value"))}, F.min("a")["value"]),
    "last": lambda: ({"a": F.max(F.struct("ts", "offset", "value"))}, F.max("a")["value"]),
    "present": lambda: ({"a": F.lit(1.0)}, F.max("a")),
    "stddev": lambda: moments(True),
    "stdvar": lambda: moments(False),
}


def quantile_over(rows: DataFrame, q: float) -> DataFrame:
    """Equal values of the same windows travel as one with their number."""
    near = rows.groupBy("lo", "hi", "lk", "value").agg(F.count("*").alias("n"))
    return near.withColumn("i", F.explode(F.sequence("lo", "hi"))).groupBy("i", "lk").agg(F.percentile("value", F.lit(q), F.col("n")).alias("value"))


# Aggregation


def aggregates() -> dict:
    v = F.col("value")
    return {
        "sum": F.sum(v),
        "avg": F.avg(v),
        "min": ieee.f_min(v),
        "max": ieee.f_max(v),
        "count": F.count("*").cast("double"),
        "group": F.lit(1.0),
        "stddev": F.stddev_pop(v),
        "stdvar": F.var_pop(v),
    }


def group_key(by: list[str] | None, without: list[str] | None, always: list[str]) -> Column:
    lk = drop(F.col("lk"), always)
    if without is not None:
        return drop(lk, without)
    return keep(lk, by) if by else nothing()


def aggregate(vector: DataFrame, op: str, by: list[str] | None, without: list[str] | None, always: list[str] = ()) -> DataFrame:
    """One sample for each step and group. Spread-out labels are combined on the map side."""
    rows = vector.select("i", group_key(by, without, list(always)).alias("lk"), "value")
    if op == "group":
        return rows.select("i", "lk").distinct().withColumn("value", F.lit(1.0))
    return rows.groupBy("i", "lk").agg(aggregates()[op].alias("value"))


def top(vector: DataFrame, k: int, largest: bool, by: list[str] | None, without: list[str] | None) -> DataFrame:
    """The k largest or smallest of each step and group; ties in label order."""
    if k < 1:
        raise QueryError("k must be 1 or more")
    order = F.desc("value") if largest else F.asc("value")
    rank = Window.partitionBy("i", group_key(by, without, [])).orderBy(order, "lk")
    return vector.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= k).drop("_n")


# Binary operators


def compare_or_compute(op: str, a: Column, b: Column, as_bool: bool) -> tuple[Column, Column | None]:
    """Value, and the filter that goes with it."""
    if op in ieee.COMPARE:
        holds = ieee.COMPARE[op](a, b)
        return (holds.cast("double"), None) if as_bool else (a, holds)
    return ieee.ARITHMETIC[op](a, b), None


def with_scalar(vector: DataFrame, op: str, other: Scalar, scalar_left: bool, as_bool: bool) -> DataFrame:
    own, number = F.col("value"), other.column(F.col("i"))
    a, b = (number, own) if scalar_left else (own, number)
    value, holds = compare_or_compute(op, a, b, as_bool)
    if holds is not None:
        return vector.filter(holds)
    return vector.withColumn("value", value)


def scalars(op: str, left: Scalar, right: Scalar, as_bool: bool) -> Scalar:
    def at(i: Column) -> Column:
        value, holds = compare_or_compute(op, left.column(i), right.column(i), as_bool)
        return value if holds is None else F.when(holds, value).otherwise(float("nan"))

    return Scalar(at)


def match_key(m: Matching, always: list[str]) -> Column:
    lk = F.col("lk")
    return keep(lk, m.names) if m.on else drop(lk, [*m.names, *always])


def unique(vector: DataFrame, side: str) -> DataFrame:
    """The side of a match that may have a key once; a second sample of a key is an error when the plan runs."""
    twice = F.raise_error(F.lit(f"many-to-many matching: the {side} side has several samples for one set of labels"))
    found = vector.groupBy("i", "key").agg(F.count("*").alias("_n"), F.first("value").alias("value"), F.first("lk").alias("lk"))
    return found.withColumn("value", F.when(F.col("_n") > 1, twice.cast("double")).otherwise(F.col("value"))).drop("_n")


def combine(left: DataFrame, right: DataFrame, op: str, m: Matching, as_bool: bool, always: list[str] = (), result: str = "match") -> DataFrame:
    """Vector with vector. result 'match' reduces labels of one-to-one results to the key; 'full' keeps the many (or left) side's labels."""
    always = list(always)
    a, b = (x.withColumn("key", match_key(m, always)) for x in (left, right))
    many, one = (b, a) if m.many == "right" else (a, b)
    one = unique(one, "left" if m.many == "right" else "right")
    if m.many is None:
        many = unique(many, "left")
    one = one.select(F.col("i").alias("_i"), F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("lk").alias("_lk"))
    both = many.join(one, (F.col("i") == F.col("_i")) & (F.col("key") == F.col("_key")))
    x, y = (F.col("_value"), F.col("value")) if m.many == "right" else (F.col("value"), F.col("_value"))
    value, holds = compare_or_compute(op, x, y, as_bool)
    both = both if holds is None else both.filter(holds)
    plain_compare = holds is not None
    if result == "full" or plain_compare and not m.on:
        labels = F.col("lk") if result == "full" or plain_compare else drop(F.col("lk"), always)
    elif m.many is None:
        labels = F.col("key")
    else:
        labels = drop(F.col("lk"), always)
    if m.include:
        labels = F.array_sort(F.concat(drop(labels, m.include), keep(F.col("_lk"), m.include)))
    return both.select("i", labels.alias("lk"), value.alias("value"))


def set_operation(left: DataFrame, right: DataFrame, op: str, m: Matching, always: list[str] = ()) -> DataFrame:
    a, b = (x.withColumn("key", match_key(m, list(always))) for x in (left, right))
    if op == "or":
        return left.unionByName(b.join(a.select("i", "key"), ["i", "key"], "left_anti").select("i", "lk", "value"))
    how = {"and": "left_semi", "unless": "left_anti"}[op]
    return a.join(b.select("i", "key"), ["i", "key"], how).select("i", "lk", "value")


# Counters


def steps_between(samples: DataFrame) -> DataFrame:
    """Counter rows for over_windows(): a sample with its windows, and the step from its predecessor with those that hold both.

    samples are (lk, ts, offset, value, lo, hi); those with `aside` precede only each other, within one ts.
    """
    main = ~F.col("aside") if "aside" in samples.columns else F.lit(True)
    order = Window.partitionBy("lk").orderBy("ts", main, "offset")
    sample = F.struct("ts", "value", "hi")
    rows = samples.withColumn("p", F.last(F.when(main, sample), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    if "aside" in samples.columns:
        beside = F.lag(F.when(~main, sample)).over(order)
        rows = rows.withColumn("_beside", beside).withColumn("p", F.when(~main & (F.col("_beside.ts") == F.col("ts")), F.col("_beside")).otherwise(F.col("p")))
    point = F.struct("ts", "offset", "value", F.col("p.ts").alias("before_ts"), F.col("p.value").alias("before"))
    own = F.struct(F.col("lo"), F.col("hi"), point.alias("at"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    pair = F.struct(F.col("lo"), F.least("hi", "p.hi").alias("hi"), F.lit(None).cast(samples.select(F.struct("ts", "offset", "value", F.col("ts").alias("before_ts"), F.col("value").alias("before")).alias("x")).schema["x"].dataType).alias("at"), F.col("p.value").alias("a"), F.col("value").alias("b"))
    both = F.when(F.col("p").isNotNull() & (F.least("hi", "p.hi") >= F.col("lo")), F.array(own, pair)).otherwise(F.array(own))
    return rows.select("lk", F.explode(both).alias("r")).select("lk", "r.*")


def counter_parts(step) -> dict[str, Column]:
    """Of counter rows: the number of samples, the earliest and latest, and the sum of step(before, after)."""
    return {"n": F.count("at"), "first": F.min("at"), "last": F.max("at"), "s": F.coalesce(F.sum(F.when(F.col("at").isNull(), step(F.col("a"), F.col("b")))), F.lit(0.0))}


def tall(vector: DataFrame, grid: Grid) -> DataFrame:
    """(t, labels, value) with labels as text: the result form."""
    return vector.select(grid.time(F.col("i")).alias("t"), label_text(F.col("lk")).alias("labels"), "value")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

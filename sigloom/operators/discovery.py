"""What is in the logs: streams, labels, volumes, patterns and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import labels as L
from sigloom.functions import units
from sigloom.plans import logql

#: Fixed value: a word with a digit in it is the variable part of a line.
VARIABLE = "[A-Za-z0-9_./:-]*[0-9][A-Za-z0-9_./:-]*"
FIELD = r'([^\s="]+)=("(?:[^"\\]|\\.)*"|\S*)'


def selected(logs: DataFrame, selector: str, start: int | None = None, end: int | None = None) -> DataFrame:
    rows = logql.entries(logs)
    if start is not None:
        rows = rows.filter(F.col("ts").between(start, end))
    return logql.pipeline(rows, logql.parse_selector(selector))


def index_stats(logs: DataFrame, selector: str, start: int, end: int) -> DataFrame:
    """Streams, entries and bytes; entries and bytes are summed per stream first."""
    per = selected(logs, selector, start, end).groupBy(L.canonical(F.col("labels")).alias("lk")).agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("b"))
    return per.agg(F.count("*").alias("streams"), F.sum("n").alias("entries"), F.sum("b").alias("bytes"))


def volume(logs: DataFrame, selector: str, start: int, end: int, names: list[str]) -> DataFrame:
    rows = selected(logs, selector, start, end)
    return rows.groupBy(L.text(L.only(F.col("labels"), names)).alias("labels")).agg(F.sum(F.octet_length("line")).alias("bytes"))


def label_names(logs: DataFrame, selector: str = "{}", start: int | None = None, end: int | None = None) -> DataFrame:
    return selected(logs, selector, start, end).select(F.explode(F.map_keys("labels")).alias("name")).distinct()


def label_values(logs: DataFrame, name: str, selector: str = "{}", start: int | None = None, end: int | None = None) -> DataFrame:
    return selected(logs, selector, start, end).select(F.try_element_at("labels", F.lit(name)).alias("value")).filter("value IS NOT NULL").distinct()


def series(logs: DataFrame, selector: str) -> DataFrame:
    return selected(logs, selector).select(L.text(F.col("labels")).alias("labels")).distinct()


def patterns(logs: DataFrame, selector: str, start: int, end: int, step: int = 10_000_000_000) -> DataFrame:
    """Lines with their variable words replaced, counted per bucket."""
    rows = selected(logs, selector, start, end)
    bucket = F.col("ts") - F.pmod(F.col("ts") - start, F.lit(step).cast("long"))
    return rows.groupBy(bucket.alias("bucket"), F.regexp_replace("line", VARIABLE, "<_>").alias("pattern")).agg(F.count("*").alias("n"))


def fields(logs: DataFrame) -> DataFrame:
    """(field, v, parser) of the k=v words of lines, or of the top-level scalars of JSON lines; those of the metadata have no parser."""
    line = F.coalesce("message", F.lit(""))
    field = lambda parser, name, v: F.struct(name.alias("field"), v.alias("v"), F.lit(parser).cast("string").alias("parser"))
    words = F.transform(F.regexp_extract_all(line, F.lit(FIELD), F.lit(0)), lambda p: field("logfmt", F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", "")))
    parsed = F.map_entries(F.from_json(line, "map<string,string>"))
    objects = F.transform(F.filter(parsed, lambda e: ~F.rlike(F.coalesce(e["value"], F.lit("")), F.lit(r"^[\[{]"))), lambda e: field("json", e["key"], F.coalesce(e["value"], F.lit(""))))
    chosen = F.when(line.startswith("{") & parsed.isNotNull(), objects).otherwise(words)
    metadata = F.transform(F.map_entries("metadata"), lambda e: field(None, e["key"], e["value"]))
    return logs.select(F.explode(F.concat(metadata, chosen)).alias("f")).select("f.*")


def field_type(v: Column) -> Column:
    """Aggregate: the narrowest type that all values have."""
    tests = [
        ("boolean", v.isin("true", "false")),
        ("int", F.rlike(v, F.lit("^[+-]?[0-9]+$"))),
        ("float", units.number_column(v).isNotNull()),
        ("duration", units.duration_column(v).isNotNull()),
        ("bytes", units.bytes_column(v).isNotNull()),
    ]
    out = F.lit("string")
    for name, test in reversed(tests):
        out = F.when(F.bool_and(test), name).otherwise(out)
    return out


def detected_fields(logs: DataFrame) -> DataFrame:
    return fields(logs).groupBy("field").agg(field_type(F.col("v")).alias("type"), F.countDistinct("v").alias("cardinality"), F.array_sort(F.collect_set("parser")).alias("parsers"))


def detected_field_values(logs: DataFrame, name: str) -> DataFrame:
    return fields(logs).filter(F.col("field") == name).select(F.col("v").alias("value")).distinct()

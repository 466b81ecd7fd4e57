"""Lifetime rollups: one row per series of a tenant that outlives its raw points. Points count in offset order."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counters(points: DataFrame) -> DataFrame:
    """Cumulative monotonic sums: after a drop the new value counts as a whole."""
    before = F.lag("value").over(Window.partitionBy("tenant", "series_id").orderBy("offset"))
    rows = points.select("tenant", "series_id", "value", before.alias("p"))
    grown = F.when(F.col("p").isNull() | (F.col("value") < F.col("p")), F.col("value")).otherwise(F.col("value") - F.col("p"))
    return rows.groupBy("tenant", "series_id").agg(F.sum(grown).alias("total"), F.count_if(F.col("value") < F.col("p")).alias("resets"), F.count("*").alias("points"))


def gauges(points: DataFrame) -> DataFrame:
    return points.groupBy("tenant", "series_id").agg(F.max_by("value", "offset").alias("latest"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("points"))


def sums(points: DataFrame) -> DataFrame:
    """Cumulative sums that may fall: the growth from the first value to the last, whatever the way."""
    ends = points.groupBy("tenant", "series_id").agg(F.min_by("value", "offset").alias("first"), F.max_by("value", "offset").alias("latest"), F.count("*").alias("points"))
    return ends.select("tenant", "series_id", "latest", (F.col("latest") - F.col("first")).alias("total"), "points")


def summaries(points: DataFrame) -> DataFrame:
    """Cumulative summaries (count, sum, quantiles): a fall of the count starts anew; a change of the quantiles is an error. Quantile values are the latest."""
    names = F.transform("quantiles", lambda q: q["quantile"])
    series = Window.partitionBy("tenant", "series_id").orderBy("offset")
    rows = points.withColumn("_names", names).withColumn("_p", F.lag(F.struct("count", "sum", "_names")).over(series))
    reset = F.col("_p").isNull() | (F.col("count") < F.col("_p.count"))
    rows = rows.select(
        "tenant",
        "series_id",
        "offset",
        "quantiles",
        F.when(F.col("_p").isNotNull() & (F.col("_p._names") != F.col("_names")), F.raise_error(F.lit("the quantiles of a summary changed")).cast("long")).when(reset, F.col("count")).otherwise(F.col("count") - F.col("_p.count")).alias("n"),
        F.when(reset, F.col("sum")).otherwise(F.col("sum") - F.col("_p.sum")).alias("s"),
        (F.col("_p").isNotNull() & reset).alias("fell"),
    )
    return rows.groupBy("tenant", "series_id").agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.max_by("quantiles", "offset").alias("quantiles"), F.count_if("fell").alias("resets"), F.count("*").alias("points"))


def lifetime(points: DataFrame) -> DataFrame:
    """(tenant, series_id, kind, total, points) of number points of all kinds, each by its own rule: gauges give their latest
    value, delta sums add up, monotonic cumulative sums count growth over resets, other sums the difference of last and first."""
    delta, rising = F.col("temporality") == 1, F.coalesce("monotonic", F.lit(False))
    kind = F.when(F.col("metric_kind") == "gauge", "gauge").when(delta, "delta").when(rising, "counter").otherwise("sum")
    of = points.withColumn("kind", F.when(F.col("metric_kind").isin("gauge", "sum"), kind).otherwise(F.raise_error(F.concat(F.lit("not a number: "), "metric_kind"))))
    series = Window.partitionBy("tenant", "series_id", "kind").orderBy("offset")
    before = F.lag("value").over(series)
    grown = F.when(F.col("kind") == "delta", F.col("value")).when(before.isNull(), F.when(F.col("kind") == "counter", F.col("value")).otherwise(0.0)).when((F.col("kind") == "counter") & (F.col("value") < before), F.col("value")).otherwise(F.col("value") - before)
    rows = of.select("tenant", "series_id", "kind", "offset", "value", grown.alias("grown"))
    total = F.when(F.col("kind") == "gauge", F.max_by("value", "offset")).otherwise(F.sum("grown"))
    return rows.groupBy("tenant", "series_id", "kind").agg(total.alias("total"), F.count("*").alias("points"))


def deltas(points: DataFrame) -> DataFrame:
    return points.groupBy("tenant", "series_id").agg(F.sum("value").alias("total"), F.count("*").alias("points"))


def histograms(points: DataFrame) -> DataFrame:
    """Explicit delta histograms, added bucket by bucket; a change of bounds is an error."""
    same = F.when(F.min("bounds") == F.max("bounds"), F.min("bounds")).otherwise(F.raise_error(F.lit("the bounds of a histogram changed")).cast("array<double>"))
    per = points.select("tenant", "series_id", "bounds", "sum", "count", F.posexplode("counts").alias("bucket", "n"))
    buckets = per.groupBy("tenant", "series_id", "bucket").agg(F.sum("n").alias("n")).groupBy("tenant", "series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda b: b["n"]).alias("counts"))
    totals = points.groupBy("tenant", "series_id").agg(same.alias("bounds"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return buckets.join(totals, ["tenant", "series_id"])


def example_histograms(events: DataFrame) -> DataFrame:
    """A histogram point for each event, over three bounds."""
    v = F.col("value")
    counts = F.array(*[F.when(t, 1).otherwise(0).cast("long") for t in (v <= 5, (v > 5) & (v <= 10), (v > 10) & (v <= 20), v > 20)])
    return events.select(F.lit("default").alias("tenant"), F.col("event_type").alias("series_id"), F.array(*map(F.lit, (5.0, 10.0, 20.0))).alias("bounds"), counts.alias("counts"), v.alias("sum"), F.lit(1).cast("long").alias("count"))



def exponential_histograms(points: DataFrame) -> DataFrame:
    """Sparse exponential histograms of one scale, added by bucket; a change of scale is an error.

    Built-in: the sparse spans are exploded and summed, so a hot series is combined on the map side.
    """
    scale = F.when(F.min("scale") == F.max("scale"), F.min("scale")).otherwise(F.raise_error(F.lit("the scale of a histogram changed")).cast("int"))
    totals = points.groupBy("tenant", "series_id").agg(scale.alias("scale"), F.sum("zero_count").alias("zero_count"), F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    for side in ("positive", "negative"):
        spread = points.select("tenant", "series_id", F.explode(side).alias("bucket", "n")).groupBy("tenant", "series_id", "bucket").agg(F.sum("n").alias("n"))
        total = spread.groupBy("tenant", "series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias(side))
        totals = totals.join(total, ["tenant", "series_id"], "left")
    return totals


def usage(events: DataFrame, feature: str = "feature") -> DataFrame:
    """Counters by feature: lifetime and per month."""
    return events.groupBy(feature, F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"))

"""Streaming forms: live tail, idle sealing, late data, per-series order, retries, accumulators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.operators.winners import OUT_OF_ORDER_NS
from sigloom.plans import logql

IDLE = "30 seconds"
GRACE = "15 minutes"


def tail(logs: DataFrame, text: str, deletes=()) -> DataFrame:
    """A log pipeline over a stream: the batch compiler's plan, without ordering or limit."""
    return logql.pipeline(logql.deleted(logql.entries(logs), list(deletes)), logql.parse_selector(text))


def sealed_traces(spans: DataFrame, idle: str = IDLE, grace: str = GRACE) -> DataFrame:
    """A trace per session of its spans: sealed when idle, with late fragments within the grace time. Needs a timestamp column `ts`."""
    return (
        spans.withWatermark("ts", grace)
        .groupBy("trace_id", F.session_window("ts", idle))
        .agg(F.count("*").alias("spans"), F.min("timestamp").alias("start_timestamp"), F.max("end_timestamp").alias("end_timestamp"))
        .select("trace_id", "spans", "start_timestamp", "end_timestamp")
    )


def without_retries(rows: DataFrame, key: list[str], within: str = GRACE) -> DataFrame:
    return rows.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)


def minute_counts(logs: DataFrame, grace: str = GRACE) -> DataFrame:
    return logs.withWatermark("ts", grace).groupBy(F.window("ts", "1 minute"), "severity_text").agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "severity_text", "n")


ORDERED = "tenant string, series_id string, timestamp bigint, offset bigint, value double, cumulative double, outcome string"


def in_order(points: DataFrame, mode: str = "append") -> DataFrame:
    """Points in order of arrival with their outcome and the running total of those kept.

    The outcomes are those of winners.classify_points(), and obsolete: another value for a timestamp that a record of a
    larger offset already holds. Within a micro-batch the order of arrival is that of the column `arrival`, or else of the
    offsets. State of a series: its latest timestamp, the total, and what each timestamp of the last ten minutes holds;
    a watermark for all series would judge by the wrong clock.
    """

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, total, kept = state.get if state.exists else (None, 0.0, "{}")
        held = {int(at): tuple(x) for at, x in json.loads(kept).items()}
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        cumulative, outcome = [], []
        for at, offset, value in zip(rows["timestamp"].tolist(), rows["offset"].tolist(), rows["value"].tolist()):
            winner = held.get(at)
            if latest is not None and latest - at > OUT_OF_ORDER_NS:
                outcome.append("rejected")
            elif winner is not None and (winner[1] == value or value != value and winner[1] != winner[1]):
                outcome.append("duplicate")
            elif winner is not None and winner[0] >= offset:
                outcome.append("obsolete")
            else:
                outcome.append("replaced" if winner is not None else "out_of_order" if latest is not None and at < latest else "inserted")
                latest, total = at if latest is None else max(latest, at), total + value
                held[at] = (offset, value)
            cumulative.append(total)
        held = {at: x for at, x in held.items() if latest - at <= OUT_OF_ORDER_NS}
        state.update((latest, float(total), json.dumps(held)))
        yield rows.assign(cumulative=cumulative, outcome=outcome)[["tenant", "series_id", "timestamp", "offset", "value", "cumulative", "outcome"]]

    arrival = F.col("arrival" if "arrival" in points.columns else "offset").cast("long").alias("arrival")
    rows = points.select("tenant", "series_id", "timestamp", "offset", "value", arrival)
    return rows.groupBy("tenant", "series_id").applyInPandasWithState(settle, ORDERED, "latest bigint, total double, held string", mode, GroupStateTimeout.NoTimeout)


def merge_rollup(batch: DataFrame, held: DataFrame | None) -> DataFrame:
    """A rollup of totals brought up to date by a batch of (tenant, series_id, offset, value); offsets at or below those held are retries."""
    series = ["tenant", "series_id"]
    new = batch if held is None else batch.join(held.select(*series, F.col("offset").alias("_seen")), series, "left").filter("_seen IS NULL OR offset > _seen").drop("_seen")
    add = new.groupBy(*series).agg(F.sum("value").alias("total"), F.max("offset").alias("offset"), F.count("*").alias("points"))
    both = add if held is None else held.select(*series, "total", "offset", "points").unionByName(add)
    return both.groupBy(*series).agg(F.sum("total").alias("total"), F.max("offset").alias("offset"), F.sum("points").alias("points"))

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import store

#: Rounds double the distance a label travels, so this is far beyond any path met.
MOST_ROUNDS = 60
#: Edges of a task that writes a round's table, at least.
TASK_EDGES = 1 << 13


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node of its component.

    Each round is written to the shared folder, in as many tasks as its edges need. The least
    neighbours come from partial aggregation and are written before they meet the edges again, so the
    edges of a node with many reach that join by an exchange of their own, which AQE splits. Rounds end
    as soon as all edges lead from a node to its root.
    """
    edges = store.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        rows, unsettled = _state(edges)
        if not unsettled:
            break
        tasks = -(-rows // TASK_EDGES)
        edges = _small_star(_large_star(edges, tasks), tasks)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that have two parents or are parents with a parent; without these, parents are roots."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    found = nodes.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR up > 0 AND down > 0"))).first()
    return found[0] or 0, found[1]


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = store.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")).coalesce(tasks), "least")
    found = both.join(least.hint("shuffle_merge"), both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return _instead(found.coalesce(tasks), edges, least)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = store.written(edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u").coalesce(tasks), "least")
    inner = edges.join(least.hint("shuffle_merge"), edges["a"] == least["u"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _instead(inner.union(least.select("u", "m")).filter("a <> b").distinct().coalesce(tasks), edges, least)


def _instead(found: DataFrame, *used: DataFrame) -> DataFrame:
    """found as a table, in place of the tables it was made of."""
    edges = store.written(found, "edges")
    store.dropped(*used)
    return edges

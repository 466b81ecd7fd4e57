"""Components take no more rounds and tasks than their edges need."""

import pytest

from sigloom.llm import components, store


@pytest.fixture
def tables(monkeypatch):
    """Names and numbers of files of the tables that are written meanwhile."""
    found = []

    def written(df, name, write=store.written):
        table = write(df, name)
        found.append((name, len(table.inputFiles())))
        return table

    monkeypatch.setattr(store, "written", written)
    return found


def roots(spark, edges):
    return {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}


def test_stars_take_no_round(spark, tables):
    assert roots(spark, [("n7", "n1"), ("n3", "n1"), ("n4", "n2")]) == {"n1": "n1", "n3": "n1", "n7": "n1", "n2": "n2", "n4": "n2"}
    assert [name for name, _ in tables] == ["edges"]
    assert roots(spark, [("n3", "n3")]) == {}


@pytest.mark.parametrize("edges_of_a_task", [1 << 13, 5])
def test_rounds_write_as_many_files_as_edges_need(spark, tables, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(components, "TASK_EDGES", edges_of_a_task)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = [f"p{i:02}" for i in range(30)]
        assert roots(spark, list(zip(chain, chain[1:]))) == dict.fromkeys(chain, "p00")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(tables) > 4
    assert max(files for _, files in tables[1:]) <= -(-29 // edges_of_a_task)

"""What op5_mixing reports next to the training order itself."""

from collections import Counter

import pytest

pytest.importorskip("sigloom.llm.registry")

from pyspark.sql import functions as F  # noqa: E402

from sigloom.llm import mixing  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_digest_counts_the_documents_of_the_training_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    placed = Counter(r.doc_id for r in mixing.mix_documents(docs).select("doc_id").collect())
    rows = mixing.digest(docs).collect()
    assert placed and {r.doc_id: r.copies for r in rows if r.copies} == placed
    assert all(r.taken == r.copies * r.size for r in rows)


def test_digest_takes_nothing_without_positions(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    real = mixing.positions
    monkeypatch.setattr(mixing, "positions", lambda *a: real(*a).filter(F.lit(False)))
    assert mixing.digest(docs).filter("taken <> 0 OR copies <> 0").count() == 0

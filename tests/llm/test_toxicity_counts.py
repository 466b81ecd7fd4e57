"""The counts of the toxicity model next to a count by hand."""

from collections import Counter

import pytest

pytest.importorskip("sigloom.llm.registry")

from sigloom.llm import toxicity  # noqa: E402


def test_every_sequence_has_its_own_counts(spark):
    # Enough sequences that a table of 2^21 slots, and any of fixed size near it, would have some share one.
    words = [(f"{i * 7919 % 1_000_003:06d}{chr(97 + i % 26)}", i % 3, i % 5 + 1) for i in range(40_000)]
    tables = toxicity.tables(spark.createDataFrame(words, "word string, toxic bigint, ordinary bigint"))
    toxic, ordinary = Counter(), Counter()
    for word, t, o in words:
        p = f"^{word}$"
        for i in range(1, len(p)):
            gram = p[max(0, i - toxicity.ORDER + 1) : i + 1]
            toxic[gram] += t
            ordinary[gram] += o
    model = toxicity.Model(tables, 0.5)
    assert len(tables["top.t"]) == len(ordinary) > 100_000
    for gram in ordinary:
        at = model.find("top", gram)
        assert (tables["top.t"][at], tables["top.o"][at]) == (toxic[gram], ordinary[gram])
    assert model.find("top", "^zzzzz") is None

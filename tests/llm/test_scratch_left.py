"""Tables that no later step reads go as soon as the last one has read them."""

import os

import pytest

from tessella.llm import ngram_join, passages
from tessella.llm.scratch import Scratch


@pytest.fixture
def left(monkeypatch):
    """Names of the written tables that are still there."""
    roots = []

    class Seen(Scratch):
        def __init__(self, spark, name):
            super().__init__(spark, name)
            roots.append(self.root.removeprefix("file:"))

    monkeypatch.setattr(passages, "Scratch", Seen)
    monkeypatch.setattr(ngram_join, "Scratch", Seen)
    return lambda: sorted(t.split("-", 1)[1] for root in roots for t in os.listdir(root))


@pytest.fixture
def docs(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join(["a", *words[40:]]), "z"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_passages_leave_their_ranges_alone(docs, left):
    out = passages.passage_dedup(docs)
    assert left() == ["ranges"]
    assert [r["text"] for r in out.orderBy("doc_id").collect()][1:] == ["x", "a", "z"]


def test_join_leaves_no_token_sets(docs, left):
    out = ngram_join.ngram_join(docs, n=3, similarity=(9, 10))
    assert "tokens" not in left() and "index" not in left()
    assert [r["component_id"] for r in out.orderBy("doc_id").collect()] == [0, 0, 2, 3]

"""The suffix array of the line dedup: its ranks against sorted prefixes, and that the pipeline's stage builds it."""

import numpy as np

import corpus_pipeline
from tessella.llm import passages
from tessella.llm.scratch import Scratch


def words(rng, n, kinds):
    return [f"w{x}" for x in rng.integers(0, kinds, n)]


def test_ranks_are_those_of_sorted_prefixes(spark, monkeypatch):
    monkeypatch.setattr(passages, "_SAMPLED", 1)
    rng, n, buckets = np.random.default_rng(4), 12, 4
    passage = words(rng, 40, 9)
    texts = {d: words(rng, 30, 9 if d % 2 else 999) + passage[d % 5 : 20 + d] + words(rng, 5, 2) for d in range(12)} | {99: ["x"] * 40}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    state = passages.suffixes(docs, passages.candidates(docs, n, buckets, Scratch(spark, "test")), n)
    depth, step, rounds = 0, passages._gram(n), []
    while depth + step < n:
        state = Scratch(spark, "test").table(passages.deepen(state, n, depth, step, buckets))
        depth, step = depth + step, min(depth + step, n - depth - step)
        rank = {}
        for row in state.collect():
            doc, begin, size, ranks = (np.frombuffer(row[c], np.int64) for c in passages._COLUMNS)
            at = zip(np.repeat(doc, size).tolist(), (np.repeat(begin, size) + passages._ladder(size)).tolist(), strict=True)
            rank |= {p: r for p, r in zip(at, ranks.tolist(), strict=True) if r >= 0}
        by_prefix = {}
        for (d, k), r in rank.items():
            by_prefix.setdefault(tuple(texts[d][k : k + depth]), set()).add(r)
        # a prefix has one rank, no two have the same, and an interval's ranks have room for all its suffixes
        assert all(len(x) == 1 for x in by_prefix.values())
        one = sorted((min(r), p) for p, r in by_prefix.items())
        assert len({r for r, _ in one}) == len(one)
        many = {p: sum(tuple(texts[d][k : k + depth]) == p for d, k in rank) for _, p in one}
        assert all(b - a >= many[p] for (a, p), (b, _) in zip(one, one[1:], strict=False))
        # prefixes that were equal in the round before stand together
        heads = [p[: rounds[-1] if rounds else 0] for _, p in one]
        assert sum(a != b for a, b in zip(heads, heads[1:], strict=False)) == len(set(heads)) - 1
        rounds.append(depth)
    assert rounds == [4, 8] and step == 4


def test_stage_builds_the_suffix_array(spark, data, monkeypatch):
    seen = []
    deepen, intervals = passages.deepen, passages.intervals
    monkeypatch.setattr(passages, "deepen", lambda state, n, depth, step, b: (seen.append((depth, step)), deepen(state, n, depth, step, b))[1])
    monkeypatch.setattr(passages, "intervals", lambda state, n, depth, step, b: (seen.append((depth, step, n)), intervals(state, n, depth, step, b))[1])
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"One begins here {passage} and ends."), (2, f"Other words {passage} come after."), (3, passage)], "doc_id long, text string")
    out = corpus_pipeline.lines(spark, docs, data)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"One begins here {passage} and ends.", 2: "Other words come after."}
    assert seen == [(0, 16), (16, 16), (32, 18, 50)]


def test_blocks_and_long_texts(spark, monkeypatch):
    """Suffixes in many small blocks, one text longer than a block, and one prefix that occurs very often."""
    monkeypatch.setattr(passages, "_BLOCK", 40)
    rng = np.random.default_rng(6)
    long = words(rng, 3000, 10**6)
    texts = [(0, long), (1, ["y"] * 700), (2, long[1000:1400] + ["z"] + long[:49]), (3, ["y"] * 51), (4, long[:50])]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in passages.passage_dedup(docs).collect()}
    assert got == {0: long, 1: ["y"], 2: ["z", *long[:49]], 3: [], 4: []}

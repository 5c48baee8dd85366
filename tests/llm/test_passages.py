"""Repeated passages that begin or end inside lines, against brute force."""

import re

import numpy as np
import pytest

from tessella.llm.passages import passage_dedup, without

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, least):
    """The text left of each document, by the longest earlier match of every word."""
    at = [(d, k, w) for d, t in sorted(docs) for k, w in enumerate(WORD.findall(t))]
    end = {d: i + 1 for i, (d, _, _) in enumerate(at)}
    gone = {d: set() for d, _ in docs}
    for i in range(len(at)):
        best = 0
        for j in range(i):
            n = 0
            while i + n < end[at[i][0]] and j + n < end[at[j][0]] and at[i + n][2] == at[j + n][2]:
                n += 1
            best = max(best, n)
        if best >= least:
            gone[at[i][0]] |= set(range(at[i][1], at[i][1] + best))
    return {d: [w for k, w in enumerate(WORD.findall(t)) if k not in gone[d]] for d, t in docs}


@pytest.mark.parametrize(("seed", "least"), [(1, 12), (2, 12), (3, 5)])
def test_mid_line_passages_brute_force(spark, seed, least):
    rng = np.random.default_rng(seed)
    passage = [f"p{x}" for x in range(least + 9)]
    docs = []
    for d in rng.permutation(24).tolist():
        words = [f"w{x}" for x in rng.integers(0, 5 if d % 4 == 0 else 500, rng.integers(1, 60))]
        if d % 3 == 0:
            a, n = int(rng.integers(0, 9)), int(rng.integers(least - 2, least + 9))
            k = int(rng.integers(0, len(words)))
            words[k:k] = passage[a : a + n]
        docs.append((d, "".join(w + rng.choice([" ", "\n", "  ", " \n"]) for w in words)))
    docs += [(100, docs[3][1]), (101, docs[5][1].replace("\n", " ")), (102, ""), (103, " \n "), (104, "x " * 40)]
    out = passage_dedup(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()
    assert {r["doc_id"]: WORD.findall(r["text"]) for r in out} == brute(docs, least)


def test_planted_passage_of_the_query(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = [(1, f"One begins here {passage} and ends.\nLast line."), (2, f"Head.\nOther words {passage.replace('word30 ', 'word30' + chr(10))} come after it.\nTail.")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_deleted"]) for r in passage_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 2, 0), 2: ("Head.\nOther words come after it.\nTail.", 4, 1)}


def test_white_space_around_gaps():
    cut = lambda t, a, z: without(t, np.array([a]), np.array([z]))
    assert [cut(b"a\nb c\nd", 1, 3), cut(b"a b\nc", 1, 2), cut(b"a\nb\n", 1, 2), cut(b"a\nb", 1, 2), cut(b"a b c", 0, 2), cut(b" a b ", 0, 2)] == [b"a\nd", b"a\nc", b"a\n", b"a", b"c", b""]


def test_passages_awkward(spark):
    rows = [(1, "a b c " * 9, 5), (1, "a b c " * 9, 5), (1, "other", 5), (None, "a b c " * 9, 5), (2, None, 5), (3, "a b c " * 9, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = passage_dedup(docs, 5).collect()
    assert len(out) == 6 and [r["text"] for r in out if r["doc_id"] is None] == ["a b c " * 9] and [r["text"] for r in out if r["doc_id"] == 3] == [""]
    assert passage_dedup(docs.limit(0)).count() == 0

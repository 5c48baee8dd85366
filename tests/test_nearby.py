"""Similarity joins and neighbours through cells against plain search."""

import numpy as np
import pytest

from tessella.operators.nearby import Nearby, distinct_points, nearest_rows, packed, similar_pairs

SMALL = {"cell_rows": 12, "block_rows": 20, "visitors": 25}


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "idx long, embedding array<double>")


def cosines(x):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return np.round(u @ u.T, 12)


def vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(9, 5))
    x = np.concatenate([base[i % 9] + rng.normal(size=5) / 8 for i in range(210)]).reshape(-1, 5)
    x[40:90] = x[40]  # copies
    x[90] = 2 * x[7]  # the same direction
    x[[100, 101]] = 0
    x[150:153] = -x[150]
    return x


@pytest.mark.parametrize("threshold", [0.95, 0.5, 0.0, -0.3])
def test_pairs(spark, threshold):
    x = vectors()
    s = cosines(x)
    want = {(i, j): s[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= threshold}
    for sizes in ({}, SMALL):
        rows = similar_pairs(frame(spark, x).repartition(3), threshold, **sizes).collect()
        got = {(r["i"], r["j"]): r["sim"] for r in rows}
        assert len(got) == len(rows) and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize(("k", "threshold", "ties"), [(4, None, "low"), (4, None, "high"), (7, 0.8, "low"), (300, None, "high")])
def test_neighbours(spark, k, threshold, ties):
    x = vectors()
    s, sign = cosines(x), 1 if ties == "low" else -1
    want = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and (threshold is None or s[i, j] >= threshold)), key=lambda j: (-s[i, j], sign * j))
        want[i] = order[:k]
    for sizes in ({}, SMALL):
        got = {}
        for r in sorted(nearest_rows(frame(spark, x), k, threshold, ties, **sizes).collect(), key=lambda r: (r["i"], r["rank"])):
            assert r["rank"] == len(got.setdefault(r["i"], [])) + 1 and abs(s[r["i"], r["j"]] - r["sim"]) < 1e-9
            got[r["i"]].append(r["j"])
        # where directions differ by less than rounding, one of equals may stand for another
        assert all([s[i, j] for j in got.get(i, [])] == [s[i, j] for j in want[i]] for i in want)
        exact = [i for i in want if got.get(i, []) == want[i]]
        assert len(exact) >= len(x) - 3


def test_tight_clusters_stay_apart(spark):
    """The higher the threshold, the fewer rows are sent to another cell."""
    rng = np.random.default_rng(2)
    base = np.eye(12)
    x = np.repeat(base, 40, axis=0) + rng.normal(size=(480, 12)) / 100
    near = Nearby(packed(frame(spark, x), "embedding", True), cosine=True, cell_rows=40, block_rows=100)
    rows = near.placed.collect()
    from tessella.operators.nearby import matrix

    best = near.cells.best(matrix([r["q"] for r in rows]))
    sent = [int((best >= t).sum()) for t in (0.99, 0.9, 0.0, -1.0)]
    assert sent == sorted(sent) and sent[1] < 3 * len(x) and sent[3] == len(x) * int((near.cells.blocks > 0).sum())


def test_empty_and_single(spark):
    none = frame(spark, [])
    assert similar_pairs(none, 0.5).count() == 0 and nearest_rows(none, 3).count() == 0
    one = frame(spark, [[1.0, 2.0]])
    assert similar_pairs(one, 0.5).count() == 0 and nearest_rows(one, 3).count() == 0
    odd = frame(spark, [[1.0, float("nan")], [1.0, 0.0], [float("inf"), 1.0]])
    assert [(r["i"], r["j"]) for r in similar_pairs(odd, 0.9).collect()] == [(0, 1)]


def test_copies_are_one_point(spark):
    x = vectors()
    points, rows, copies = distinct_points(frame(spark, x), "embedding", False, 3)
    assert copies and points.count() == len(np.unique(x, axis=0))
    of = {r["idx"]: r["of"] for r in rows.collect()}
    assert len(of) == len(x) and all(of[i] == 40 for i in range(40, 90)) and of[101] == 100

"""Hard negatives against a plain search, and DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import queries
from tessella.llm.hard_negatives import BallTree, Best, Cells, Queries, hard_negatives


def brute(rows, every=100, positives=5, negatives=5, share=(80, 100), scale=256):
    """rows: (vec_id, label, vector), all of which take part."""
    q = [(i, d, k, [math.floor(scale * x) for x in v]) for i, (d, k, v) in enumerate(rows)]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    out = []
    for i, d, k, v in q:
        if d is None or d % every:
            continue
        found = [(sum(a * b for a, b in zip(v, w, strict=True)), e, j, m) for j, e, m, w in q if j != i]
        for ps, pid, _, _ in sorted((t for t in found if t[3] == k), key=order)[:positives]:
            near = sorted((t for t in found if t[3] != k and share[0] * ps <= share[1] * t[0] <= share[1] * ps), key=order)[:negatives]
            out += [(d, pid, r + 1, t[1], ps, t[0]) for r, t in enumerate(near)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def got(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    made = [(int(i), int(rng.integers(3)), np.round(base[i % 12] + rng.normal(size=6) / 6, 2).tolist()) for i in range(420)]
    made += [(1000 + i, i % 3, made[0][2]) for i in range(200)]  # a third of the rows hold one vector: ties everywhere
    return made + [(2000, 1, [0.0] * 6), (2100, 2, [-x for x in made[7][2]])]


def test_against_plain_search(spark, rows):
    want = brute(rows)
    assert len(want) > 50
    assert got(hard_negatives(table(spark, rows).repartition(3))) == want
    # many small trees and blocks, a tiny sample: bounds change, results don't
    assert got(hard_negatives(table(spark, rows), tree_rows=40, block=2, sample=25)) == want
    other = {"every": 50, "positives": 3, "negatives": 7, "share": (95, 100)}
    assert got(hard_negatives(table(spark, rows), tree_rows=100, sample=60, **other)) == brute(rows, **other)


def test_repeated_and_null_ids(spark, rows):
    more = rows[:150] + [(100, 0, rows[3][2]), (100, 0, rows[100][2]), (None, 1, rows[0][2]), (None, 0, rows[100][2])]
    a, b = got(hard_negatives(table(spark, more), tree_rows=30, sample=20)), brute(more)
    assert a == b


def test_rows_without_part(spark, rows):
    bad = [(300, None, rows[0][2]), (400, 1, None), (500, 1, [1.0, None, 0, 0, 0, 0]), (600, 1, [float("nan")] * 6), (700, 1, [float("-inf")] * 6), (800, 1, [1.0]), (900, 2, [])]
    bad = [(d, k, v and [None if x is None else float(x) for x in v]) for d, k, v in bad]
    df = table(spark, rows[:200] + bad)
    clash = df.withColumns({c: F.lit(1) for c in ("row", "q", "cell", "sub", "block", "query", "score", "rank", "low", "high", "v", "n")})
    assert got(hard_negatives(clash)) == brute(rows[:200])
    assert hard_negatives(table(spark, [])).count() == 0 and hard_negatives(table(spark, bad[:3])).count() == 0
    assert hard_negatives(table(spark, [(0, 1, [1.0, 2.0])])).count() == 0  # an anchor alone


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 5)), 100, axis=0) + rng.normal(size=(4000, 5)) / 50)).astype(np.int64)
    tree = BallTree.build(x, leaf=20)
    for i in range(len(tree.radius)):
        own = tree.vectors[tree.begin[i] : tree.end[i]]
        assert np.sqrt(((own - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i]
    seen, n = 0, len(x)
    q = x[:30]
    scores = q @ x.T
    low, high = np.sort(scores, axis=1)[:, -400], np.sort(scores, axis=1)[:, -100]
    want = Queries(q, np.zeros(30, np.int64), np.arange(30), low, high, same=False)
    best, rows, labels = Best(30, 5, np.full(30, -(1 << 62))), tree.order, np.ones(n, np.int64)

    def visit(who, i, j, s):
        nonlocal seen
        seen += len(who) * (j - i)
        best.add(who, s, rows[i:j], rows[i:j], want.fit(who, s, labels[i:j], rows[i:j]))

    tree.search(q, low, high, best.kth, visit)
    for k in range(30):
        fit = sorted((-int(s), i) for i, s in enumerate(scores[k]) if low[k] <= s <= high[k])[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[k], best.ident[k], strict=True)] == fit
    assert seen < 0.25 * 30 * n  # most nodes are never opened


def test_cells_of_equal_rows():
    same = Cells.fit(np.ones((50, 3), np.int64), 8)
    assert len(set(same.of(np.ones((9, 3), np.int64)).tolist())) == 1


def test_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    df = queries.queries()["op11_hard_negatives"](spark, data)
    cursor = con.execute(queries.oracle_sql()["op11_hard_negatives"])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    a = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert a and a == sorted(cursor.fetchall())

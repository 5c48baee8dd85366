"""Codes of vectors against a plain Lloyd's in whole numbers, and DuckDB."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessella.llm import queries
from tessella.llm.vector_codes import VectorCodes, nearest, vector_codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, label, vector), clean and of one size that parts divides."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    q = [[math.floor(scale * x) for x in r[2]] for r in rows]
    w = len(q[0]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for v in q] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut[p]:
                own[best(v, books[p])[1]].append(v)
            books[p] = [tuple(sum(x) // len(own[e]) for x in zip(*own[e], strict=True)) if e in own else c for e, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for i, r in enumerate(rows):
        found = [best(cut[p][i], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), r[1]))
        by[r[1]] += out[-1][2]
    return sorted(((a, b, c, by[k], sha) for a, b, c, k in out), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) * 3 + 1, int(rng.integers(3)) if i % 9 else None, np.round(rng.normal(size=8) / 8, 2).tolist()) for i in rng.permutation(340)]
    rows += [(5000 + i, 1, rows[0][2]) for i in range(150)]  # a third of the rows hold one vector
    rows += [(rows[3][0], 2, rows[5][2]), (None, None, rows[6][2])]  # a repeated id, a null id
    assert got(vector_codes(table(spark, rows).repartition(5))) == brute(rows)
    few = rows[:40]
    assert got(vector_codes(table(spark, few))) == brute(few)  # fewer rows than entries
    assert got(vector_codes(table(spark, rows), entries=16, rounds=7, parts=2)) == brute(rows, 2, 16, 7)


def test_rows_that_are_left_out(spark):
    good = [(i, 0, [i / 7.0, -i / 5.0, 0.25, 1.0]) for i in range(30)]
    bad = [(100, 0, None), (101, 0, [1.0, None, 2.0, 3.0]), (102, 0, [1.0, float("nan"), 2.0, 3.0]), (103, 0, [1.0, float("inf"), 2.0, 3.0]), (104, 0, [1.0]), (105, 0, [])]
    df = table(spark, good + bad)
    assert got(vector_codes(df)) == brute(good)
    clash = df.withColumns({c: F.lit(1) for c in ("row", "part", "parts", "position", "weight", "code", "error", "v", "entry")})
    assert got(vector_codes(clash)) == brute(good)
    assert vector_codes(table(spark, [])).count() == 0 and vector_codes(table(spark, bad[:4])).count() == 0


def test_codes_decode_to_the_entries(spark):
    rows = [(i, 0, [math.sin(i * k) for k in range(1, 7)]) for i in range(300)]  # six components in four parts
    made = VectorCodes(spark)
    books = made.fit(table(spark, rows))
    for r in made.codes(books).collect():
        q = [math.floor(1024 * x) for x in rows[r["vec_id"]][2]]
        assert sum((a - b) ** 2 for a, b in zip(q, books.decode(r["code"]), strict=True)) == r["error"]


def test_large_components_stay_exact():
    a, b = np.array([[1 << 26, -(1 << 26) + 1]] * 2, np.int64), np.array([[(1 << 26) - 1, -(1 << 26)], [5, 5]], np.int64)
    at, d = nearest(a, b)
    assert at.tolist() == [0, 0] and d.tolist() == [2, 2]


def test_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    df = queries.queries()["op13_vector_codes"](spark, data)
    cursor = con.execute(queries.oracle_sql()["op13_vector_codes"])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cursor.fetchall())

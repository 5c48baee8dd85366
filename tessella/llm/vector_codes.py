"""Product quantisation of vectors: Lloyd's rounds over the distinct parts, each weighted by how many rows have it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import join_hot
from . import spans
from .scratch import Scratch

#: Components of more than this can't be coded: squared distances would leave 64 bits.
_MOST = 1 << 27


def finite(vector: str = "embedding"):
    """Whether the vector is there and every component is a finite number."""
    x = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def grid(column: pa.Array, scale: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * component) of those vectors that have size components, and which those are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    have = np.flatnonzero(np.diff(off) == size)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    q = np.floor(scale * flat[off[:-1][have][:, None] + np.arange(size)])
    if q.size and np.abs(q).max() >= _MOST:
        raise ValueError(f"a component is beyond {_MOST / scale:.0f} and can't be coded in 64-bit integers")
    return q.astype(np.int64), have


def cut(q: np.ndarray, parts: int) -> np.ndarray:
    """q as (rows, parts, width); a size that parts doesn't divide is filled up with zeros, which add nothing to a distance."""
    width = max(1, -(-q.shape[1] // parts))
    full = np.zeros((len(q), parts * width), np.int64)
    full[:, : q.shape[1]] = q
    return full.reshape(len(q), parts, width)


def common_size(rows: DataFrame, vector: str) -> int:
    """The most frequent number of components, of equally frequent ones the larger; 0 for an empty table."""
    top = rows.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("n")).limit(1).collect()
    return top[0]["n"] if top else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers: by floating point where every sum fits its 53 bits."""
    most = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1) * a.shape[1]
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, of equally near ones the lower index, and the squared distance."""
    d = (book * book).sum(1)[None, :] - 2 * products(parts, book)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at] + (parts * parts).sum(1)


@dataclass
class Codebooks:
    """entries[position, index, component]; there are fewer than 256 entries only where fewer vectors are kept."""

    entries: np.ndarray
    size: int

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: str) -> list[int]:
        """The vector of integers that a code stands for."""
        return [int(x) for p in range(len(self.entries)) for x in self.entries[p, int(codes[2 * p : 2 * p + 2], 16)]][: self.size]


class VectorCodes:
    """Codes of vectors by parts.

    fit() writes the distinct parts of each position with their number of
    rows, and learns the codebooks on those; codes() joins the codes of the
    distinct parts back to the vectors.
    """

    def __init__(self, spark: SparkSession, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0):
        if not 1 <= entries <= 256:
            raise ValueError("a code has two hex digits: 1 to 256 entries")
        self.spark, self.parts, self.entries, self.rounds, self.scale = spark, parts, entries, rounds, scale
        self.scratch = Scratch(spark, "vector-codes")

    def fit(self, df: DataFrame, vector: str = "embedding", label: str = "label") -> Codebooks:
        kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(finite("v"))
        size = common_size(kept, "v")
        kept = kept.where(F.size("v") == size)
        first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(self.entries).collect()
        if not first or not size:
            self.rows, self.distinct = self.scratch.table(self._rows(kept.limit(0), 1), "rows"), None
            return Codebooks(np.zeros((self.parts, 0, 1), np.int64), size)
        seeds, _ = grid(pa.array([r["v"] for r in first], pa.list_(pa.float64())), self.scale, size)
        books = np.ascontiguousarray(cut(seeds, self.parts).transpose(1, 0, 2))
        self.rows = self.scratch.table(self._rows(kept, size), "rows")
        each = self.rows.select(F.posexplode("parts").alias("position", "part"))
        self.distinct = self.scratch.table(each.groupBy("position", "part").agg(F.count("*").alias("weight")), "distinct")
        for _ in range(self.rounds):
            books = self._round(books)
        return Codebooks(books, size)

    def _rows(self, kept: DataFrame, size: int) -> DataFrame:
        """(row: a number of its own, vec_id, label, parts: little-endian 32-bit integers of each position)."""
        scale, parts = self.scale, self.parts
        kind = dict(kept.dtypes)["label"]

        def work(batches):
            from pyspark import TaskContext

            row = TaskContext.get().partitionId() << 33
            for b in batches:
                q, have = grid(b.column(2), scale, size)
                if not len(have):
                    continue
                raw = cut(q, parts).astype("<i4")
                at = pa.array(have)
                blobs = pa.array([x.tobytes() for row in raw for x in row], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * raw.shape[1], pa.int32()), blobs)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(have))), b.column(0).take(at), b.column(1).take(at), lists], ["row", "vec_id", "label", "parts"])
                row += len(have)

        return kept.select("vec_id", "label", "v").mapInArrow(spans.tidy(work), f"row long, vec_id long, label {kind}, parts array<binary>")

    def _assign(self, books: np.ndarray):
        """A function over batches of (position, part, weight): for each position found, the rows, their parts, entries and squared distances."""
        shared, width = self.spark.sparkContext.broadcast(books), books.shape[2]  # parts x 256 x width integers, whatever the number of rows

        def go(b: pa.RecordBatch):
            position = b.column(0).to_numpy()
            parts = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
            for p in np.unique(position).tolist():
                rows = np.flatnonzero(position == p)
                yield p, rows, parts[rows], *nearest(parts[rows], shared.value[p])

        return go

    def _round(self, books: np.ndarray) -> np.ndarray:
        """The floor of the weighted mean of each entry's parts. Sums are made in the tasks, then over tasks; one row an entry comes to the driver."""
        go, n, width = self._assign(books), books.shape[1], books.shape[2]

        def work(batches):
            total, count = np.zeros((len(books), n, width), np.int64), np.zeros((len(books), n), np.int64)
            for b in batches:
                weight = b.column(2).to_numpy()
                for p, rows, parts, at, _ in go(b):
                    order = np.argsort(at, kind="stable")
                    entry, begin = np.unique(at[order], return_index=True)
                    w = weight[rows][order]
                    total[p, entry] += np.add.reduceat(parts[order] * w[:, None], begin, axis=0)
                    count[p, entry] += np.add.reduceat(w, begin)
            p, e = np.nonzero(count)
            if len(p):
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), sums], ["position", "entry", "n", "sums"])

        found = self.distinct.mapInArrow(spans.tidy(work), "position int, entry int, n long, sums array<long>")
        sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
        new = books.copy()
        for r in found.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums")).collect():
            new[r["position"], r["entry"]] = [s // r["n"] for s in r["sums"]]
        return new

    def codes(self, books: Codebooks) -> DataFrame:
        """(vec_id, code, error, label, label_error)."""
        if self.distinct is None:
            return self.rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label", F.lit(0).cast("long").alias("label_error"))
        go = self._assign(books.entries)

        def work(batches):
            for b in batches:
                code, error = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
                for _, rows, _, at, d in go(b):
                    code[rows], error[rows] = at, d
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(code), pa.array(error)], ["position", "part", "weight", "entry", "error"])

        coded = self.scratch.table(self.distinct.mapInArrow(spans.tidy(work), "position int, part binary, weight long, entry int, error long"), "coded")
        n = self.rows.count()
        each = self.rows.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part"))
        got = join_hot(each, coded, ["position", "part"], "weight", n)
        digits = F.lower(F.lpad(F.hex("entry"), 2, "0"))
        whole = got.groupBy("row").agg(
            F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.sum("error").alias("error"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", digits.alias("x")))), lambda s: s["x"]), "").alias("code"))
        whole = self.scratch.table(whole.drop("row"), "whole")
        by_label = whole.groupBy("label").agg(F.count("*").alias("weight"), F.sum("error").alias("label_error"))
        return join_hot(whole, self.scratch.table(by_label, "labels"), ["label"], "weight", n).select("vec_id", "code", "error", "label", "label_error")


def vector_codes(df: DataFrame, vector: str = "embedding", label: str = "label", **settings) -> DataFrame:
    """Compress df(vec_id, vector, label) to codes of one byte a part.

    Rows whose vector is null or holds a null or non-finite component are
    left out, and so are those whose number of components is not the most
    frequent one. Components become floor(scale * x); beyond 2^27 in size
    that is an error, as squared distances would leave 64 bits. Codebooks
    start as the parts of the least vec_ids (null ids last, equal ids by
    vector); each round moves every entry to the floor of the mean of its
    parts, entries without parts stay. Equal parts are one weighted row, so
    that a vector shared by a third of all rows costs one distance a round.

    Returns a row per row kept: vec_id, code (two hex digits a part), error
    (squared distances summed), label_error (error summed over equal labels,
    nulls together), codebooks_sha256. Repeated rows and ids give a row each;
    fewer than 256 rows make smaller codebooks; an empty table gives an
    empty table; further columns are ignored.
    """
    made = VectorCodes(df.sparkSession, **settings)
    books = made.fit(df, vector, label)
    return made.codes(books).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """DuckDB's SQL for vector_codes over embeddings, where all vectors have one size that parts divides."""
    n = [f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, vec_id, label, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS v FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r AS e, v AS c FROM cut WHERE r < {entries})"""]
    near = "SELECT cut.r, any_value(cut.vec_id) AS vec_id, any_value(cut.label) AS label, cut.p, any_value(cut.v) AS v, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(cut.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := b.e)) AS m FROM cut JOIN {b} b ON b.p = cut.p GROUP BY cut.r, cut.p"
    for k in range(rounds):
        n.append(f"""a{k} AS MATERIALIZED ({near.replace('{b}', f'b{k}')}),
x{k} AS (SELECT p, m.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}),
s{k} AS (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x{k} GROUP BY ALL),
f{k} AS (SELECT p, e, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS c FROM s{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(f.c, b.c) AS c FROM b{k} b LEFT JOIN f{k} f ON f.p = b.p AND f.e = b.e)""")
    n.append(f"""a AS ({near.replace('{b}', f'b{rounds}')}),
o AS (SELECT any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h""")
    return ",\n".join(n)

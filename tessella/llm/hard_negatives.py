"""Hard negatives by ball trees: rows of another label that score nearly as high as an anchor's positives."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .scratch import Scratch
from .vector_codes import common_size, finite, grid, products

#: Rows of a tree's leaf.
_LEAF = 128
#: Stands for no score.
_NONE = -(1 << 62)
#: Stands for a null vec_id, which comes last among equal scores.
_LAST = (1 << 63) - 1


@dataclass
class BallTree:
    """Vectors of integers in the order of the leaves. Of node i: the centre, a radius that holds all its rows, and the rows begin[i]..end[i]; its children are left[i] and right[i] (-1: a leaf)."""

    vectors: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def build(vectors: np.ndarray, leaf: int = _LEAF) -> BallTree:
        """Nodes are split at the median of the coordinate that spreads most; equal vectors need no split."""
        x = vectors.astype(np.float64)
        order = np.arange(len(x))
        centre, radius, begin, end, left, right = [], [], [], [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            i, j, parent, side = stack.pop()
            own = x[order[i:j]]
            low, high = own.min(axis=0), own.max(axis=0)
            c = own.mean(axis=0)
            node = len(centre)
            centre.append(c)
            radius.append(float(np.sqrt(((own - c) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6)
            begin.append(i)
            end.append(j)
            left.append(-1)
            right.append(-1)
            if parent >= 0:
                (right if side else left)[parent] = node
            if j - i > leaf and (high > low).any():
                k = int((high - low).argmax())
                mid = (j - i) // 2
                order[i:j] = order[i:j][np.argpartition(own[:, k], mid)]
                stack.append((i + mid, j, node, 1))
                stack.append((i, i + mid, node, 0))
        return BallTree(vectors[order], order, np.array(centre), np.array(radius), *[np.array(a, np.int64) for a in (begin, end, left, right)])

    def search(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, kth, visit) -> None:
        """Call visit(q, i, j, scores) with the queries q that may find rows i..j of the order worth having, and their inner products.

        A row's product with a query lies within norm x radius of that of the
        centre. A node is left out where that range ends below low or begins
        above high, or where it ends strictly beneath kth(q), a query's
        current k-th best score, which grows as visit() finds rows. All
        queries go down together, each node with those that it still
        concerns, the side that more of them score higher first.
        """
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        x = queries.astype(np.float64)

        def concerned(node: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = x[q] @ self.centre[node]
            reach = norm[q] * self.radius[node]
            slack = 1e-9 * (np.abs(at) + reach) + 1e-6
            top = at + reach + slack
            keep = (top >= low[q]) & (at - reach - slack <= high[q]) & (top >= kth(q))
            return q[keep], at[keep]

        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            q, _ = concerned(node, q)  # again: kth may have grown since the node was put down
            if not len(q):
                continue
            if self.left[node] < 0:
                i, j = int(self.begin[node]), int(self.end[node])
                for a in range(0, j - i, 4096):  # a leaf of equal vectors may be long
                    b = min(j, i + a + 4096)
                    visit(q, i + a, b, products(queries[q], self.vectors[i + a : b]))
                continue
            a, b = int(self.left[node]), int(self.right[node])
            sides = sorted(((s.mean() if len(own) else -np.inf, n, own) for n, (own, s) in ((n, concerned(n, q)) for n in (a, b))), key=lambda t: t[:2])
            stack.extend((n, own) for _, n, own in sides)


class Best:
    """The k best (score, falling; then vec_id, rising) of each query so far; floor: a score that k rows known already reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((queries, k), _NONE)
        self.ident = np.full((queries, k), _LAST)
        self.row = np.full((queries, k), -1, np.int64)

    def kth(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, -1], self.floor[q])

    def add(self, q: np.ndarray, scores: np.ndarray, idents: np.ndarray, rows: np.ndarray, fit: np.ndarray) -> None:
        fit &= scores >= self.kth(q)[:, None]
        some = np.flatnonzero(fit.any(axis=1))
        if not len(some):
            return
        q, fit = q[some], fit[some]
        s = np.concatenate([self.score[q], np.where(fit, scores[some], _NONE)], axis=1)
        d = np.concatenate([self.ident[q], np.where(fit, idents, _LAST)], axis=1)
        r = np.concatenate([self.row[q], np.where(fit, rows, -1)], axis=1)
        order = np.lexsort((r, d, r < 0, -s))[:, : self.k]
        for name, a in (("score", s), ("ident", d), ("row", r)):
            getattr(self, name)[q] = np.take_along_axis(a, order, axis=1)


@dataclass
class Queries:
    """What is looked for: rows of the query's label (same) or of others, but itself, with scores from low to high."""

    vectors: np.ndarray
    label: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool

    def fit(self, q: np.ndarray, scores: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
        alike = self.label[q][:, None] == labels
        found = (alike & (self.row[q][:, None] != rows)) if self.same else ~alike
        return found & (scores >= self.low[q][:, None]) & (scores <= self.high[q][:, None])


@dataclass
class Cells:
    """A space cut in halves at medians of a sample, into so many cells; for any number of rows 1024 at most. Inner nodes are numbered as in a heap.

    axis and at say where each inner node cuts; centre is the mean of a cell's
    sample, reach the largest distance of any row of the cell from it (known
    when all rows have been dealt out) and subs the number of trees that its rows are
    dealt out to.
    """

    depth: int
    axis: np.ndarray
    at: np.ndarray
    centre: np.ndarray
    reach: np.ndarray
    subs: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, cells: int) -> Cells:
        depth = (min(cells, 1024, max(1, len(sample))) - 1).bit_length()
        n, dims = 1 << depth, sample.shape[1]
        made = Cells(depth, np.zeros(n, np.int64), np.zeros(n), np.zeros((n, dims)), np.zeros(n), np.zeros(n, np.int64))
        own = [np.zeros(0, np.int64), np.arange(len(sample))]
        for node in range(1, n):
            x = sample[own[node]]
            if len(x):
                made.axis[node] = int((x.max(axis=0) - x.min(axis=0)).argmax())
                made.at[node] = float(np.median(x[:, made.axis[node]]))
            over = x[:, made.axis[node]] > made.at[node]
            own += [own[node][~over], own[node][over]]
        for c in range(n):
            if len(own[n + c]):
                made.centre[c] = sample[own[n + c]].mean(axis=0)
        return made

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        node = np.ones(len(vectors), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (vectors[np.arange(len(vectors)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)


class HardNegatives:
    """Rows of df(vec_id, label, vector) in ball trees that every search goes through.

    Rows are dealt out to cells, a cell's rows to trees of about tree_rows
    rows each, by a hash, so that a cell of very many equal vectors makes many
    trees. A tree is one row of a written table. Queries go to the trees of
    those cells whose ball their bounds allow, in blocks of about block
    queries, and each task holds one tree and one block.

    About sample rows, taken by hash, serve to place the cells and as a
    first bound on what a query's k-th best score is; a smaller sample makes
    bounds looser and never changes a result.
    """

    def __init__(self, df: DataFrame, vector: str = "embedding", label: str = "label", scale: float = 256.0, tree_rows: int = 16_384, block: int = 16_384, sample: int = 8192):
        self.spark, self.scratch, self.block = df.sparkSession, Scratch(df.sparkSession, "hard-negatives"), block
        kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(F.col("label").isNotNull() & finite("v"))
        self.size = common_size(kept, "v")
        self.rows = self.scratch.table(self._rows(kept.where(F.size("v") == self.size), scale), "rows")
        n = self.rows.count()
        if not n or not self.size:
            self.trees = None
            return
        every = max(1, n // sample)
        picked = sorted(self.rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).collect(), key=lambda r: r["row"])  # about sample rows, under twice as many
        self.picked = self._matrix([r["q"] for r in picked]), np.array([r["label"] for r in picked]), np.array([r["row"] for r in picked])
        self.cells = Cells.fit(self.picked[0], -(-n // tree_rows))
        self._plant(tree_rows)

    def _matrix(self, blobs: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), self.size).astype(np.int64)

    def _rows(self, kept: DataFrame, scale: float) -> DataFrame:
        """(row: a number of its own, vec_id, label, q: little-endian 32-bit integers)."""
        size = self.size

        def work(batches):
            from pyspark import TaskContext

            row = TaskContext.get().partitionId() << 33
            for b in batches:
                q, have = grid(b.column(2), scale, size)
                if len(have):
                    at = pa.array(have)
                    yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(have))), b.column(0).take(at), b.column(1).take(at), pa.array([x.tobytes() for x in q.astype("<i4")], pa.binary())], ["row", "vec_id", "label", "q"])
                    row += len(have)

        return kept.mapInArrow(spans.tidy(work), "row long, vec_id long, label long, q binary")

    def _plant(self, tree_rows: int) -> None:
        """Write the trees, a row each, and learn how far each cell reaches."""
        cells, size = self.cells, self.size

        def deal(batches):
            for b in batches:
                q = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i4").reshape(b.num_rows, size).astype(np.int64)
                cell = cells.of(q)
                far = np.sqrt(((q - cells.centre[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["row", "vec_id", "label", "q", "cell", "far"])

        dealt = self.rows.mapInArrow(spans.tidy(deal), "row long, vec_id long, label long, q binary, cell int, far double")
        for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # 1024 rows at most
            cells.subs[r["cell"]] = -(-r["n"] // tree_rows)
            cells.reach[r["cell"]] = r["far"] * (1 + 1e-9) + 1e-6
        subs = F.element_at(F.array(*[F.lit(int(s)) for s in cells.subs]), F.col("cell") + 1)
        placed = dealt.drop("far").withColumn("sub", F.pmod(F.xxhash64("row"), subs).cast("int"))

        def plant(key, t):
            q = np.frombuffer(b"".join(t["q"].to_pylist()), "<i4").reshape(t.num_rows, size).astype(np.int64)
            tree = BallTree.build(q)
            own = pa.array(tree.order)
            ident = t["vec_id"].fill_null(_LAST).take(own).to_numpy()
            blobs = {"ident": ident, "label": t["label"].take(own).to_numpy(), "row": t["row"].take(own).to_numpy(), "vectors": tree.vectors.astype("<i4"), "centre": tree.centre, "radius": tree.radius, "begin": tree.begin, "end": tree.end, "left": tree.left, "right": tree.right}
            return pa.table({"cell": [key[0].as_py()], "sub": [key[1].as_py()], **{k: [np.ascontiguousarray(v).tobytes()] for k, v in blobs.items()}}, schema=_TREE)

        self.trees = self.scratch.table(placed.groupBy("cell", "sub").applyInArrow(plant, "cell int, sub int, " + ", ".join(f"{f.name} binary" for f in list(_TREE)[2:])), "trees")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(query, score, vec_id, row, rank): the k best rows for each of queries(query, label, row, q, low, high), rows of the same label or of others; row is the query's own. Ties go to the smaller vec_id, null last."""
        cells, size = self.cells, self.size
        shared = self.spark.sparkContext.broadcast(self.picked)  # about sample rows, under twice as many
        names = ["query", "label", "row", "q", "low", "high"]

        def looked(b) -> Queries:
            col = lambda i: b.column(i).to_numpy()
            return Queries(np.frombuffer(b"".join(b.column(3).to_pylist()), "<i4").reshape(b.num_rows, size).astype(np.int64), col(1), col(2), col(4), col(5), same)

        def send(batches):
            """Each query to every tree of the cells that its bounds allow."""
            vectors, labels, rows = shared.value
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    want = looked(part)
                    best = Best(len(want.row), k, np.full(len(want.row), _NONE))
                    every = np.arange(len(want.row))
                    scores = products(want.vectors, vectors)
                    best.add(every, scores, np.zeros(len(rows), np.int64), rows, want.fit(every, scores, labels, rows))
                    floor = best.kth(every)
                    x = want.vectors.astype(np.float64)
                    at, reach = x @ cells.centre.T, np.sqrt((x * x).sum(axis=1))[:, None] * cells.reach
                    slack = 1e-9 * (np.abs(at) + reach) + 1e-6
                    go = (cells.subs > 0) & (at + reach + slack >= np.maximum(want.low, floor)[:, None]) & (at - reach - slack <= want.high[:, None])
                    q, cell = np.nonzero(go)
                    many = cells.subs[cell]
                    first = np.cumsum(many) - many
                    for a in range(0, int(many.sum()), 1 << 16):  # so many rows at a time, however many trees there are
                        n = np.arange(a, min(int(many.sum()), a + (1 << 16)))
                        pair = np.searchsorted(first, n, "right") - 1
                        taken = part.take(pa.array(q[pair]))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(floor[q[pair]]), pa.array(cell[pair].astype(np.int32)), pa.array((n - first[pair]).astype(np.int32))], [*names, "floor", "cell", "sub"])

        blocks = max(1, -(-queries.count() // self.block))
        sent = queries.select(*names).mapInArrow(spans.tidy(send), "query long, label long, row long, q binary, low long, high long, floor long, cell int, sub int").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        trees = self.trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def look(t, own):
            none = pa.table({"query": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64())})
            if not t.num_rows or not own.num_rows:
                return none
            get = lambda name, kind: np.frombuffer(t[name][0].as_py(), kind)
            tree = BallTree(get("vectors", "<i4").reshape(-1, size).astype(np.int64), np.zeros(0), get("centre", float).reshape(-1, size), get("radius", float), *[get(c, np.int64) for c in ("begin", "end", "left", "right")])
            ident, labels, rows = (get(c, np.int64) for c in ("ident", "label", "row"))
            want = looked(own.select(names).combine_chunks().to_batches()[0])
            best = Best(own.num_rows, k, own["floor"].to_numpy())
            tree.search(want.vectors, want.low, want.high, best.kth, lambda q, i, j, scores: best.add(q, scores, ident[i:j], rows[i:j], want.fit(q, scores, labels[i:j], rows[i:j])))
            q, at = np.nonzero(best.row >= 0)
            found = best.ident[q, at]
            return pa.table({"query": own["query"].to_numpy()[q], "score": best.score[q, at], "vec_id": pa.array(found, mask=found == _LAST), "row": best.row[q, at]})

        keys = ["cell", "sub", "block"]
        found = trees.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(look, "query long, score long, vec_id long, row long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


_TREE = pa.schema([("cell", pa.int32()), ("sub", pa.int32()), *[(c, pa.binary()) for c in ("ident", "label", "row", "vectors", "centre", "radius", "begin", "end", "left", "right")]])


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), **settings) -> DataFrame:
    """Mine hard negatives from df(vec_id, label, embedding).

    Rows with a null label or vector, or a null or non-finite component, take
    no part, nor do those whose number of components is not the most frequent one.
    Components become floor(scale * x) (an error beyond 2^27 in size), and a score is
    the integer inner product. Anchors are the rows whose vec_id is divisible
    by every; an anchor's positives are its best other rows of the same label.
    For each anchor and positive the best rows of other labels are returned
    with share[0] * positive_score <= share[1] * negative_score <= share[1] *
    positive_score, so none for a positive of negative score. Higher scores
    come first, equal ones by smaller vec_id, null ids last; rows that repeat a vec_id are rows of their
    own. An empty table gives an empty table; further columns are ignored.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.
    """
    made = HardNegatives(df, **settings)
    spark = df.sparkSession
    if made.trees is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    ends = F.lit(_NONE).alias("low"), F.lit(-_NONE).alias("high")
    anchors = made.scratch.table(made.rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), "vec_id", "label", "row", "q", *ends), "anchors")
    best = made.search(anchors, positives, same=True).select("query", F.col("vec_id").alias("positive_id"), F.col("score").alias("high"), F.col("rank").alias("n"))
    low = F.ceil(F.col("high").cast("decimal(30,0)") * share[0] / share[1]).cast("long")
    pairs = anchors.drop("low", "high").join(best, "query").where("high >= 0").select((F.col("query") * positives + F.col("n") - 1).alias("query"), F.col("vec_id").alias("anchor_id"), "positive_id", "label", "row", "q", low.alias("low"), "high")
    pairs = made.scratch.table(pairs, "pairs")
    found = made.search(pairs, negatives, same=False).select("query", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return pairs.join(found, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("high").alias("positive_score"), "negative_score")


def oracle() -> str:
    """DuckDB's SQL for the registered query, where vec_ids are there once."""
    return """WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

"""Exact similarity joins and nearest neighbours: vectors in cells around pivots, and only what the triangle inequality leaves is compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..joins import join_hot
from ..lineage import cut

#: Bounds are widened by this much against rounding.
_SLACK = 1e-7
#: Rows of a block.
BLOCK = 4096
#: Cells at most, so that pivots are few whatever the number of rows.
_CELLS = 1024


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1 if blobs else 0)


def packed(df: DataFrame, vector: str, cosine: bool, *also: str) -> DataFrame:
    """df(idx, vector) as (idx, q: little-endian doubles, *also); for cosines of length one, not-a-number and infinite entries 0."""

    def work(batches):
        for b in batches:
            off = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy(zero_copy_only=False).astype(np.float64)
            rows = []
            for i, j in zip(off[:-1], off[1:], strict=True):
                v = np.nan_to_num(flat[i:j], nan=0.0, posinf=0.0, neginf=0.0) if cosine else flat[i:j]
                norm = np.sqrt((v * v).sum()) if cosine else 0.0
                rows.append(((v / norm if norm > 0 else v) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), *b.columns[2:]], ["idx", "q", *also])

    kinds = dict(df.dtypes)
    return df.select(F.col("idx").cast("long").alias("idx"), F.col(vector).cast("array<double>").alias("v"), *also).mapInArrow(work, "idx long, q binary" + "".join(f", {c} {kinds[c]}" for c in also))


@dataclass
class Cells:
    """Pivots, how far the farthest row of each cell is from its pivot, and how many blocks its rows are dealt out to. The last cell holds the zero vectors of a cosine space, which have similarity 0 to everything."""

    cosine: bool
    pivots: np.ndarray
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distance, or angle, of each row from each pivot."""
        if self.cosine:
            return np.arccos(np.clip(x @ self.pivots.T, -1, 1))
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and how far from its pivot the row is."""
        far = self.away(x)
        cell = far.argmin(axis=1)
        far = far[np.arange(len(x)), cell]
        if self.cosine:
            zero = ~x.any(axis=1)
            cell[zero], far[zero] = len(self.pivots), 0.0
        return cell, far

    def best(self, x: np.ndarray) -> np.ndarray:
        """The highest score that any row of each cell can have with each of x: a cosine, or a distance with its sign changed. Cells without rows have none.

        Two bounds hold for a cell: its rows are within its reach of the
        pivot, and nearer to it than to x's own pivot, so behind the plane
        half way between the two.
        """
        if len(self.blocks) == 1:
            return np.full((len(x), 1), np.inf)
        away = self.away(x)
        slack = _SLACK * (1 if self.cosine else 1 + np.abs(x).max(initial=0))
        near = np.maximum(away - self.reach[: len(self.pivots)] - slack, 0)
        chord = 2 * np.sin(away / 2) if self.cosine else away
        own = chord.argmin(axis=1)
        between = np.sqrt(np.maximum((self.pivots[own][:, None, :] - self.pivots[None, :, :]) ** 2, 0).sum(axis=2)) if self.pivots.size * len(x) < 1 << 22 else np.stack([np.sqrt(((self.pivots - self.pivots[o]) ** 2).sum(axis=1)) for o in own.tolist()])
        plane = np.divide(chord**2 - chord[np.arange(len(x)), own][:, None] ** 2, 2 * between, out=np.zeros_like(chord), where=between > 1e-9) - slack
        if not self.cosine:
            return np.where(self.blocks > 0, -np.maximum(near, plane), -np.inf)
        score = np.minimum(np.cos(np.minimum(near, np.pi)), 1 - np.maximum(plane, 0) ** 2 / 2)
        score = np.concatenate([score, np.zeros((len(x), 1))], axis=1)
        score[~x.any(axis=1)] = 0.0
        return np.where(self.blocks > 0, score + _SLACK, -np.inf)


def scores(x: np.ndarray, y: np.ndarray, cosine: bool) -> np.ndarray:
    if cosine:
        return np.round(x @ y.T, 12)
    return -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances row by row, the same from either side."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


class Nearby:
    """df(idx, q, ...) in cells, each cell's rows in blocks of about block_rows rows; a block is one row of a written table.

    Pivots are the means of a few rounds of Lloyd's over about 16 rows a
    cell, taken by hash: where they lie decides what is pruned, never a result. A
    cell with very many rows (equal ones, say) makes many blocks. carried
    names further long or double columns that go with the rows.
    """

    def __init__(self, points: DataFrame, cosine: bool, carried: tuple[str, ...] = (), cell_rows: int = 1024, block_rows: int = BLOCK, visitors: int = 32_768, n: int | None = None):
        self.spark, self.points, self.cosine, self.carried, self.visitors = points.sparkSession, points, cosine, carried, visitors
        self.n = points.count() if n is None else n
        if self.n <= block_rows:  # one block: nothing to prune
            self._single()
            return
        n_cells = max(1, min(_CELLS, self.n // cell_rows))
        every = max(1, self.n // (16 * n_cells))
        few = points.select("idx", "q").where(F.pmod(F.xxhash64("idx"), F.lit(every)) == 0) if n_cells > 1 else points.select("idx", "q").limit(1)
        sample = [r["q"] for r in sorted(few.collect(), key=lambda r: r["idx"])]  # about 16 rows a cell
        sample = sample or [r["q"] for r in points.select("q").limit(1).collect()]
        self.cells = Cells(cosine, self._pivots(matrix(sample), n_cells))
        self._deal(block_rows)

    def _single(self) -> None:
        self.cells = Cells(self.cosine, np.zeros((1, 0)), np.full(1, np.inf), np.ones(1, np.int64))
        self._pack(self.points.select("idx", "q", *self.carried).withColumns({"cell": F.lit(0), "far": F.lit(0.0)}))

    def _pivots(self, x: np.ndarray, n: int) -> np.ndarray:
        p = np.array(x[:n])
        for _ in range(5 if n > 1 else 0):
            own = Cells(False, p).away(x).argmin(axis=1)
            for c in np.unique(own):
                p[c] = x[own == c].mean(axis=0)
        if self.cosine:
            norm = np.linalg.norm(p, axis=1, keepdims=True)
            p = np.divide(p, norm, out=np.eye(1, x.shape[1]).repeat(len(p), 0), where=norm > 0)
        return p

    def again(self, points: DataFrame, carried: tuple[str, ...]) -> Nearby:
        """The same points in the same cells with other columns beside them."""
        other = Nearby.__new__(Nearby)
        other.__dict__.update(self.__dict__)
        other.points, other.carried = points, carried
        if len(self.cells.blocks) == 1:
            other._single()
        else:
            other._pack(other._dealt())
        return other

    def _dealt(self) -> DataFrame:
        cells, carried = self.cells, self.carried
        kinds = dict(self.points.dtypes)

        def deal(batches):
            for b in batches:
                cell, far = cells.home(matrix(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["idx", "q", *carried, "cell", "far"])

        return self.points.select("idx", "q", *carried).mapInArrow(deal, "idx long, q binary" + "".join(f", {c} {kinds[c]}" for c in carried) + ", cell int, far double")

    def _deal(self, block_rows: int) -> None:
        cells, dealt = self.cells, self._dealt()
        total = len(cells.pivots) + self.cosine
        cells.reach, cells.blocks = np.zeros(total), np.zeros(total, np.int64)
        for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row a cell
            cells.reach[r["cell"]], cells.blocks[r["cell"]] = r["far"], -(-r["n"] // block_rows)
        self._pack(dealt)

    def _pack(self, dealt: DataFrame) -> None:
        carried = self.carried
        blocks = F.element_at(F.array(*[F.lit(max(1, int(k))) for k in self.cells.blocks]), F.col("cell") + 1)
        self.placed = dealt.drop("far").withColumn("block", F.pmod(F.xxhash64("idx"), blocks).cast("int"))

        def pack(key, t):
            t = t.take(pa.array(np.argsort(t["idx"].to_numpy(), kind="stable")))
            blobs = [t["idx"].to_numpy().tobytes(), b"".join(t["q"].to_pylist()), *[t[c].to_numpy().tobytes() for c in carried]]
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], ["cell", "block", "ids", "vectors", *[f"of_{c}" for c in carried]])

        blobs = self.placed.groupBy("cell", "block").applyInArrow(pack, "cell int, block int, ids binary, vectors binary" + "".join(f", of_{c} binary" for c in carried))
        self.blobs = blobs if len(self.cells.blocks) == 1 else cut(blobs)

    def _opener(self):
        """A function from a block's row to its ids, vectors and carried columns."""
        kinds = dict(self.points.dtypes)
        carried = [(f"of_{c}", np.float64 if kinds[c] == "double" else np.int64) for c in self.carried]
        return lambda blob: (np.frombuffer(blob["ids"], np.int64), np.frombuffer(blob["vectors"], "<f8").reshape(len(blob["ids"]) // 8, -1), [np.frombuffer(blob[c], t) for c, t in carried])

    def inside(self, compare: Callable, schema: str) -> DataFrame:
        """compare(block, (cell, block number)) of every block, as Arrow tables."""
        opened = self._opener()

        def work(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for blob in b.to_pylist():
                    yield from compare(opened(blob), (blob["cell"], blob["block"])).to_batches()

        return self.blobs.mapInArrow(work, schema)

    def visit(self, queries: DataFrame, wanted: Callable, compare: Callable, schema: str) -> DataFrame:
        """compare(block, (cell, block number), queries as an Arrow table) for each block that queries may reach.

        queries: (idx, q, floor double, cell, block, *carried), where cell and
        block are a query's home. wanted(best, batch) tells, from the highest score that each
        cell can offer to each query of an Arrow batch, which cells to
        visit. A cell's queries go in blocks too, so that no task holds more
        than a block of rows and about visitors queries.
        """
        cells, carried, opened = self.cells, list(self.carried), self._opener()
        names = ["idx", "q", "floor", "cell", "block", *carried]
        kinds = dict(queries.dtypes)
        shape = ", ".join(f"{c} {kinds[c]}" for c in names)

        def reach(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            return np.nonzero(wanted(cells.best(matrix(b.column(1).to_pylist())), b))

        def count(batches):
            total = np.zeros(len(cells.blocks), np.int64)
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    total += np.bincount(reach(b.slice(i, 1024))[1], minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["to", "n"])

        asked = queries.select(*names)
        parts = np.ones(len(cells.blocks), np.int64)
        if len(cells.blocks) > 1 or self.n > self.visitors:
            for r in asked.mapInArrow(count, "to int, n long").groupBy("to").agg(F.sum("n").alias("n")).collect():
                parts[r["to"]] = -(-r["n"] // self.visitors)

        def send(batches):
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    q, cell = reach(part)
                    many = cells.blocks[cell]
                    first = np.cumsum(many) - many
                    for a in range(0, int(many.sum()), 1 << 15):
                        n = np.arange(a, min(int(many.sum()), a + (1 << 15)))
                        pair = np.searchsorted(first, n, "right") - 1
                        taken = part.take(pa.array(q[pair]))
                        ids = taken.column(0).to_numpy()
                        deal = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell[pair]]
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell[pair].astype(np.int32)), pa.array((n - first[pair]).astype(np.int32)), pa.array(deal.astype(np.int32))], [*names, "to_cell", "to_block", "part"])

        sent = asked.mapInArrow(send, shape + ", to_cell int, to_block int, part int")
        many = F.element_at(F.array(*[F.lit(int(k)) for k in parts]), F.col("cell") + 1)
        blobs = self.blobs.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).withColumnsRenamed({"cell": "to_cell", "block": "to_block"})
        empty = pa.table({c: pa.array([], t) for c, t in _schema(schema)})

        def look(rows, own):
            if not rows.num_rows or not own.num_rows:
                return empty
            blob = rows.to_pylist()[0]
            return compare(opened(blob), (blob["to_cell"], blob["to_block"]), own)

        keys = ["to_cell", "to_block", "part"]
        return blobs.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(look, schema)


def _schema(text: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return [(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")]


def _pairs(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "sim": pa.array(s, pa.float64())})


def similar_pairs(df: DataFrame, threshold: float, vector: str = "embedding", **sizes) -> DataFrame:
    """(i, j, sim): pairs i < j of df(idx, vector) with cosine of threshold or more.

    Every row goes to its own cell and to those others in one of the two
    directions between cells where a row of cosine threshold may be, by the
    angle between pivots and rows; the fewer, the higher the threshold. Zero
    vectors have cosine 0.
    """
    n, points = df.count(), packed(df, vector, cosine=True)
    if not n:
        return df.sparkSession.createDataFrame([], "i long, j long, sim double")
    near = Nearby(points if n <= sizes.get("block_rows", BLOCK) else cut(points), cosine=True, n=n, **sizes)

    def wanted(best: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        home, to = b.column(3).to_numpy()[:, None], np.arange(best.shape[1])[None, :]
        return (best >= threshold - _SLACK) & np.where((home + to) % 2 == 1, to > home, to <= home)

    def pairs(idx: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, same: np.ndarray) -> pa.Table:
        out = [_pairs([], [], [])]
        for a in range(0, len(idx), 1024):
            s = scores(x[a : a + 1024], y, True)
            q, r = np.nonzero(s >= threshold)
            i, j = idx[a + q], ids[r]
            keep = (i < j) | (~same[a + q] & (i != j))
            out.append(_pairs(np.minimum(i, j)[keep], np.maximum(i, j)[keep], s[q, r][keep]))
        return pa.concat_tables(out)

    def compare(block, at, own) -> pa.Table:
        ids, vectors, _ = block
        cell, number = own["cell"].to_numpy(), own["block"].to_numpy()
        use = np.flatnonzero((cell != at[0]) | (number >= at[1]))
        same = (cell[use] == at[0]) & (number[use] == at[1])
        return pairs(own["idx"].to_numpy()[use], matrix(own["q"].take(pa.array(use)).to_pylist()), ids, vectors, same)

    if int(near.cells.blocks.sum()) == 1:
        return near.inside(lambda block, at: pairs(block[0], block[1], block[0], block[1], np.ones(len(block[0]), bool)), "i long, j long, sim double")
    return near.visit(near.placed.withColumn("floor", F.lit(0.0)), wanted, compare, "i long, j long, sim double")


def _top(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, floor: np.ndarray, cosine: bool, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of x the k best of y but itself, with scores of floor or more: rows of x, rows of y, scores, by row and falling score, equal ones by sign x id."""
    out = []
    for a in range(0, len(x), 512):
        s = scores(x[a : a + 512], y, cosine)
        s[ids[a : a + 512][:, None] == others[None, :]] = -np.inf
        least = floor[a : a + 512]
        if s.shape[1] > k:
            least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1])
        slack = 0 if cosine else _SLACK * (1 + np.abs(x).max(initial=0))
        q, r = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        v = s[q, r] if cosine else -exact(x[a + q], y[r])
        order = np.lexsort((sign * others[r], -v, q))
        q, r, v = q[order], r[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = (rank < k) & (v >= floor[a + q] - slack)
        out.append((a + q[keep], r[keep], v[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest_points(near: Nearby, k: int, least: float = -np.inf, ties: str = "low") -> DataFrame:
    """(i, j, sim, rank): the k best others of every point, of score least or more.

    A point's own block comes first. Its k-th best score there is what
    another cell must be able to offer; only such cells are visited.
    """
    cosine, sign = near.cosine, 1 if ties == "low" else -1
    shape = "idx long, q binary, floor double, cell int, block int, js array<bigint>, ss array<double>"

    def own_block(block, at) -> pa.Table:
        ids, vectors, _ = block
        q, r, v = _top(ids, vectors, ids, vectors, k, np.full(len(ids), least), cosine, sign)
        begin = np.searchsorted(q, np.arange(len(ids) + 1))
        many = np.diff(begin)
        floor = np.full(len(ids), least)
        full = many == k
        floor[full] = v[begin[1:][full] - 1]
        lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(c)) for c in (ids[r], v)]
        return pa.table([pa.array(ids), pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array(floor), pa.array([at[0]] * len(ids), pa.int32()), pa.array([at[1]] * len(ids), pa.int32()), *lists], ["idx", "q", "floor", "cell", "block", "js", "ss"])

    def wanted(best: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return best >= b.column(2).to_numpy()[:, None] - _SLACK

    def compare(block, at, own) -> pa.Table:
        ids, vectors, _ = block
        use = own.filter(pa.array((own["cell"].to_numpy() != at[0]) | (own["block"].to_numpy() != at[1])))
        i, x = use["idx"].to_numpy(), matrix(use["q"].to_pylist())
        q, r, v = _top(i, x, ids, vectors, k, use["floor"].to_numpy(), cosine, sign)
        return _pairs(i[q], ids[r], v)

    first = near.inside(own_block, shape)
    if int(near.cells.blocks.sum()) > 1:
        first = cut(first)
    found = first.select(F.col("idx").alias("i"), F.arrays_zip("js", "ss").alias("z")).select("i", F.explode("z").alias("z")).select("i", F.col("z.js").alias("j"), F.col("z.ss").alias("sim"))
    if int(near.cells.blocks.sum()) > 1:
        found = found.unionByName(near.visit(first.drop("js", "ss"), wanted, compare, "i long, j long, sim double"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), F.asc("j") if ties == "low" else F.desc("j")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def distinct_points(df: DataFrame, vector: str, cosine: bool, copies: int, ties: str = "low") -> tuple[DataFrame, DataFrame, bool]:
    """The distinct vectors as points(idx: of the first copy, q, n: copies, first: the first copies), all rows(idx, of), and whether there are any copies."""
    rows, low = packed(df, vector, cosine), ties == "low"
    points = cut(rows.groupBy("q").agg((F.min if low else F.max)("idx").alias("idx"), F.count("*").alias("n")))
    count, total = points.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count == total:
        return points.withColumn("first", F.array("idx")), points.select("idx", F.col("idx").alias("of")), False
    of = cut(join_hot(cut(rows), points.withColumnRenamed("idx", "of"), ["q"], "n", total).select("idx", "of"))
    first = _first_copies(of, copies, low)
    return cut(points.join(first, "idx")), of, True


def _first_copies(of: DataFrame, copies: int, low: bool) -> DataFrame:
    """(idx, first): the first copies of each point of of(idx, of); a group's ranking stops at so many."""
    at = F.row_number().over(Window.partitionBy("of").orderBy(F.asc("idx") if low else F.desc("idx")))
    few = of.withColumn("at", at).where(F.col("at") <= copies)
    return few.groupBy("of").agg(F.sort_array(F.collect_list("idx"), low).alias("first")).withColumnRenamed("of", "idx")


def nearest_rows(df: DataFrame, k: int, threshold: float | None = None, ties: str = "low", vector: str = "embedding", **sizes) -> DataFrame:
    """(i, j, sim, rank): each row's k nearest others of df(idx, vector) by cosine, of threshold or more; equal ones by lower or higher idx.

    Equal vectors are one point, which keeps its first k + 1 copies, so that
    a vector shared by a third of all rows is searched once.
    """
    points, rows, copies = distinct_points(df, vector, True, k + 1, ties)
    least = -np.inf if threshold is None else threshold
    near = Nearby(points.select("idx", "q"), cosine=True, **sizes)
    if not near.n:
        return df.sparkSession.createDataFrame([], "i long, j long, sim double, rank int")
    found = nearest_points(near, k, least, ties)
    if not copies:
        return found
    zero = F.col("q") == F.lit(bytes(len(points.first()["q"])))
    own = points.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.when(zero, 0.0).otherwise(1.0).alias("sim"))
    listed = found.select("i", "j", "sim").unionByName(own.where(F.col("sim") >= F.lit(float(least)))).join(points.select(F.col("idx").alias("j"), "first"), "j")
    listed = listed.select("i", "sim", F.explode("first").alias("j"))
    order = [F.desc("sim"), F.asc("j") if ties == "low" else F.desc("j")]
    best = listed.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where(F.col("rank") <= k + 1)
    lists = points.select(F.col("idx").alias("i"), "n").join(best.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "j", "sim"))).alias("z")), "i").select(F.col("i").alias("of"), "z", "n")
    total = points.agg(F.sum("n")).first()[0]
    each = join_hot(rows, cut(lists), ["of"], "n", total)
    others = F.slice(F.filter("z", lambda z: z["j"] != F.col("idx")), 1, k)
    return each.select(F.col("idx").alias("i"), F.posexplode(others).alias("at", "z")).select("i", F.col("z.j").alias("j"), F.col("z.sim").alias("sim"), (F.col("at") + 1).alias("rank"))

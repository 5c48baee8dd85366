"""Repeated passages of words, wherever they stand in a line, by a distributed suffix array over words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .scratch import Scratch, one_per_id, partitions

U = np.uint64
#: At most so many words have the prefixes that the first ranks tell apart; each doubling starts from there.
_GRAM = 16
#: One prefix of so many (by its hash's low bits) is looked at when unlike suffixes are first sorted out.
_SAMPLED = 4
#: Positions of a block, give or take a document.
_BLOCK = 1 << 18
#: A rank's low bits count within its bucket; the bucket's number is above them.
_LOCAL = 44
#: The sign of a rank that no later round reads.
_SETTLED = np.int64(-1 << 63)
_STATE = "block long, docs binary, begin binary, size binary, rank binary"
_COLUMNS = ("docs", "begin", "size", "rank")


class _Sums:
    """Hashes of any range of a piece's words in constant time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.pw, self.inv = spans._power(len(starts) + 1)
        self.total = np.zeros(len(starts) + 1, U)
        np.cumsum(spans.span_hash(data, starts, ends) * self.pw[: len(starts)], out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return spans.mix((self.total[end] - self.total[begin]) * self.inv[begin] + (end - begin).astype(U))


def _gram(n: int) -> int:
    """Words of the first prefixes on the way to n: two doublings are left."""
    return min(_GRAM, (n + 2) // 3)


def _ladder(many: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of many, one after the other."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _blocks(rows, size: int):
    """Rows of the state from (docs, begin, size, rank) of single pieces, about size ranks together."""
    from pyspark import TaskContext

    at, held, have = TaskContext.get().partitionId() << 32, [], 0

    def row():
        columns = [pa.array([np.concatenate(x).astype(np.int64, copy=False).tobytes()], pa.binary()) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *columns], ["block", *_COLUMNS])

    for r in rows:
        held.append(r)
        have += len(r[3])
        if have >= size:
            yield row()
            at, held, have = at + 1, [], 0
    if held:
        yield row()


def _cells(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], np.int64) for c in _COLUMNS)


def _sorted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, heads, of): the keys' order, where in it the first two change, and each place's class."""
    order = np.lexsort(keys[1::-1])
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _earliest(doc: np.ndarray, start: np.ndarray, heads: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """The least (doc, start) of each class."""
    least = np.minimum.reduceat(doc, heads)
    return [least, np.minimum.reduceat(np.where(doc == least[of], start, np.iinfo(np.int64).max), heads)]


def _round(state: DataFrame, keys: Callable, put: Callable, schema: str, buckets: int, tell: str = "rank") -> DataFrame:
    """put(block, cells, answers) for each row of the state, with an answer for each position of keys(cells): (rank, second[, doc, start]).

    By tell, the answer is: "rank", the new rank, which is the rank and the
    number of positions of that rank whose second key is smaller, all over
    the corpus, settled if no other position has both keys; "once", whether
    that is so; "first", whether doc and start are the least of all positions
    with both keys. A block sends each pair of keys once, with its number, to
    the task of the rank's bucket, so that no number of equal prefixes makes
    a large task. Ascending numbers travel as differences, which pack well.
    """
    names = ["k1", "k2", "doc", "start"]

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                k = keys(_cells(row))
                if not len(k[0]):
                    continue
                order, heads, of = _sorted(k)
                many = np.diff(np.append(heads, len(order)))
                k = [k[0][order[heads]], k[1][order[heads]], *(_earliest(k[2][order], k[3][order], heads, of) if k[2:] else [])]
                cut = np.searchsorted(k[0] >> _LOCAL, np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    part = slice(cut[i], cut[i + 1])
                    cells = [np.diff(k[0][part], prepend=0).tobytes(), *[x[part].tobytes() for x in k[1:]], *[b""] * (4 - len(k)), many[part].astype(np.int32).tobytes()]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([i], pa.int32()), "block": pa.array([row["block"]], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip([*names, "n"], cells, strict=True)}})

    def join(column, kind=np.int64, sums=False):
        cells = [np.frombuffer(x, kind) for x in column.to_pylist()]
        return np.concatenate([np.cumsum(x) for x in cells] if sums else cells)

    def answer(t: pa.Table) -> pa.Table:
        k = [x for x in (join(t.column(c), sums=c == "k1") for c in names) if len(x)]
        order, heads, of = _sorted(k)
        told = np.empty(len(order), np.int64)
        if tell == "first":
            doc, start = _earliest(k[2][order], k[3][order], heads, of)
            told[order] = (k[2][order] == doc[of]) & (k[3][order] == start[of])
        else:
            size = np.add.reduceat(join(t.column("n"), np.int32)[order].astype(np.int64), heads)
            before, rank = np.cumsum(size) - size, k[0][order[heads]]
            new = np.append(True, rank[1:] != rank[:-1])
            less = before - before[np.flatnonzero(new)][np.cumsum(new) - 1]
            told[order] = ((size == 1) + (2 * (rank + less) if tell == "rank" else 0))[of]
        at = np.cumsum([0] + [len(x) // 8 for x in t.column("k1").to_pylist()])
        cells = [told[i:j] for i, j in zip(at, at[1:], strict=False)]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "told": pa.array([np.diff(x, prepend=0).tobytes() for x in cells], pa.binary())})

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        cells, block = _cells(left.to_pylist()[0]), left.column("block")[0].as_py()
        k = keys(cells)
        got = np.empty(len(k[0]), np.int64)
        if len(got):
            order, heads, of = _sorted(k)
            told = join(right.sort_by("bucket").column("told"), sums=True)[of]
            if tell == "first":
                doc, start = _earliest(k[2][order], k[3][order], heads, of)
                told = told * ((k[2][order] == doc[of]) & (k[3][order] == start[of]))
            got[order] = np.where(told & 1, _SETTLED, np.int64(0)) | (told >> 1) if tell == "rank" else told
        return put(block, cells, got)

    asked = state.mapInArrow(spans.tidy(ask), "bucket int, block long, k1 binary, k2 binary, doc binary, start binary, n binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, told binary")
    return state.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(merge, schema)


def _first(buckets: int) -> Callable:
    """Keys of a state whose ranks are hashes as yet: the bucket and the hash."""
    return lambda cells: [((((cells[3].view(U) >> U(32)) * U(buckets)) >> U(32)) << U(_LOCAL)).view(np.int64), cells[3]]


def _table(schema: str, columns: list) -> pa.Table:
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    kind = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.table({n: pa.array(c, kind[k]) if isinstance(c, list) else c for n, k, c in zip(names, kinds, columns, strict=True)})


def _by_doc(schema: str, doc: np.ndarray, *lists: np.ndarray) -> pa.Table:
    """A row per document with its lists; entries of a document stand together."""
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    cut = pa.array(np.append(head, len(doc)), pa.int32())
    return _table(schema, [pa.array(doc[head], pa.int64()), *[pa.ListArray.from_arrays(cut, pa.array(x, pa.int64())) for x in lists]])


def _open(cells: tuple, n: int, gram: int, depth: int) -> np.ndarray:
    """Whether each position of the state begins n words all of whose prefixes of depth words are unsettled."""
    _, _, size, rank = cells
    dead = np.append(0, np.cumsum(rank < 0))
    out = np.zeros(len(rank), bool)
    reach = n - depth
    if len(rank) > reach:
        out[: len(rank) - reach] = dead[reach + 1 :] == dead[: len(rank) - reach]
    return out & (_ladder(size) < np.repeat(size - (n - gram), size))


def candidates(docs: DataFrame, n: int, buckets: int, scratch: Scratch) -> DataFrame:
    """(id, begins, many): ranges of suffixes of docs(doc_id, text) that are unsettled by a first look at one prefix of `_SAMPLED`.

    A suffix is settled where a sampled prefix within its first n words
    occurs once in the corpus: then these n words do, too. Whether a
    prefix is sampled depends on its words alone.
    """
    gram = _gram(n)

    def grams(batches):
        def rows():
            for b in batches:
                off, data = spans.buffers(b.column(1))
                for i, j in spans.pieces(off):
                    part, bounds = data[off[i] : off[j]], off[i : j + 1] - off[i]
                    w, e, first = spans.words(part, bounds)
                    words = np.diff(first)
                    has = np.flatnonzero(words >= n)
                    if len(has):
                        have = words[has] - gram + 1
                        at = np.repeat(first[has], have) + _ladder(have)
                        g = _Sums(part, w, e).of(at, at + gram)
                        # places in the line-up of these documents' words, with one free place after each
                        place = np.repeat(np.cumsum(words[has] + 1) - words[has] - 1, have) + _ladder(have)
                        some = np.flatnonzero(g % U(_SAMPLED) == 0)
                        yield b.column(0).take(pa.array(i + has)).to_numpy(), place[some], words[has], g[some].view(np.int64)

        # a block's places go on from piece to piece
        def lined():
            base = count = 0
            for doc, place, words, g in rows():
                yield doc, place + base, words, g
                base, count = base + int((words + 1).sum()), count + len(g)
                if count >= _BLOCK:
                    base = count = 0

        yield from _blocks(lined(), _BLOCK)

    def ranges(block, cells, got):
        doc, place, words, _ = cells
        start = np.cumsum(words + 1) - words - 1
        once = place[got == 1]
        mark = np.zeros(int((words + 1).sum()) + 1, np.int64)
        np.add.at(mark, np.maximum(once - (n - gram), start[np.searchsorted(start, once, "right") - 1]), 1)
        np.add.at(mark, once + 1, -1)
        many = words + 1
        fine = (np.cumsum(mark[:-1]) == 0) & (_ladder(many) < np.repeat(many - n, many))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], fine.astype(np.int8), [0]]))).reshape(-1, 2)
        of = np.searchsorted(start, edge[:, 0], "right") - 1
        return _by_doc("id long, begins array<long>, many array<long>", doc[of], edge[:, 0] - start[of], edge[:, 1] - edge[:, 0])

    found = scratch.table(docs.select("doc_id", "text").mapInArrow(spans.tidy(grams), _STATE), "grams")
    asked = scratch.table(_round(found, _first(buckets), ranges, "id long, begins array<long>, many array<long>", buckets, "once"), "asked")
    scratch.drop(found)
    return asked


def suffixes(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """The state: per block and range of suffixes its document, first position and number of positions, and per position the hash of its first prefix."""
    gram = _gram(n)

    def work(batches):
        def rows():
            for b in batches:
                off, data = spans.buffers(b.column(1))
                for i, j in spans.pieces(off):
                    part, bounds = data[off[i] : off[j]], off[i : j + 1] - off[i]
                    w, e, first = spans.words(part, bounds)
                    mine = b.slice(i, j - i)
                    row = np.repeat(np.arange(j - i), np.diff(mine.column(2).offsets.to_numpy()))
                    begin, many = (mine.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
                    size = many + n - gram
                    at = np.repeat(first[row] + begin, size) + _ladder(size)
                    yield mine.column(0).to_numpy()[row], begin, size, _Sums(part, w, e).of(at, at + gram).view(np.int64)

        yield from _blocks(rows(), _BLOCK)

    both = docs.join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("id"))
    return both.select("doc_id", "text", "begins", "many").mapInArrow(spans.tidy(work), _STATE)


def _keys(n: int, depth: int, step: int, buckets: int) -> Callable:
    """The positions of a state whose ranks by depth + step words are needed, with their two keys."""
    if not depth:
        return lambda cells: (np.arange(len(cells[3])), _first(buckets)(cells))

    def work(cells):
        # those from which an open suffix begins at most n - depth - step words before
        seen = np.append(0, np.cumsum(_open(cells, n, _gram(n), depth)))
        at = np.arange(len(cells[3]))
        at = np.flatnonzero(seen[at + 1] > seen[np.maximum(at - (n - depth - step), 0)])
        return at, [cells[3][at], cells[3][at + step]]

    return work


def deepen(state: DataFrame, n: int, depth: int, step: int, buckets: int) -> DataFrame:
    """The state with ranks by the first depth + step words, from those by depth words; with depth 0 from the hashes of the first step words.

    Prefix doubling: a position's rank is refined by that of the position
    step words on. Positions that lie in no n words that may occur twice
    are settled, and no later round looks at them.
    """
    needed = _keys(n, depth, step, buckets)

    def put(block, cells, got):
        rank = np.full(len(cells[3]), _SETTLED)
        rank[needed(cells)[0]] = got
        if (rank < 0).all():
            return _table(_STATE, [[]] * 5)
        return _table(_STATE, [[block], *[[x.tobytes()] for x in (*cells[:3], rank)]])

    return _round(state, lambda cells: needed(cells)[1], put, _STATE, buckets)


def intervals(state: DataFrame, n: int, depth: int, step: int, buckets: int) -> DataFrame:
    """(doc_id, starts, stops): the ranges of n words of all suffixes but the earliest of each interval of the suffix array whose common prefix is n words or more.

    The last step of prefix doubling, from depth to depth + step = n: such an
    interval is a run of equal ranks by n words. A row per document.
    """
    schema, needed = "doc_id long, starts array<long>, stops array<long>", _keys(n, depth, step, buckets)

    def places(cells, at):
        doc, begin, size, _ = cells
        return [np.repeat(doc, size)[at], (np.repeat(begin, size) + _ladder(size))[at]]

    def keys(cells):
        at, k = needed(cells)
        return [*k, *places(cells, at)]

    def put(block, cells, got):
        doc, start = places(cells, needed(cells)[0])
        later = np.flatnonzero(got == 0)
        doc, start = doc[later], start[later]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(head)
        last = np.append(head[1:], len(doc)) - 1
        return _by_doc(schema, doc[head], start[head], start[last[: len(head)]] + n)

    return _round(state, keys, put, schema, buckets, "first")


def repeated_words(docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(doc_id, starts, stops): ranges of words, overlapping and in no order, that together are all windows of n words with an equal window at an earlier place.

    The suffix array over the words of all documents, sorted by prefix
    doubling as deep as n words: suffixes of a common prefix of n words or
    more form an interval then, in whatever order they would stand in it.
    """
    buckets = partitions(docs.sparkSession)
    asked = candidates(docs, n, buckets, scratch)
    state = scratch.table(suffixes(docs, asked, n), "suffixes")
    scratch.drop(asked)
    depth, step = 0, _gram(n)
    while depth + step < n:
        finer = scratch.table(deepen(state, n, depth, step, buckets), f"ranks-{depth + step}")
        scratch.drop(state)
        state, depth = finer, depth + step
        step = min(depth, n - depth)
    ranges = scratch.table(intervals(state, n, depth, step, buckets), "ranges")
    scratch.drop(state)
    return ranges


def without(text: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """text without the words of the ranges. Of the white space around a gap stays that before it if it has a newline, else that behind it; at the text's start that before it, at its end that behind it. Nothing stays of a text without a word left."""
    data = np.frombuffer(text, np.uint8)
    w, e, _ = spans.words(data, np.array([0, len(data)]))
    mark = np.zeros(len(w) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, stops, -1)
    gone = np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
    if len(edge) == 1 and edge[0, 1] - edge[0, 0] == len(w):
        return b""
    out, at = [], 0
    for a, z in edge.tolist():
        before = int(e[a - 1]) if a else 0
        after = int(w[z]) if z < len(w) else len(text)
        if a == 0 or (z < len(w) and b"\n" in text[before : w[a]]):
            out.append(text[at : w[a]])
            at = after
        else:
            out.append(text[at:before])
            at = int(e[z - 1])
    return b"".join([*out, text[at:]])


def passage_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later copies of repeated passages deleted, and the columns n_lines and n_deleted.

    Words are runs of other than ASCII white space, compared byte for byte;
    the white space between them, line breaks included, does not matter. A
    passage of min_words words or more that also begins at an earlier place
    (order: doc_id, then word; the copies may overlap) is deleted wherever
    it begins or ends; the first copy stays. A passage is repeated just when
    all its windows of min_words words are, so what goes is the union of the
    longest earlier matches; the windows are found as the intervals of a
    suffix array over words (repeated_words).

    n_lines counts the lines of the text, n_deleted how many fewer the text
    has then (all if no word is left). Null texts stay null, with n_lines 0.
    A null doc_id's text is left as it is. Rows with one doc_id and one text
    are treated alike, as one document; of different texts with one doc_id
    only the least is looked at, the others stay as they are. Input columns
    named n_lines or n_deleted are replaced, all others stay.
    """
    docs = docs.drop("n_lines", "n_deleted")
    scratch = Scratch(docs.sparkSession, "passages")
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    once, twice = one_per_id(mine)
    gone = repeated_words(once, min_words, scratch).select(F.col("doc_id").alias("__id"), F.col("starts").alias("__starts"), F.col("stops").alias("__stops"))
    same = F.lit(True)
    if twice:
        gone = gone.join(once.select(F.col("doc_id").alias("__id"), F.sha2("text", 256).alias("__of")), "__id")
        same = F.sha2("text", 256) == F.col("__of")
    names = docs.columns
    both = docs.join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("__id")) & same, "left").select(F.col("text").alias("__text"), "__starts", "__stops", *[c for c in names if c != "text"])

    def cut(batches):
        for b in batches:
            text, ends = b.column(0).to_pylist(), []
            for i in np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False)).tolist():
                text[i] = without(text[i].encode(), *(np.array(b.column(k)[i].as_py(), np.int64) for k in (1, 2))).decode()
            lines = [0 if x is None else x.count("\n") + 1 for x in b.column(0).to_pylist()]
            for x, y, valid in zip(text, lines, b.column(1).is_valid().to_pylist(), strict=True):
                ends.append(0 if not valid else y if not x else y - x.count("\n") - 1)
            rest = iter(b.columns[3:])
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else next(rest) for c in names] + [pa.array(lines, pa.int64()), pa.array(ends, pa.int64())], [*names, "n_lines", "n_deleted"])

    return both.mapInArrow(spans.tidy(cut), docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_deleted")).schema)

"""Packing of token sequences by a configuration linear program."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans
from .scratch import Scratch
from .wordpieces import WordEncoder, rest


@dataclass
class Plan:
    """Of each slot: the length it takes, the first ordinal among pieces of that length, how many follow in as many sequences, the first sequence and the offset there. Sorted by (length, ordinal)."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    lp: float


def _price(y: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: best value of each capacity, and the length taken last (0: none, capacity left over)."""
    lengths = np.flatnonzero(y > 0)
    value = y[lengths]
    best = np.zeros(limit + 1)
    take = np.zeros(limit + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(limit + 1), "right")
    for w in range(1, limit + 1):
        best[w] = best[w - 1]
        k = upto[w]
        if k:
            got = best[w - lengths[:k]] + value[:k]
            j = int(got.argmax())
            if got[j] > best[w]:
                best[w], take[w] = got[j], lengths[j]
    return best, take


def _fill(capacity: int, take: np.ndarray) -> list[int]:
    out = []
    while capacity > 0:
        if take[capacity]:
            out.append(int(take[capacity]))
            capacity -= out[-1]
        else:
            capacity -= 1
    return out


def solve(demand: np.ndarray, limit: int, gap: float = 0.002, step: float = 0.01, rate: float = 40.0, slack: float = 0.01, most: int = 300) -> tuple[dict[tuple[int, ...], float], float]:
    """A fractional solution of the configuration LP, configuration (lengths, falling) -> how many sequences, and a lower bound on any packing.

    Multiplicative weights: a length's price is its size times
    exp(-rate * covered share of its demand). A knapsack over the prices gives
    the best configuration that begins with each length; those within slack
    of the best one are used, each for a step-th of the demand of its
    scarcest length, as long as their price stays that high. Nothing is used
    up: what is covered too often grows cheap until the others have caught
    up. Prices also bound the optimum: no configuration is worth more than
    the best one, so price of all demand / price of the best one sequences are
    needed at least. The loop ends when the sum over coverage is within gap of
    the best bound, or after so many (most) prices.
    """
    lengths = np.flatnonzero(demand)
    if not len(lengths):
        return {}, 0.0
    d = demand[lengths].astype(float)
    at = np.zeros(limit + 1, np.int64)
    at[lengths] = np.arange(len(lengths))
    covered, used, x = np.zeros(len(lengths)), 0.0, {}
    start, settled = covered.copy(), np.zeros(limit + 1)
    bound = float((lengths * d).sum() / limit)
    for k in range(most):
        price = lengths * np.exp(-rate * (covered - covered.min()))
        y = np.zeros(limit + 1)
        y[lengths] = price
        best, take = _price(y, limit)
        bound = max(bound, float((price * d).sum() / best[limit]))
        settled += y / best[limit]
        if k % 20 == 19:  # the mean of prices bounds better than each of them
            bound = max(bound, float((settled[lengths] * d).sum() / _price(settled, limit)[0][limit]))
        if used and used <= (1 + gap) * bound * (covered - start).min():
            break
        if k in (most // 6, most // 2):
            # the prices stay: a share covered of -log(price) / rate stands for each
            step, rate = step / 2, rate * 3
            start = (covered - covered.min()) * (rate / 3) / rate
            covered, used, x = start.copy(), 0.0, {}
            settled[:] = 0
        value = price + best[limit - lengths]
        order = np.argsort(-value, kind="stable")
        for j in order[: int((value >= best[limit] * (1 - slack)).sum())].tolist():
            config = tuple(sorted([int(lengths[j]), *_fill(limit - int(lengths[j]), take)], reverse=True))
            kinds, many = np.unique(at[list(config)], return_counts=True)
            if (price[kinds] * many).sum() < best[limit] * (1 - slack):
                continue
            much = step * float((d[kinds] / many).min())
            x[config] = x.get(config, 0.0) + much
            used += much
            more = much * many / d[kinds]
            covered[kinds] += more
            price[kinds] *= np.exp(-rate * more)
    share = float(((covered - start) * lengths * d).sum() / (lengths * d).sum())
    return {c: v / share for c, v in x.items()}, bound


def best_fit(counts: np.ndarray, limit: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over a histogram: configuration -> how many sequences. Alike sequences are filled together, so the work follows the number of lengths, not that of pieces."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    mask, full = 0, {}

    def put(config: tuple[int, ...], room: int, many: int) -> None:
        nonlocal mask
        if room:
            free.setdefault(room, []).append((config, many))
            mask |= 1 << room
        else:
            full[config] = full.get(config, 0) + many

    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            above = mask >> length
            if above:
                room = length + (above & -above).bit_length() - 1
                config, many = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
            else:
                room, config, many = limit, (), left
            each = room // length
            whole = min(many, left // each)
            if whole:
                put(config + (length,) * each, room - each * length, whole)
            left -= whole * each
            many -= whole
            if many and left and left < each:
                put(config + (length,) * left, room - left * length, 1)
                left, many = 0, many - 1
            if many and config:
                put(config, room, many)
    for groups in free.values():
        for config, many in groups:
            full[config] = full.get(config, 0) + many
    return full


def rounded(x: dict[tuple[int, ...], float], demand: np.ndarray, limit: int) -> dict[tuple[int, ...], int]:
    """Whole sequences of a fractional solution: the whole parts first, then one of each configuration that the sum of the parts left over steps past, as far as the demand goes; the rest by best fit."""
    left, out = demand.astype(np.int64).copy(), {}

    def use(config: tuple[int, ...], k: int) -> int:
        kinds, many = np.unique(config, return_counts=True)
        k = min(k, int((left[kinds] // many).min()))
        if k > 0:
            left[kinds] -= k * many
            out[config] = out.get(config, 0) + k
        return max(k, 0)

    for config, v in sorted(x.items(), key=lambda i: (-i[1], i[0])):
        use(config, int(v + 1e-9))
    owed = 0.0
    for config, v in sorted(x.items(), reverse=True):
        owed += v - int(v + 1e-9)
        if owed >= 0.5 and use(config, 1):
            owed -= 1
    for config, k in best_fit(left, limit).items():
        out[config] = out.get(config, 0) + k
    return out


def plan(demand: np.ndarray, limit: int) -> Plan:
    """The better of the rounded LP solution and best fit over the whole histogram; lp is the lower bound on any packing."""
    x, bound = solve(demand, limit)
    whole = min((rounded(x, demand, limit), best_fit(demand, limit)), key=lambda w: sum(w.values()))
    rows, sequence = [], 0
    used = np.zeros(limit + 1, np.int64)
    for c, k in sorted(whole.items(), reverse=True):
        if not k:
            continue
        at = 0
        for length in c:
            rows.append((length, used[length], k, sequence, at))
            used[length] += k
            at += length
        sequence += k
    assert (used == demand).all()
    t = np.array(sorted(rows) or np.zeros((0, 5)), np.int64)
    return Plan(t[:, 0], t[:, 1], t[:, 2], t[:, 3], t[:, 4], sequence, bound)


def pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], part, ordinal) of every text's ids with end_id; ordinal counts the pieces of a length within the task part."""

    def work(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        encoder, end = WordEncoder.of(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            off, data = spans.buffers(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in spans.pieces(off, 1 << 21):
                raw = data[off[i] : off[j]].tobytes()
                rel = (off[i : j + 1] - off[i]).tolist()
                rows = []
                for doc, tokens in zip(ids[i:j], encoder.encode([raw[x:y] for x, y in zip(rel, rel[1:], strict=False)]), strict=True):
                    tokens += end
                    for k, at in enumerate(range(0, len(tokens), 4 * limit)):
                        cut = tokens[at : at + 4 * limit]
                        rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut))
                doc, k, start, length, crc, cut = zip(*rows, strict=True)
                size = np.array(length)
                order = np.argsort(size, kind="stable")
                sorted_ = size[order]
                ordinal = np.empty(len(size), np.int64)
                ordinal[order] = np.arange(len(size)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(size, minlength=limit + 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    **({"ids": pa.array(cut, pa.binary())} if keep_ids else {}), "part": pa.array([part] * len(doc), pa.int32()), "ordinal": ordinal})
        rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(spans.tidy(work), "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "part int, ordinal long")


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most limit tokens.

    A text's ids (tokenizer: a file of a tokenizer that drops white space)
    are followed by end_id; only longer ones are cut, into pieces of limit
    tokens, the last one shorter. The histogram of piece lengths (at most
    limit rows, whatever the data's size) goes to the driver, where the
    configuration LP is solved and rounded; a piece's place follows from its
    length and its ordinal among pieces of that length, so no task sees more
    than its own pieces, and a length that a third of all pieces share makes
    no group.

    Returns a row per piece: doc_id, piece, start (ids before it in its
    document), length, ids_crc32, [ids: little-endian 32-bit], sequence_id,
    offset (gapless from 0). Null and empty texts are one piece of length 1.
    Rows with a null doc_id are packed too; repeated rows are packed each;
    further columns are ignored; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.table(pieces(docs, tokenizer, limit, end_id, keep_ids), "pieces")
    each = scratch.table(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    demand = np.zeros(limit + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():
        demand[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(plan(demand, limit))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.table(each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "base")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    numbered = cut.join(base, ["part", "length"]).select(*columns, (F.col("ordinal") + F.col("base")).alias("ordinal"))
    types = dict(numbered.dtypes)

    def place(batches):
        p = shared.value
        starts = (p.length << 40) + p.first
        for b in batches:
            length, ordinal = b.column(columns.index("length")).to_numpy(), b.column(len(columns)).to_numpy()
            at = np.searchsorted(starts, (length << 40) + ordinal, "right") - 1
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(columns))], pa.array(p.sequence[at] + ordinal - p.first[at]), pa.array(p.offset[at])], [*columns, "sequence_id", "offset"])

    return numbered.mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence_id long, offset long")

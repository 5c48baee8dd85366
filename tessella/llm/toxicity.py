"""Toxicity scores of a character n-gram linear classifier with naive Bayes feature scaling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .scratch import Scratch

#: Character n-grams of text in small letters, white space as one kind of character, hashed to 2^18 features.
_SIZES = (4, 5, 6)
_BITS = 18
_SLICES = 16
#: Bytes of text in a piece of rows, and characters of one text looked at in one go.
_PIECE = 1 << 18
_BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(max(_SIZES))], np.uint64)


@dataclass
class Model:
    """weight: a float32 per hashed feature, 0 for those not selected; probability of a text without any selected feature is that of bias."""

    weight: np.ndarray
    bias: float


def _grams(text: np.ndarray, wanted: np.ndarray | None):
    """(place, feature) of all n-grams of code points, size by size."""
    code = text.astype(np.uint64)
    for n in range(2, max(_SIZES) + 1):
        code = code[:-1] + text[n - 1 :] * _POWERS[n - 1]
        if n not in _SIZES or not len(code):
            continue
        f = ((code * np.uint64(_FACTOR + 2 * n)) >> np.uint64(64 - _BITS)).astype(np.int32)
        at = np.flatnonzero(wanted[f]) if wanted is not None else np.arange(len(f))
        yield n, at, f[at]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def features(off: np.ndarray, data: np.ndarray, i: int, j: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of rows i..j, by row: the character n-grams of each text with a space before and after it; wanted: a mask of features. A text of more than a piece is looked at in overlapping parts."""
    raw, rel = data[off[i] : off[j]].tobytes(), (off[i : j + 1] - off[i]).tolist()
    texts = [raw[a:b].decode("utf-8", "replace").lower().translate(_BLANKS) for a, b in zip(rel, rel[1:], strict=False)]
    if j - i == 1 and len(texts[0]) > _PIECE:
        text, there = f" {texts[0]} ", np.zeros(1 << _BITS, bool)
        for at in range(0, len(text), _PIECE):
            for _, _, f in _grams(_points(text[at : at + _PIECE + max(_SIZES) - 1]), wanted):
                there[f] = True
        f = np.flatnonzero(there)
        return np.zeros(len(f), np.int64), f
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    rows, feats = [], []
    for n, at, f in _grams(_points(" " + " ".join(texts) + " "), wanted):
        row = np.searchsorted(bounds, at, "right") - 1
        inside = (row < j - i) & (at + n <= bounds[np.minimum(row + 1, j - i)] + 1)
        rows.append(row[inside])
        feats.append(f[inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((np.concatenate(rows) << _BITS) | np.concatenate(feats))
    return both >> _BITS, both & ((1 << _BITS) - 1)


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = 120, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam on features of value ratio[f]; rows hold each text's distinct features."""
    n, size = len(rows), len(ratio)
    col = np.concatenate(rows) if n else np.zeros(0, np.uint16)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    w, b = np.zeros(size), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    balance = np.where(y == 1, n / max(1, 2 * y.sum()), n / max(1, 2 * (n - y.sum())))
    for t in range(1, steps + 1):
        z = np.bincount(row, (w * ratio)[col], n) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.sqrt(balance) / n
        g = np.bincount(col, err[row], size) * ratio + penalty * w
        gb = err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + t / 40)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w * ratio, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 8192, min_chi: float = 24.0, max_entries: int = 8_000_000) -> Model:
    """Fit on labels(doc_id, toxic) of docs(doc_id, text).

    max_rows bounds the labelled rows used (those of least hash of doc_id),
    so their ids can be broadcast; max_entries bounds the (row, selected
    feature) pairs, of two bytes each, that come to the driver: of the rows in
    the order of that hash, those that fit take part in the regression. Each class's count of texts with a feature is summed over tasks
    in an array of fixed size; the log of the ratio of the smoothed, summed
    to one counts scales the feature. The max_features features of largest
    chi-square, of at least min_chi (chance rarely gives more), enter the
    regression. Rows without a label or with a null
    doc_id are not used; of repeated doc_ids the larger label counts. With
    one class only, or without documents, no feature is selected. Features of
    equal chi-square are taken by their number. Null texts are empty, long
    ones are read whole, further columns are ignored.
    """
    if max_features > 1 << 16:
        raise ValueError("max_features is 65536 at most")
    spark = docs.sparkSession
    some = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in some] or [(None, None)], "id long, toxic int")
    used = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id").select("text", "toxic", "id")

    def count(batches):
        total = np.zeros((2, 1 << _BITS), np.int32)
        texts = np.zeros(2, np.int64)
        for b in batches:
            off, data = spans.buffers(b.column(0))
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts += np.bincount(y, minlength=2)
            for i, j in spans.pieces(off, _PIECE):
                row, f = features(off, data, i, j)
                for c in (0, 1):
                    total[c] += np.bincount(f[y[i:j][row] == c], minlength=1 << _BITS).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES + 1), pa.int32()), "counts": pa.array([*[x.tobytes() for x in total.reshape(2, _SLICES, -1).swapaxes(0, 1)], texts.astype(np.int32).tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"slice": t.column("slice").slice(0, 1), "counts": pa.array([sum(np.frombuffer(x.as_py(), np.int32) for x in t.column("counts")).astype(np.int32).tobytes()], pa.binary())})

    got = {r["slice"]: np.frombuffer(r["counts"], np.int32) for r in used.select("text", "toxic").mapInArrow(spans.tidy(count), "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()}
    if not got or not (texts := got[_SLICES]).all():
        n = got[_SLICES] if got else np.zeros(2)
        return Model(np.zeros(1 << _BITS, np.float32), float(np.log((n[1] + 1) / (n[0] + 1))))
    neg, pos = np.concatenate([got[k].reshape(2, -1) for k in range(_SLICES)], axis=1).astype(float)
    ratio = np.log((pos + 1) / (pos + 1).sum()) - np.log((neg + 1) / (neg + 1).sum())
    n0, n1 = map(float, texts)
    chi = (pos * (n0 - neg) - neg * (n1 - pos)) ** 2 * (n0 + n1) / (n0 * n1 * np.maximum(1, pos + neg) * np.maximum(1, n0 + n1 - pos - neg))
    best = np.argsort(-chi, kind="stable")[:max_features]
    chosen = np.sort(best[chi[best] >= min_chi])
    mask = np.zeros(1 << _BITS, bool)
    mask[chosen] = True
    shared = spark.sparkContext.broadcast(np.packbits(mask))

    def pick(batches):
        want = np.unpackbits(shared.value).astype(bool)
        place = (np.cumsum(want) - 1).astype(np.uint16)
        for b in batches:
            off, data = spans.buffers(b.column(0))
            for i, j in spans.pieces(off, _PIECE):
                row, f = features(off, data, i, j, want)
                at = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column(2).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([place[f[x:y]].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())], ["id", "toxic", "f"])

    picked = Scratch(spark, "toxicity").table(used.select("text", "toxic", "id").mapInArrow(spans.tidy(pick), "id long, toxic int, f binary").withColumn("h", F.xxhash64("id")), "picked")
    size = picked.select("h", "id", (F.octet_length("f") / 2).cast("long").alias("n")).collect()  # max_rows rows of three numbers
    size = sorted((r["h"], r["id"], r["n"]) for r in size)
    fits = np.cumsum([n for _, _, n in size]) <= max_entries
    last = size[max(0, int(fits.sum()) - 1)][0] if size else 0
    rows = sorted(picked.where(F.col("h") <= last).collect(), key=lambda r: (r["h"], r["id"], bytes(r["f"])))
    weight, bias = _fit([np.frombuffer(r["f"], np.uint16) for r in rows], np.array([r["toxic"] for r in rows]), ratio[chosen])
    full = np.zeros(1 << _BITS, np.float32)
    full[chosen] = weight
    return Model(full, float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (double, 0 to 1): the model's probability that a text is toxic, from the whole text.

    Null texts score as empty ones; long texts are read in parts, rows one by
    one, so repeated rows score alike and an empty table gives an empty one. An
    input column named score is replaced, all others stay.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    at, names = docs.columns.index("text"), docs.columns

    def work(batches):
        weight, bias = shared.value
        want = weight != 0
        for b in batches:
            off, data = spans.buffers(b.column(at))
            out = np.full(len(off) - 1, bias)
            for i, j in spans.pieces(off, _PIECE):
                row, f = features(off, data, i, j, want)
                out[i:j] += np.bincount(row, weight[f], j - i)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(spans.tidy(work), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels of documents whose crc32(doc_id as text) mod 3 is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)

"""Packing without padding: documents split into pieces whose lengths are powers of two, in buckets of equal length."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans
from .scratch import Scratch
from .wordpieces import WordEncoder, rest


@lru_cache(1 << 16)
def cuts(n: int, limit: int) -> tuple[tuple[int, int], ...]:
    """(start, length) of the pieces of n tokens: limit (a power of two) as often as it fits, then the powers of two that add up to the rest, falling. No other cut into powers of two up to limit has fewer pieces."""
    out = [(at, limit) for at in range(0, n - limit + 1, limit)]
    at = len(out) * limit
    while at < n:
        length = 1 << ((n - at).bit_length() - 1)
        out.append((at, length))
        at += length
    return tuple(out)


def pieces(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], part, ordinal) of every text's ids with end_id; ordinal counts the pieces of a length within the task part."""

    def work(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(limit.bit_length(), np.int64)
        encoder, end = WordEncoder.of(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            off, data = spans.buffers(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in spans.pieces(off, 1 << 21):
                raw = data[off[i] : off[j]].tobytes()
                rel = (off[i : j + 1] - off[i]).tolist()
                doc, start, length, crc, total, cut = [], [], [], [], [], []
                for d, tokens in zip(ids[i:j], encoder.encode([raw[x:y] for x, y in zip(rel, rel[1:], strict=False)]), strict=True):
                    tokens += end
                    n = len(tokens) // 4
                    for at, size in cuts(n, limit):
                        own = tokens[4 * at : 4 * (at + size)]
                        doc.append(d)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own))
                        total.append(n)
                        if keep_ids:
                            cut.append(own)
                bucket = np.log2(length).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ranked = bucket[order]
                ordinal = np.empty(len(bucket), np.int64)
                ordinal[order] = np.arange(len(bucket)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(bucket, minlength=len(seen))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()),
                    **({"ids": pa.array(cut, pa.binary())} if keep_ids else {}), "part": pa.array([part] * len(doc), pa.int32()), "ordinal": ordinal})
        rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(spans.tidy(work), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids binary, " * keep_ids + "part int, ordinal long")


def binary_split(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 2, keep_ids: bool = False, batch_tokens: int = 1 << 19) -> DataFrame:
    """Split docs(doc_id, text) into sequences whose lengths are powers of two up to limit (itself one).

    A text's ids (tokenizer: a file of a tokenizer that drops white space)
    are followed by end_id and cut as in cuts(); every piece is a sequence of
    its own, so no sequence crosses documents and none is padded. Sequences
    of one length form a bucket. They are numbered without gaps over the
    whole corpus, buckets with the longest first, from a piece's ordinal in
    its task and the counts of the tasks before: no task sees more than its
    own pieces, and the driver sees one count for each length.

    Returns a row per piece: doc_id, start (ids before it in its document),
    length, ids_crc32, doc_tokens, [ids: little-endian 32-bit], sequence_id,
    offset (always 0), batch (batches of one bucket hold batch_tokens tokens,
    or one sequence where that is longer; the last one of a bucket may hold
    fewer). Null and empty texts are one piece of length 1. A very long text
    is many pieces of limit tokens. Rows with a null doc_id are split too;
    repeated rows are split each; further columns, whatever their names, are
    ignored; an empty table gives an empty table.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    scratch = Scratch(docs.sparkSession, "binary-split")
    cut = scratch.table(pieces(docs, tokenizer, limit, end_id, keep_ids), "pieces")
    each = scratch.table(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, at, batch = [], 0, 0
    for length in sorted(totals, reverse=True):  # at most one entry for each power of two
        per = max(1, batch_tokens // length)
        rows.append((length, at, batch, per))
        at += totals[length]
        batch += -(-totals[length] // per)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def by_length(i: int):
        return F.coalesce(*[F.when(F.col("length") == r[0], F.lit(r[i])) for r in rows], F.lit(0)).cast("long")

    number = F.col("ordinal") + F.col("base")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    return cut.join(base, ["part", "length"]).select(*columns, (by_length(1) + number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (by_length(2) + F.floor(number / F.greatest(by_length(3), F.lit(1)))).alias("batch"))


def write_buckets(split: DataFrame, path: str) -> None:
    """The sequences of binary_split(keep_ids=True) as Parquet, a folder length=... for each bucket. A bucket's batches are dealt out over tasks, so that the commonest length makes many files."""
    split.repartition("length", "batch").sortWithinPartitions("length", "batch", "sequence_id").write.partitionBy("length").parquet(path)

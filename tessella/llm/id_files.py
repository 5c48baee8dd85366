"""Token-id shards: a file format of coded id blocks with a document index, written and read through Spark."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .id_coder import BLOCK, decode, encode
from .scratch import Scratch, partitions
from .wordpieces import ChunkEncoder

MAGIC = b"TIDS2\n"
#: Bytes of the texts of a shard, and four for each text, give or take a document.
_SHARD = 20_000_000
#: Blocks that are coded in step.
_LANES = 2048


def pack_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's bytes, all numbers little-endian: magic, numbers of documents and blocks (32-bit), per document its id and number of ids (64-bit), per block the length of its code (32-bit), crc32 of all that, then the blocks in order. Blocks have BLOCK ids, the last one fewer."""
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    blocks = [b for i in range(0, len(blocks), _LANES) for b in encode(blocks[i : i + _LANES])]
    head = np.array([len(doc_ids), len(blocks)], "<u4").tobytes() + np.array([doc_ids, counts], "<i8").tobytes() + np.array([len(b) for b in blocks], "<u4").tobytes()
    return MAGIC + head + np.array([zlib.crc32(head)], "<u4").tobytes() + b"".join(blocks)


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a shard; a wrong magic or checksum is a ValueError."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id shard")
    at = len(MAGIC)
    n, k = map(int, np.frombuffer(data, "<u4", 2, at))
    end = at + 8 + 16 * n + 4 * k
    if zlib.crc32(data[at:end]) != int(np.frombuffer(data, "<u4", 1, end)[0]):
        raise ValueError("index checksum")
    docs, counts = np.frombuffer(data, "<i8", 2 * n, at + 8).reshape(2, n)
    sizes = np.append(0, np.cumsum(np.frombuffer(data, "<u4", k, at + 8 + 16 * n).astype(np.int64))) + end + 4
    blocks = [data[x:y] for x, y in zip(sizes, sizes[1:], strict=False)]
    ids = [x for i in range(0, k, _LANES) for x in decode(blocks[i : i + _LANES])]
    return docs, counts, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, before, shard): docs(doc_id, text) in ascending doc_id as shards; before: ids in this part before the shard. Parts follow each other in doc_id; null doc_ids are left out, equal ones stand in any order."""
    ordered = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")

    def work(batches):
        from pyspark import TaskContext

        part, before, encoder, end = TaskContext.get().partitionId(), 0, ChunkEncoder.of(tokenizer), end_id.to_bytes(4, "little")
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal held, size, before
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            ids, bounds = encoder.encode_column(table.column(1).chunk(0), end)
            shard = pack_shard(table.column(0).to_numpy(), np.diff(bounds), ids)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "shard": pa.array([shard], pa.binary())})
            before += len(ids)
            return row

        for b in batches:
            off, _ = spans.buffers(b.column(1))
            for i, j in spans.pieces(off, _SHARD):
                if held and size + off[j] - off[i] + 4 * (j - i) > _SHARD * 5 // 4:
                    yield flush()
                held.append(b.slice(i, j - i))
                size += int(off[j] - off[i]) + 4 * (j - i)
        if held:
            yield flush()

    return ordered.mapInArrow(work, "part int, before long, shard binary")


def read_shards(shards: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids_crc32[, ids]) of every document of the shards; start counts within the part."""
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def work(batches):
        for b in batches:
            for part, before, shard in zip(*(b.column(i) for i in range(3)), strict=True):
                docs, counts, ids = unpack_shard(shard.as_py())
                at = np.append(0, np.cumsum(counts))
                raw = [ids[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part.as_py()] * len(docs), pa.int32()), "doc_id": docs, "start": at[:-1] + before.as_py(), "n_tokens": counts,
                    "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()), **({"ids": pa.array(raw, pa.binary())} if keep_ids else {})})

    return shards.select("part", "before", "shard").mapInArrow(work, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Encode docs(doc_id, text), write the ids as shards in ascending doc_id order, and read the files back.

    The shards are rows of a table in the shared folder. Every block of 4096
    ids is coded from the start state and carries checksums of its code and
    its ids, so a damaged block is found and harms no other.

    Returns doc_id, start (ids of all documents before it), n_tokens (with
    end_id), ids_crc32[, ids]. Null and empty texts have end_id alone; rows
    with a null doc_id are left out; repeated rows are written each, in any
    order; further columns are ignored; an empty table gives an empty one.
    A text of any length is encoded whole, in one task.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    shards = scratch.table(write_shards(docs, tokenizer, end_id), "shards")
    found = scratch.table(read_shards(shards, keep_ids), "documents")
    sums, base, total = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), [], 0
    for r in sorted(sums, key=lambda r: r["part"]):
        base.append((r["part"], total))
        total += r["n"]
    base = docs.sparkSession.createDataFrame(base or [(-1, 0)], "part int, base long")
    columns = ["doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return found.join(F.broadcast(base), "part").select(*columns)

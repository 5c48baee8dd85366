"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .scratch import partitions

#: Text of a block of documents; a block's words and ids are what a task holds at a time.
_BLOCK = 8 << 20
#: Words that a task keeps of its slice; beyond them, it starts anew.
_KEEP = 400_000


def _squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their bytes plane by plane."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _open(raw) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def split_words(docs: DataFrame) -> DataFrame:
    """(block, check, doc_ids, counts, codes, words) of docs(doc_id, text): about 8 MB of text in the order of the rows, as the distinct words of the block (check: their crc32) and every document's words as numbers into them."""

    def work(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, counts, codes, index, size = [], [], [], {}, 0

        def block():
            words = b"\n".join(index)
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "check": pa.array([zlib.crc32(words)], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([_squeeze(np.array(counts, np.uint32))], pa.binary()), "codes": pa.array([_squeeze(np.array(codes, np.uint32))], pa.binary()), "words": pa.array([zstandard.ZstdCompressor(level=3).compress(words)], pa.binary())})

        for b in batches:
            off, data = spans.buffers(b.column(1))
            for i, doc in enumerate(b.column(0).to_pylist()):
                n = int(off[i + 1] - off[i])
                if ids and size + n > _BLOCK:
                    yield block()
                    number, ids, counts, codes, index, size = number + 1, [], [], [], {}, 0
                words = data[off[i] : off[i + 1]].tobytes().split()
                ids.append(doc)
                counts.append(len(words))
                for w in words:
                    codes.append(index.setdefault(w, len(index)))
                size += n
        if ids:
            yield block()

    return docs.mapInArrow(work, "block long, check long, doc_ids array<long>, counts binary, codes binary, words binary")


def encode_words(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """(block, check, numbers, ids): of a block's words with one remainder of their hash, the numbers and ids.

    A bundle holds those words of one block; the bundles of one remainder
    (slice) meet in a task in turn, and a word is encoded where it comes
    first. There are no more bundles than words in blocks, and
    a task holds a batch of them and a bounded table of words.
    """
    slices = 4 * partitions(blocks.sparkSession)

    def deal(batches):
        for b in batches:
            for block, check, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = zstandard.ZstdDecompressor().decompress(raw.as_buffer())
                words = words.split(b"\n") if words else []
                slot = np.fromiter((zlib.crc32(w) % slices for w in words), np.int64, len(words))
                order = np.argsort(slot, kind="stable")
                cut = np.flatnonzero(np.diff(slot[order], prepend=-1)) if len(order) else []
                press = zstandard.ZstdCompressor(level=3).compress
                rows = [(int(slot[own[0]]), _squeeze(np.diff(own, prepend=0)), press(b"\n".join([words[i] for i in own.tolist()]))) for own in np.split(order, cut[1:]) if len(own)]
                yield pa.RecordBatch.from_pydict({"slice": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "check": pa.array([check] * len(rows), pa.int64()), "numbers": pa.array([r[1] for r in rows], pa.binary()), "words": pa.array([r[2] for r in rows], pa.binary())})

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.no_truncation()
        model.no_padding()
        at, table = None, {}
        for b in batches:
            out = []
            for slot, raw in zip(b.column(0).to_pylist(), b.column(4), strict=True):
                words = zstandard.ZstdDecompressor().decompress(raw.as_buffer()).split(b"\n")
                if slot != at or len(table) > _KEEP:
                    at, table = slot, {}
                new = [w for w in words if w not in table]
                if new:
                    table.update(zip(new, [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)], strict=True))
                ids = [table[w] for w in words]
                out.append(_squeeze(np.concatenate([np.array([len(x) // 4 for x in ids], np.uint32), np.frombuffer(b"".join(ids), "<u4")])))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(out, pa.binary())], ["block", "check", "numbers", "ids"])

    rows = blocks.select("block", "check", "words").mapInArrow(deal, "slice int, block long, check long, numbers binary, words binary")
    return rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(encode, "block long, check long, numbers binary, ids binary")


def pieces(tokenizer: str) -> pa.Array:
    """The piece of each id: a table of the vocabulary's size."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    return pa.array([model.id_to_token(i) or "" for i in range(model.get_vocab_size())], pa.string())


def word_table_codec(docs: DataFrame, tokenizer: str, outputs: str = "digest") -> DataFrame:
    """Encode docs(doc_id, text), and decode the ids again.

    For tokenizers that drop white space, never join across it and have no
    decoder of their own, so that decoding puts spaces between pieces.
    Documents are split into words and grouped into blocks, their texts
    replaced by word numbers; the blocks' distinct words meet by hash, each
    is encoded once, and the ids are joined back to the blocks by number and
    to the texts by position. Ids are decoded by a join with the table of
    pieces, whose size is the vocabulary's. What a task holds is bounded by
    a block, whatever the corpus has; a text of more than a block is one.

    docs is read twice and must give the same rows in the same partitions
    both times, as stored tables do; where a block's words differ it is an
    error, never a wrong id.

    outputs 'digest': doc_id, n_tokens, ids_sha256, decoded_sha256; 'full':
    doc_id, ids (binary, little-endian 32-bit), decoded. Null texts are
    empty; texts without words have no ids and decode to the empty text;
    repeated rows and null ids are kept; an empty table gives an empty one; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = outputs == "digest"
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary, decoded string"
    blocks = split_words(docs)
    table = pieces(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(table.to_pylist())

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        piece = pa.array(shared.value, pa.string())
        if set(right.column("check").to_pylist()) - set(left.column("check").to_pylist()):
            raise ValueError("docs gave other rows when read again")
        numbers, sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for n, raw in zip(right.column("numbers"), right.column("ids"), strict=True):
            own, packed = np.cumsum(_open(n.as_buffer()).astype(np.int64)), _open(raw.as_buffer())
            numbers.append(own)
            sizes.append(packed[: len(own)].astype(np.int64))
            flat.append(packed[len(own) :])
        number, length, flat = np.concatenate(numbers), np.concatenate(sizes), np.concatenate(flat)
        size, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        size[number], start[number] = length, np.cumsum(length) - length
        rows = []
        for who, counts, codes in zip(left.column("doc_ids"), left.column("counts"), left.column("codes"), strict=True):
            who, codes = who.as_py(), _open(codes.as_buffer())
            at = np.concatenate([[0], np.cumsum(_open(counts.as_buffer()).astype(np.int64))])
            for k, doc in enumerate(who):
                c = codes[at[k] : at[k + 1]]
                n = size[c]
                place = np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own = flat[place]
                raw = own.tobytes()
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), piece.take(pa.array(own))), " ")[0].as_py() if len(own) else ""
                rows.append((doc, len(own), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) if digest else (doc, raw, text))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.binary(), pa.string()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    held = blocks.select("block", "check", "doc_ids", "counts", "codes")
    return held.groupBy("block").cogroup(encode_words(blocks, tokenizer).groupBy("block")).applyInArrow(join, schema)

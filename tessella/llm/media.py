"""Texts as lossless WebP images, stored in a binary column and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .webp import decode_images, encode_image, encode_tiles, split_files

#: A row of 192 pixels holds 576 payload bytes as red, green, blue; an image has 32 rows at most, so a long text is several images.
_UNIT, _WIDTH, _ROWS = 576, 192, 32
#: Pixels that are coded in step.
_BATCH = 1 << 22


def to_images(payload: np.ndarray) -> list[np.ndarray]:
    rgb = payload.reshape(-1, _WIDTH, 3).astype(np.uint32)
    px = np.uint32(0xFF000000) | (rgb[..., 0] << np.uint32(16)) | (rgb[..., 1] << np.uint32(8)) | rgb[..., 2]
    return [px[i : i + _ROWS] for i in range(0, len(px), _ROWS)]


def to_bytes(images: list[np.ndarray]) -> bytes:
    px = np.concatenate(images)
    return np.stack([(px >> np.uint32(s)) & np.uint32(255) for s in (16, 8, 0)], axis=-1).astype(np.uint8).tobytes()


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as WebP files one after the other. An image of at most 16 colours is stored by palette."""

    def work(batches):
        for b in batches:
            off, data = spans.buffers(b.column(1))
            for i, j in spans.pieces(off):
                images, owner = [], []
                for k in range(i, j):
                    raw = data[off[k] : off[k + 1]]
                    pad = (-len(raw)) % _UNIT if len(raw) else _UNIT
                    for image in to_images(np.concatenate([raw, np.full(pad, 255, np.uint8)])):
                        images.append(image)
                        owner.append(k - i)
                few = [len(x) <= 2 and len(np.unique(x)) <= 16 for x in images]
                files = iter(encode_tiles([x for x, f in zip(images, few, strict=True) if not f], _WIDTH))
                out: list[list[bytes]] = [[] for _ in range(j - i)]
                for x, f, k in zip(images, few, owner, strict=True):
                    out[k].append(encode_image(x, palette=True) if f else next(files))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(off[i + 1 : j + 1] - off[i:j]), pa.array([b"".join(x) for x in out], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


def _read(media: list[bytes]):
    """Runs of rows with their decoded images."""
    files = [split_files(m or b"") for m in media]
    i = 0
    while i < len(files):
        j, size = i, 0
        while j < len(files) and (j == i or size < _BATCH):
            size += sum(((int.from_bytes(f[21:25], "little") & 0x3FFF) + 1) * (((int.from_bytes(f[21:25], "little") >> 14) & 0x3FFF) + 1) for f in files[j])
            j += 1
        images = iter(decode_images([f for x in files[i:j] for f in x]))
        yield i, j, [[next(images) for _ in x] for x in files[i:j]]
        i = j


def read_pixels(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, image, width, height, pixels) of stored(doc_id, n_bytes, media): an array of ARGB values (as longs) per image. A null or empty media has no image; a broken one is an error that names the fault."""

    def work(batches):
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, images in _read(b.column(2).to_pylist()):
                rows = [(ids[i + k], sizes[i + k], n, x.shape[1], x.shape[0], x.ravel().astype(np.int64)) for k in range(j - i) for n, x in enumerate(images[k])]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:5]], pa.array([x.tolist() for x in cols[5]], pa.list_(pa.int64()))], ["doc_id", "n_bytes", "image", "width", "height", "pixels"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, image int, width int, height int, pixels array<long>")


def features(stored: DataFrame) -> DataFrame:
    """Per document of stored(doc_id, n_bytes, media), from the pixels read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes, media_sha256, feature (size; means of red, green and blue in hundredths; distinct sample values)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def work(batches):
        for b in batches:
            ids, sizes, media = (b.column(k).to_pylist() for k in range(3))
            for i, j, images in _read(media):
                rows = []
                for k in range(j - i):
                    raw, m = to_bytes(images[k]), media[i + k]
                    rgb = np.frombuffer(raw, np.uint8).reshape(-1, 3)
                    mean = rgb.sum(axis=0, dtype=np.int64) * 100 // len(rgb)
                    feature = f"{_WIDTH}x{len(rgb) // _WIDTH} r{mean[0]} g{mean[1]} b{mean[2]} v{np.count_nonzero(np.bincount(rgb.ravel(), minlength=256))}"
                    rows.append((ids[i + k], sizes[i + k], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split(" ")[0] for x in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(work, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """store, then features: see there. Null texts are empty (one row of 255s); repeated rows and null ids are kept; equal texts give equal values; further columns are ignored."""
    return features(store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))

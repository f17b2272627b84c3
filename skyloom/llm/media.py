"""Media columns: payloads as coefficients of progressive JPEG files, and tensors read from them."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.arrays import runs, small_batches, utf8
from skyloom.llm.progressive_jpeg import Component, Image, read_progressive, to_rgb, write_progressive

#: Payloads are filled up with bytes 255 to a positive multiple of this.
UNIT = 576
#: Bytes of a 16 x 16 piece: four luma blocks and two chroma blocks.
PIECE = 384
FLAT = np.ones(64, np.uint8)


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def payload_to_jpeg(payload: bytes) -> bytes:
    """One byte in each coefficient: AC as the number of size 8 with these extra bits, DC less 128.

    The image is as square as 16 x 16 pieces allow; spare coefficients hold
    byte 0 and the comment holds the payload's length.
    """
    pieces = -(-len(payload) // PIECE)
    cols = math.isqrt(pieces - 1) + 1
    rows = -(-pieces // cols)
    data = np.zeros(rows * cols * PIECE, np.int16)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, 64)
    values = np.where(blocks < 128, blocks - 255, blocks)
    values[:, 0] = blocks[:, 0] - 128
    n = rows * cols
    comps = [
        Component(2, 2, values[: 4 * n].reshape(2 * rows, 2 * cols, 64)),
        *(Component(1, 1, values[k * n : (k + 1) * n].reshape(rows, cols, 64)) for k in (4, 5)),
    ]
    return write_progressive(Image(16 * cols, 16 * rows, comps, {0: FLAT}, b"payload %d" % len(payload)))


def jpeg_to_payload(image: Image) -> bytes:
    """The bytes behind the coefficients of payload_to_jpeg."""
    values = np.concatenate([c.coefficients.reshape(-1, 64) for c in image.components])
    data = np.where(values < 0, values + 255, values)
    data[:, 0] = values[:, 0] + 128
    return data.astype(np.uint8).tobytes()[: int(image.comment.split()[1])]


def picture_feature(rgb: np.ndarray) -> str:
    """Mean colours, and one bit for each cell of an 8 x 8 grid: is it brighter than the mean cell."""
    grey = rgb.sum(axis=2, dtype=np.int64)
    h, w = grey.shape
    at_h, at_w = np.arange(8) * h // 8, np.arange(8) * w // 8
    cells = np.add.reduceat(np.add.reduceat(grey, at_h, axis=0), at_w, axis=1)
    area = np.diff(np.append(at_h, h))[:, None] * np.diff(np.append(at_w, w))[None, :]
    bright = cells * (h * w) > grey.sum() * area
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (h * w)
    return np.packbits(bright).tobytes().hex() + "".join(f"-{m}" for m in means.tolist())


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), utf8(batch.column(1))
        for i, j in runs(texts, 2_000_000):
            files = [payload_to_jpeg(padded(t)) for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a progressive JPEG that holds the text's UTF-8 bytes without loss.

    Null text counts as empty; an empty text has one unit of fill; a text of any
    length is one picture. Rows that repeat a doc_id or a text are pictures of
    their own. Other columns are ignored, whatever their names, and an empty
    table gives an empty result.
    """
    return small_batches(docs).select("doc_id", "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, files = batch.column(0), utf8(batch.column(1))
        for i, j in runs(files, 1_000_000):
            rgb = [to_rgb(read_progressive(f)) for f in files[i:j]]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), *(pa.array([r.shape[k] for r in rgb], pa.int32()) for k in (0, 1)), pa.array([r.tobytes() for r in rgb], pa.binary())],
                ["doc_id", "height", "width", "rgb"],
            )


def media_tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and rgb (height x width x 3 bytes) of doc_id and media."""
    return small_batches(media).select("doc_id", "media").mapInArrow(_tensors, "doc_id long, height int, width int, rgb binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, files = batch.column(0), batch.column(1), utf8(batch.column(2))
        rows = []
        for f in files:
            image = read_progressive(f)
            payload = jpeg_to_payload(image)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), picture_feature(to_rgb(image))))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([ids, sizes, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], DIGEST_COLUMNS)


DIGEST_COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored files hold: digests of payload and file, and a feature of the RGB tensor."""
    return small_batches(media).select("doc_id", "n_bytes", "media").mapInArrow(
        _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )

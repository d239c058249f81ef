"""Media columns: payloads stored as lossless WebP, and stored files read back to pixels.

``store`` turns payload bytes into grey images, ``pixel_arrays`` reads the stored
files back to arrays of samples; ``read_media`` decodes any lossless WebP files of
a column into ARGB pixels.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp

#: Samples in a row of an image, and the multiple to which payloads are filled up.
UNIT = 576
FILL = 255
#: Pixels in a row of a colour image, which holds one UNIT, three samples a pixel.
COLOUR_WIDTH = 16
#: Output batches hold about so many bytes.
BATCH_BYTES = 8 << 20


def payload_of(text: str | None) -> bytes:
    """UTF-8 with FILL appended up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([FILL]) * (-len(raw) % UNIT if raw else UNIT)


def encode_rows(payload: bytes) -> bytes:
    """One file after another, each a grey image of UNIT samples a row; payloads of any length have this one form.

    A file ends at webp.MAX_SIDE rows, the most that its header can hold.
    """
    samples, step = np.frombuffer(payload, np.uint8), UNIT * webp.MAX_SIDE
    return b"".join(webp.encode_grey(samples[i : i + step], UNIT) for i in range(0, len(samples), step))


def encode_payload(payload: bytes) -> bytes:
    """As :func:`encode_rows`, but a payload of one UNIT that is mostly fill (two thirds or more at its end) is a colour image.

    Not for :func:`store`: its form depends on the length of the text.
    """
    samples = np.frombuffer(payload, np.uint8)
    if len(payload) == UNIT and (samples[UNIT // 3 :] == FILL).all():
        return webp.encode_colour(samples, COLOUR_WIDTH)
    return encode_rows(payload)


def files(media: bytes) -> Iterator[bytes]:
    """The WebP files that lie one after another in ``media``."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield media[at : at + size]
        at += size + size % 2


def decode_payload(media: bytes) -> tuple[bytes, int, int]:
    """(samples, width, rows) of :func:`encode_rows`'s or :func:`encode_payload`'s files; grey ones are known by their width."""
    parts = []
    for f in files(media):
        width, _, pixels = webp.decode(f)
        if width == UNIT:
            parts.append((pixels >> 8 & 255).astype(np.uint8).tobytes())
        else:
            parts.append(pixels.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].tobytes())
    samples = b"".join(parts)
    return samples, UNIT, len(samples) // UNIT


def feature(samples: np.ndarray, width: int, rows: int) -> str:
    """Average hash over 8 by 8 cells, mean (thousandths), number of values, most frequent value; integers only."""
    img = samples.reshape(rows, width)
    edges = np.unique(np.arange(8) * rows // 8)
    cols = img.reshape(rows, 8, width // 8).sum(axis=2, dtype=np.int64)
    cells = np.add.reduceat(cols, edges, axis=0)
    sizes = np.diff(np.append(edges, rows)) * (width // 8)
    total = int(samples.sum(dtype=np.int64))
    over = cells * samples.size > sizes[:, None] * total
    bits = int("".join("1" if x else "0" for x in over.ravel().tolist()) or "0", 2)
    counts = np.bincount(samples, minlength=256)
    return f"{bits:016x}:{total * 1000 // samples.size}:{np.count_nonzero(counts)}:{int(counts.argmax())}"


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES, by the length of the column ``weight``."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r[weight])
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as WebP files, all of the form of :func:`encode_rows`.

    A null or empty text is a payload of FILL only; null and repeated ids are kept;
    other columns are ignored; texts of any length are stored whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            schema = schema or pa.schema([("id", b.schema.field(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])

            def rows(b=b):
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    text = t.as_py()
                    yield i, len((text or "").encode("utf-8", "surrogatepass")), encode_rows(payload_of(text))

            yield from _batches(rows(), schema, 2)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def pixel_arrays(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media, width, height, pixels): the 8-bit samples of the stored files, row by row.

    One row a row of ``stored``; null and repeated ids are kept, other columns ignored; an empty table gives
    none.  A payload of several files is one array.
    """
    kind = stored.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([("id", b.schema.field(0).type), ("n_bytes", pa.int64()), ("media", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])

            def rows(b=b):
                for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    media = m.as_py()
                    samples, width, height = decode_payload(media)
                    yield i, n, media, width, height, samples

            yield from _batches(rows(), schema, 5)

    schema = f"id {kind}, n_bytes long, media binary, width int, height int, pixels binary"
    return stored.select(id_col, "n_bytes", "media").mapInArrow(decode, schema).withColumnRenamed("id", id_col)


def media_features(arrays: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of the payload read back and of its media, and features of the samples, from :func:`pixel_arrays`.

    One row a row, as there; equal payloads have equal values.
    """
    kind = arrays.schema[id_col].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, n, m, w, h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)):
                media, payload = m.as_py(), p.as_py()
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8), w, h)))
            kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=list(names))

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrays.select(id_col, "n_bytes", "media", "width", "height", "pixels").mapInArrow(describe, schema).withColumnRenamed("id", id_col)


def read_media(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(id, frame, width, height, pixels): each lossless WebP file of a binary column as ARGB pixels,
    four bytes each, little-endian.  A null or empty value has no frames; a broken one raises."""
    kind = df.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([("id", b.schema.field(0).type), ("frame", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])

            def rows(b=b):
                for i, m in zip(b.column(0).to_pylist(), b.column(1)):
                    for k, f in enumerate(files(m.as_py() or b"")):
                        w, h, pixels = webp.decode(f)
                        yield i, k, w, h, pixels.astype("<u4").tobytes()

            yield from _batches(rows(), schema, 4)

    return df.select(id_col, media_col).mapInArrow(decode, f"id {kind}, frame int, width int, height int, pixels binary").withColumnRenamed("id", id_col)

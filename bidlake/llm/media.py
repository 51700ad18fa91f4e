"""Media columns: PNG written and read in binary columns, with low-frequency cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row, bytes of one IDAT chunk.
WIDTH, IDAT = 64, 1 << 16
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # by colour type, at 8 bits
SIDE, LOW = 32, 8

_angle = np.pi * (2 * np.arange(SIDE) + 1) / (2 * SIDE)
#: The first LOW rows of the cosine transform of SIDE values.
BASIS = np.cos(np.outer(np.arange(LOW), _angle)) * np.where(np.arange(LOW) == 0, 1 / np.sqrt(SIDE), np.sqrt(2 / SIDE))[:, None]


class MediaError(ValueError):
    """The stored bytes aren't a PNG that can be read whole."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray) -> bytes:
    """A greyscale PNG of a uint8 matrix; each row gets that of no filter, Sub and Up with the smallest absolute differences."""
    height, width = samples.shape
    left, above = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], above[1:] = samples[:, :-1], samples[:-1]
    choices = np.stack([samples, samples - left, samples - above])
    cost = np.abs(choices.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, choices[kind, np.arange(height)]
    packed = zlib.compress(rows.tobytes(), 6)
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT))
    return SIGNATURE + _chunk(b"IHDR", header) + data + _chunk(b"IEND", b"")


def _paeth(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for x in range(len(row)):
        a = int(row[x - step]) if x >= step else 0
        b, c = int(above[x]), int(above[x - step]) if x >= step else 0
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        row[x] = (int(row[x]) + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters, a run of equal filters at a time; ``step`` is the bytes of a pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    height, width = out.shape
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), height]
    for a, b in zip(cuts, cuts[1:]):
        kind = kinds[a]
        if kind == 1:
            pixels = out[a:b].reshape(b - a, width // step, step)
            np.cumsum(pixels, axis=1, dtype=np.uint8, out=pixels)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1] if y else np.zeros(width, np.uint8)
                if kind == 4:
                    _paeth(out[y], above, step)
                else:
                    for x in range(width):
                        out[y, x] = (int(out[y, x]) + ((int(out[y, x - step]) if x >= step else 0) + int(above[x])) // 2) & 255
        elif kind:
            raise MediaError(f"filter {kind}")
    return out


def read_png(stored: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without interlacing as (height, width * channels); every chunk's checksum is tested."""
    if stored[:8] != SIGNATURE:
        raise MediaError("signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise MediaError("cut short")
        (length,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        data, crc = stored[at + 8 : at + 8 + length], stored[at + 8 + length : at + 12 + length]
        if len(crc) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", crc)[0]:
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        ended = kind == b"IEND"
        at += 12 + length
    if header is None or not ended:
        raise MediaError("cut short")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace:
        raise MediaError("only 8-bit samples without interlacing are read")
    step = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width * step + 1):
        raise MediaError("size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width * step + 1), step)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: whether each of the 8 x 8 lowest cosine coefficients of the 32 x 32 mean image is above their median."""
    shrunk = samples.astype(np.float64)
    for axis in (0, 1):
        n = shrunk.shape[axis]
        at = np.arange(SIDE) * n // SIDE
        if n >= SIDE:
            sizes = np.diff(np.append(at, n)).astype(np.float64)
            shrunk = np.add.reduceat(shrunk, at, axis=axis) / (sizes[:, None] if axis == 0 else sizes)
        else:
            shrunk = np.take(shrunk, at, axis=axis)
    low = (BASIS @ shrunk @ BASIS.T).round(6)
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def to_payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % 64 or (0 if data else 64))


def store_text(docs: DataFrame, text_col: str = "text", media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """Add each whole text's PNG: its UTF-8 bytes with zeros up to a positive multiple of 64, as rows of 64 grey samples.

    Null and empty texts become one row of zeros. ``bytes_col`` is the length without zeros. The text is left out;
    other columns stay, and those named like the new ones are replaced. Equal texts give equal media.
    """
    kept = [c for c in docs.columns if c not in (text_col, media_col, bytes_col)]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(len(kept)):
                size, payload = to_payload(text.as_py())
                sizes.append(size)
                media.append(write_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*kept, bytes_col, media_col])

    schema = docs.select(*kept).schema.add(bytes_col, T.LongType()).add(media_col, T.BinaryType())
    return docs.select(*kept, text_col).mapInArrow(store, schema)


FEATURES = {
    "payload_bytes": (T.LongType(), pa.int64()),
    "payload_sha256": (T.StringType(), pa.string()),
    "tail_crc32": (T.LongType(), pa.int64()),
    "media_bytes": (T.LongType(), pa.int64()),
    "media_sha256": (T.StringType(), pa.string()),
    "feature": (T.StringType(), pa.string()),
    "media_error": (T.StringType(), pa.string()),
}


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Read stored PNGs and describe what was read: size, sha256 and checksum of the last 64 bytes, sizes and hashes.

    Media that are null, damaged or of another kind give nulls and ``media_error``; they don't stop the job. The media
    column is left out; other columns stay, and those named like the new ones are replaced.
    """
    kept = [c for c in media.columns if c != media_col and c not in FEATURES]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(len(kept)):
                stored = cell.as_py()
                if stored is None:
                    rows.append((*[None] * 6, "null"))
                    continue
                about = (len(stored), hashlib.sha256(stored).hexdigest())
                try:
                    samples = read_png(stored)
                except MediaError as e:
                    rows.append((None, None, None, *about, None, str(e)))
                    continue
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *about, cosine_hash(samples), None))
            columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*rows) if rows else [[]] * len(FEATURES), FEATURES.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, *FEATURES])

    schema = media.select(*kept).schema
    for name, (kind, _) in FEATURES.items():
        schema = schema.add(name, kind)
    return media.select(*kept, media_col).mapInArrow(read, schema)

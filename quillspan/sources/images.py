"""Pictures: decoded in bounded batches, refused if they are placeholders, damaged or small, made
smaller, and told by their mean colour.

The format is PNG with 8 bits a channel and no interlacing (grey, colour, palette, with or
without alpha, which is dropped); files of other formats count as damaged. `files` is what
spark.read.format("binaryFile") gives, or any table with a name and a content column.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.color import np_from_linear

# Fixed values of the format: its signature, and samples of a pixel by colour type
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PIXELS = 64 << 20  # of a picture that is decoded at all
FEW = 100_000  # digests of placeholders that are broadcast, so that files aren't shuffled
_LEVELS = np.arange(256) / 255
_LINEAR = np.where(_LEVELS <= 0.04045, _LEVELS / 12.92, ((_LEVELS + 0.055) / 1.055) ** 2.4)  # light of a sample


def png(pixels: np.ndarray) -> bytes:
    """A colour picture (height, width, 3) as a file."""
    height, width, _ = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1).astype(np.uint8)], axis=1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + part(b"IEND", b"")


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of samples from its differences to the samples left (one pixel back) and above."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:  # sums along the row, channel by channel, in bytes
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out, wide, up = row.tolist(), len(row), above.tolist()
    for k in range(wide):
        left = out[k - step] if k >= step else 0
        if kind == 3:
            guess = (left + up[k]) // 2
        else:  # of left, above and the corner, the one nearest to left + above - corner
            corner = up[k - step] if k >= step else 0
            to_left, to_up, to_corner = abs(up[k] - corner), abs(left - corner), abs(left + up[k] - 2 * corner)
            guess = left if to_left <= to_up and to_left <= to_corner else up[k] if to_up <= to_corner else corner
        out[k] = (out[k] + guess) & 255
    return np.array(out, np.uint8)


def decoded(data: bytes | None) -> np.ndarray | None:
    """The colours (height, width, 3) of a file; None if it is damaged or of another format."""
    if not data or not data.startswith(SIGNATURE):
        return None
    at, body, palette, head = len(SIGNATURE), [], None, None
    try:
        while at < len(data):
            (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
            content = data[at + 8 : at + 8 + size]
            if len(content) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + content):
                return None
            at += size + 12
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", content)
            elif kind == b"PLTE":
                palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body.append(content)
            elif kind == b"IEND":
                break
        width, height, depth, color, _, _, interlaced = head
        step = SAMPLES[color]
        if depth != 8 or interlaced or not 0 < width * height <= PIXELS:
            return None
        inflate = zlib.decompressobj()
        raw = inflate.decompress(b"".join(body), height * (width * step + 1) + 1)
        rows = np.frombuffer(raw, np.uint8).reshape(height, width * step + 1)
        if rows[:, 0].any():
            out, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
            for k in range(height):
                if rows[k, 0] > 4:
                    return None
                above = out[k] = _unfiltered(int(rows[k, 0]), rows[k, 1:], above, step)
        else:  # no row is told by differences
            out = rows[:, 1:]
        samples = out.reshape(height, width, step)
        if color == 3:
            return palette[samples[:, :, 0]]
        return samples[:, :, :3] if step >= 3 else samples[:, :, :1].repeat(3, axis=2)
    except (struct.error, zlib.error, ValueError, KeyError, TypeError, IndexError):
        return None


@lru_cache(16)
def _shares(of: int, into: int) -> np.ndarray:
    """The share that each of `of` places has in each of `into` places that cover the same length."""
    edges = np.linspace(0, of, into + 1)
    place = np.arange(of)
    return np.clip(np.minimum(edges[1:, None], place + 1) - np.maximum(edges[:-1, None], place), 0, None) * (into / of)


@lru_cache(64)
def _order(rows: int, height: int, width: int, columns: int) -> list:
    """The order in which einsum works off shrunk()'s factors; finding it costs more than a small picture."""
    return np.einsum_path("yh,hwc,xw->yxc", *[np.empty(n) for n in ((rows, height), (height, width, 3), (columns, width))], optimize=True)[0]


def shrunk(picture: np.ndarray, edge: int) -> np.ndarray:
    """The picture with its long edge at most `edge`, by means over areas."""
    height, width, _ = picture.shape
    longest = max(height, width)
    if longest <= edge:
        return picture
    rows, columns = (max(1, round(n * edge / longest)) for n in (height, width))
    out = np.einsum("yh,hwc,xw->yxc", _shares(height, rows), picture.astype(float), _shares(width, columns), optimize=_order(rows, height, width, columns))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def tone(picture: np.ndarray, edge: int = 64) -> list[float]:
    """The mean OKLab colour of a small copy, to four places."""
    small = shrunk(picture, edge).reshape(-1, 3)
    return np.round(np_from_linear(_LINEAR[small].T).mean(axis=0), 4).tolist()


def pictures(files: DataFrame, name: str, content: str, placeholders: DataFrame, least: int = 64, most: int = 800) -> DataFrame:
    """name, problem, width, height, tone and picture (a smaller file) of each file.

    problem: placeholder (its digest, or that of the smaller file, is among `sha256` of
    placeholders), damaged, or small (the short edge is below `least`, before or after); such
    files have no more. Placeholders are told by a join of digests, before anything is decoded; the
    files are read once."""
    known = placeholders.select(F.col("sha256").alias("_known")).distinct()
    known = F.broadcast(known) if known.limit(FEW + 1).count() <= FEW else known
    rows = files.select(F.col(name).alias("name"), F.col(content).alias("content")).withColumn("_digest", F.sha2("content", 256))
    told = rows.join(known, F.col("_digest") == F.col("_known"), "left").select("name", F.when(F.col("_known").isNull(), F.col("content")).alias("content"), F.col("_known").isNotNull().alias("_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # pictures that are held decoded: one; as files: 64
                part, out = batch.slice(at, 64), []
                for data, refused in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if refused:
                        out.append(("placeholder", None, None, None, None))
                        continue
                    picture = decoded(data)
                    small = None if picture is None or min(picture.shape[:2]) < least else shrunk(picture, most)
                    if small is None or min(small.shape[:2]) < least:
                        out.append(("damaged" if picture is None else "small", None, None, None, None))
                    else:
                        out.append((None, small.shape[1], small.shape[0], tone(small), png(small)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["name", "problem", "width", "height", "tone", "picture"])

    kind = rows.schema["name"].dataType.simpleString()
    made = told.mapInArrow(run, f"name {kind}, problem string, width int, height int, tone array<double>, picture binary")
    made = made.join(known, F.sha2("picture", 256) == F.col("_known"), "left")
    refused = F.col("_known").isNotNull()
    return made.select("name", F.when(refused, "placeholder").otherwise(F.col("problem")).alias("problem"), *[F.when(~refused, F.col(c)).alias(c) for c in ("width", "height", "tone", "picture")])

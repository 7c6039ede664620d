"""Pictures: every row filter, colour types, damage, and sizes."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa

from quillspan.sources import images


def written(pixels, color, kinds, palette=None):
    """A file whose rows have these filters, by the format's definitions."""
    height, width, step = pixels.shape
    out, above = b"", [0] * (width * step)
    for y in range(height):
        row, kind = pixels[y].reshape(-1).tolist(), kinds[y % len(kinds)]
        line = []
        for k, x in enumerate(row):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((x - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out, above = out + bytes([kind, *line]), row
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    data = zlib.compress(out)
    file = images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + part(b"tEXt", b"note")
    return file + (part(b"PLTE", palette.tobytes()) if palette is not None else b"") + part(b"IDAT", data[:9]) + part(b"IDAT", data[9:]) + part(b"IEND", b"")


def test_filters_and_colour_types():
    rng = np.random.default_rng(1)
    for color, step in images.SAMPLES.items():
        x = rng.integers(0, 256, (12, 7, step), dtype=np.uint8)
        palette = rng.integers(0, 256, (256, 3), dtype=np.uint8) if color == 3 else None
        want = palette[x[:, :, 0]] if color == 3 else x[:, :, :3] if step >= 3 else x[:, :, :1].repeat(3, axis=2)
        for kinds in ([0], [1], [2], [3], [4], [4, 2, 1, 3, 0]):
            assert (images.decoded(written(x, color, kinds, palette)) == want).all()
    x = rng.integers(0, 256, (5, 9, 3), dtype=np.uint8)
    assert (images.decoded(images.png(x)) == x).all()


def test_damaged_files_are_none():
    rng = random.Random(2)
    file = images.png(np.arange(300, dtype=np.uint8).reshape(10, 10, 3))
    for k in range(len(file) - 12):  # the last part is a mark only
        assert images.decoded(file[:k]) is None
    for _ in range(300):
        x = bytearray(file)
        x[rng.randrange(len(x) - 12)] ^= 1 << rng.randrange(8)
        assert images.decoded(bytes(x)) is None
    assert images.decoded(None) is None and images.decoded(b"\xff\xd8\xff") is None


def test_shrunk_keeps_means():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (90, 140, 3), dtype=np.uint8)
    small = images.shrunk(x, 64)
    assert small.shape == (41, 64, 3) and np.abs(small.mean(axis=(0, 1)) - x.mean(axis=(0, 1))).max() < 1
    assert images.shrunk(x, 200) is x and images.shrunk(np.zeros((1, 900, 3), np.uint8), 64).shape == (1, 64, 3)
    blocks = x[:16, :32].repeat(4, axis=0).repeat(4, axis=1)
    assert (images.shrunk(blocks, 32) == x[:16, :32]).all()


def test_pictures(spark):
    rng = np.random.default_rng(4)
    grey, fine, flat = np.full((80, 80, 3), 9, np.uint8), rng.integers(0, 256, (100, 300, 3), dtype=np.uint8), np.full((70, 2000, 3), 7, np.uint8)
    rows = [("grey", images.png(grey)), ("fine", images.png(fine)), ("flat", images.png(flat)), ("tiny", images.png(fine[:20])), ("bad", b"GIF89a"), ("none", None)]
    known = spark.createDataFrame([(__import__("hashlib").sha256(images.png(grey)).hexdigest(),)], "sha256 string")
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.name: r for r in images.pictures(files, "path", "content", known, least=64, most=200).collect()}
    assert {k: r.problem for k, r in got.items()} == {"grey": "placeholder", "fine": None, "flat": "small", "tiny": "small", "bad": "damaged", "none": "damaged"}
    wide = {r.name: r for r in images.pictures(files, "path", "content", known, least=64, most=250).collect()}["fine"]
    assert (wide.width, wide.height, wide.problem) == (250, 83, None) and np.abs(np.array(wide.tone) - images.tone(fine)).max() < 2e-3
    assert images.decoded(wide.picture).shape == (83, 250, 3)
    assert images.pictures(files.limit(0), "path", "content", known).count() == 0


def test_files_are_read_once_and_by_all_cores(spark):
    from quillspan.plans import palettes

    reads = spark.sparkContext.accumulator(0)

    def drawn(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            files = [images.png(np.full((64, 64, 3), i, np.uint8)) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["name", "content"])

    known = spark.createDataFrame([(hashlib.sha256(images.png(np.full((64, 64, 3), 3, np.uint8))).hexdigest(),)], "sha256 string")
    got = images.pictures(spark.range(8).mapInArrow(drawn, "name long, content binary"), "name", "content", known).collect()
    assert reads.value == 8 and {r.name: r.problem for r in got} == {i: "placeholder" if i == 3 else None for i in range(8)}
    found = palettes.picture_scan(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

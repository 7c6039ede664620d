"""Near-duplicate documents by MinHash bands, with odd sketches for the candidates.

Each document's set of word shingles gives `BANDS * ROWS` MinHash values for the bands
and `SAMPLES` values that are folded into a parity bitmap (an odd sketch): the XOR of
two bitmaps has few ones exactly if the sets agree in most samples. Documents that
share a band key with the key's smallest document form a family; within a family every
pair is compared by sketch, in blocks, and pairs the sketch does not rule out are
confirmed on the full sets of the shingles' 64-bit hashes.

Scale. Equal sets are collapsed before anything is paired, so a group of exact copies
costs one row each. Band keys are reduced by a pre-aggregated minimum, never gathered.
A family of m different texts is dealt out as blocks of `block` rows: rows moved are
m * m / block, and each task returns at most a spanning forest, never the pairs.

Defined results. Null or wordless text: empty set, linked with nothing, its own
component. Fewer words than a shingle: the whole sequence is one shingle. Rows with the
same doc_id count as one document for links, and each row is returned. A null doc_id is
linked with nothing, has a null component_id and is kept. Very long texts are used whole.
Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import byte_texts, discard, keyed, lean, map_groups, materialize, wide
from quillspan.llm.graph import connected_components

BANDS, ROWS = 40, 8  # a pair at 0.85 shares no band in about 3 of a million cases
SAMPLES, BITS = 256, 1024
MARGIN = 0.11  # about five standard errors of the sketch at 0.85
BLOCK = 64
_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


class _Hashes(dict):
    """Word to 64-bit hash, kept between documents; bounded, as a plain speed-up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's `size`-word shingles."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    out = h[: n - k + 1] + _U(k)
    for i in range(1, k):
        out = _mix(out * _MIX[0] + h[i : n - k + 1 + i])
    return np.unique(_mix(out))


def _print(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    k = max(SAMPLES, BANDS * ROWS)
    return rng.integers(1, 2**32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)


def min_samples(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the multiply-xorshift hashes of the set, for each factor."""
    low, high = s.astype(np.uint32), (s >> _U(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 512):
        x = low[at : at + 512, None] * a[None, :]
        x ^= high[at : at + 512, None]
        x *= a[None, :]
        np.minimum(best, x.min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each (index, value) flips one of BITS bits."""
    at = _mix(samples[:SAMPLES].astype(np.uint64) + (b[:SAMPLES].astype(np.uint64) << _U(32))) % _U(BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd)


def sketch_similarity(ones: np.ndarray) -> np.ndarray:
    """Estimated similarity from the ones in the XOR of two odd sketches."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * ones / BITS, 1e-9))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, print (binary, of the whole set), bands (array<long>), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors()
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, prints, bands, sketches = [], [], [], []
                for t in byte_texts(part.column(1)):
                    s = shingles(t, size, hashes)
                    n.append(len(s))
                    if not len(s):
                        prints.append(None), bands.append([]), sketches.append(None)
                        continue
                    prints.append(_print(s))
                    m = min_samples(s, a, b)
                    rows = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for i in range(ROWS):
                        key = _mix(key * _MIX[0] + rows[:, i])
                    bands.append(key.view(np.int64))
                    sketches.append(odd_sketch(m, b).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "print", "bands", "sketch"])

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, print binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, size, hashes) for t in byte_texts(part.column("text"))]
                own = [_print(s) == p for s, p in zip(sets, part.column("print").to_pylist(), strict=True)]
                packed = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "family", "blocks", "sketch")), packed], ["doc_id", "family", "blocks", "sketch", "items"])
                yield out.filter(pa.array(own))

    return docs.mapInArrow(lean(run), "doc_id long, family long, blocks int, sketch binary, items binary")


def _forest(percent: int):
    """Links of one block pair, reduced to a spanning forest."""

    def run(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows < 2:
            return None
        ids = table.column("doc_id").to_numpy()
        side = table.column("block").to_numpy()
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        raw = table.column("items").to_pylist()
        sets: dict[int, np.ndarray] = {}
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        across = side[0] != side[-1] or table.column("i")[0].as_py() != table.column("j")[0].as_py()
        cut = percent / 100 - MARGIN
        size = np.array([len(r) // 8 for r in raw])
        edges = []
        for x in range(len(ids) - 1):
            ones = np.bitwise_count(bits[x + 1 :] ^ bits[x]).sum(axis=1)
            small, large = np.minimum(size[x + 1 :], size[x]), np.maximum(size[x + 1 :], size[x])
            like = (sketch_similarity(ones) >= cut) & (100 * small >= percent * large)
            if across:
                like &= side[x + 1 :] != side[x]
            for y in (np.flatnonzero(like) + x + 1).tolist():
                if find(x) == find(y):
                    continue
                for z in (x, y):
                    if z not in sets:
                        sets[z] = np.frombuffer(raw[z], "<u8")
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    root[find(x)] = find(y)
                    edges.append((ids[x], ids[y]))
        if not edges:
            return None
        a, b = zip(*edges, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _same_document(sig: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between the representatives of the different sets that rows of one doc_id have."""
    own = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = own.groupBy("doc_id").agg(F.min("print").alias("one"), F.max("print").alias("two")).where("one <> two").select("doc_id")
    several = materialize(several, "several-texts")
    sets = own.join(several, "doc_id", "left_semi").select("doc_id", "print").distinct().join(reps, "print").select("doc_id", "rep")
    sets = materialize(sets, "several-sets")
    low = sets.groupBy("doc_id").agg(F.min("rep").alias("low"))
    return sets.join(low, "doc_id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Two documents link if 100 * |A & B| >= percent * |A | B| on their shingle sets;
    component_id is the smallest doc_id that links reach; kept marks that document.
    """
    docs = wide(keyed(docs, "doc_id", "text"))
    sig = materialize(signatures(docs, size), "signatures")
    reps = sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "reps")
    ones = sig.where("n_shingles > 0").join(reps.select(F.col("rep").alias("doc_id"), F.col("print").alias("own")), "doc_id").where("print = own")
    ones = ones.dropDuplicates(["doc_id", "print"])
    bands = materialize(ones.select("doc_id", F.explode("bands").alias("key")), "bands")
    first = materialize(bands.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"), "pivots")
    # a document's pivots (BANDS at most) are joined through the smallest, so a family's
    # many pivots give few different edges
    stars = bands.join(first, "key").where("doc_id <> pivot").select("doc_id", "pivot").distinct()
    stars = materialize(stars.withColumn("low", F.min("pivot").over(Window.partitionBy("doc_id"))), "stars")
    families = connected_components(stars.selectExpr("low AS a", "doc_id AS b").union(stars.selectExpr("low AS a", "pivot AS b").where("a <> b")).distinct())
    sizes = materialize(families.groupBy(F.col("component").alias("family")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "families")
    members = materialize(families.withColumnRenamed("component", "family").join(sizes, "family"), "members").withColumnRenamed("id", "doc_id")
    members = materialize(members.join(ones.select("doc_id", "print", "sketch"), "doc_id"), "members")
    rows = _sets(docs.where("doc_id IS NOT NULL").join(members, "doc_id").select("doc_id", "text", "family", "blocks", "print", "sketch"), size)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "sketch", "items")
    links = materialize(map_groups(dealt, ["family", "i", "j"], _forest(percent), "a long, b long", ["block"]), "links")
    parts = connected_components(links.union(_same_document(sig, reps)))
    for old in (bands, first):
        discard(old)
    classes = reps.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("class"))
    classes = materialize(classes, "classes")
    out = sig.drop("bands", "sketch").join(classes, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.least("class", "doc_id"), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))

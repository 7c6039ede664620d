"""Centroid clustering of integer vectors, with block-norm screening.

Each vector is kept beside a compressed form, worked out once: for each of `SEGMENTS`
segments the sum of its components and the norm of what deviates from their mean. Two
segments differ by at least the difference of their sums spread evenly, and, by the
Cauchy-Schwarz inequality, by the difference of their norms beside it. Added up over the
segments this bounds a distance from below in `2 * SEGMENTS` steps instead of one for each
component. A vector meets the centroids in the order of their bounds; the first bound
above the best distance so far ends it, so only the centroids before it get an exact
distance, in 64-bit integers. Bounds are lowered by more than their rounding errors:
screening never changes a result.

A round is one pass over the written table: the centroids (k * width numbers, whatever
the number of vectors) go out with the task, and per task and cluster one row of counts
and sums comes back to be added up as decimals. Nothing is grouped by cluster before
it is added up, so a cluster with most vectors costs what any other does.

Defined results. Vectors that are null, of another length, or hold a null or non-finite
component are left out and get no row. Components beyond the largest integer whose
squared distances fit in a long (2 ** 27 for 64 of them) count as that integer. Rows
that repeat a vector or a vec_id are vectors of their own; of equal hashes the smaller
vector starts first; a null vec_id is hashed as an empty one. Fewer vectors than k: as
many centroids. Totals beyond a long are returned as the largest one. An empty table
gives no rows. Only vec_id and the embedding are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import keyed, lean, materialize, wide

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
SEGMENTS = 8
CHUNK = 4096  # vectors whose bounds a task holds at a time
SEED = "2"
_MOST = (1 << 63) - 1


def largest(width: int) -> int:
    """The largest component for which a squared distance fits in a long."""
    return 1 << ((62 - (width - 1).bit_length()) // 2 - 1)


def integers(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of integers) of the vectors that take part."""
    fine = (F.size("embedding") == width) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = float(largest(width))
    number = lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * scale))).cast("int")
    return wide(keyed(vectors, "vec_id", "embedding")).where(fine).select("vec_id", F.transform("embedding", number).alias("v"))


def start_hash(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def _rows(column: pa.ListArray, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def compress(x: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment of each row: the sum (exact), and the norm of the deviation from its mean."""
    parts = x.reshape(len(x), segments, -1)
    sums = parts.sum(axis=2)
    deviation = parts - sums[:, :, None] / parts.shape[2]
    return sums, np.sqrt((deviation * deviation).sum(axis=2))


def bounds(x: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Lower bounds of the squared distances of compressed rows and centroids; size: components of a segment."""
    out = np.zeros((len(x[0]), len(c[0])))
    for s in range(x[0].shape[1]):
        apart = (x[0][:, s, None] - c[0][None, :, s]).astype(float)
        out += apart * apart / size
        one, two = x[1][:, s, None], c[1][None, :, s]
        apart = np.maximum(np.abs(one - two) - 1e-10 * (one + two), 0)
        out += apart * apart
    return out * (1 - 1e-10)


def nearest(x: np.ndarray, compressed: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the nearest centroid, its squared distance, and how many exact distances it took."""
    low = bounds(compressed, compress(centroids, compressed[0].shape[1]), x.shape[1] // compressed[0].shape[1])
    order = np.argsort(low, axis=1, kind="stable")
    low = np.take_along_axis(low, order, axis=1)
    best, at = np.full(len(x), _MOST), np.full(len(x), len(centroids))
    left, exact = np.arange(len(x)), 0
    for step in range(len(centroids)):
        left = left[low[left, step] <= best[left]]  # an equal distance can still win by its number
        if not len(left):
            break
        who = order[left, step]
        apart = x[left] - centroids[who]
        d = (apart * apart).sum(axis=1)
        exact += len(left)
        better = (d < best[left]) | ((d == best[left]) & (who < at[left]))
        best[left[better]], at[left[better]] = d[better], who[better]
    return at, best, exact


def compressed_table(table: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, v and the compressed form of each vector: sums, norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sums, norms = compress(_rows(b.column("v"), np.int64), segments)
                flat = lambda a: pa.array(list(a))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), flat(sums), flat(norms)], ["vec_id", "v", "sums", "norms"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(lean(run), f"vec_id {kind}, v array<int>, sums array<long>, norms array<double>")


def _nearest_of(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.slice(at, CHUNK)
        x = _rows(part.column("v"), np.int64)
        yield part, x, *nearest(x, (_rows(part.column("sums"), np.int64), _rows(part.column("norms"), float)), centroids)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' means; those without vectors stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, x, cluster, _, _ in _nearest_of(b, centroids):
                order = np.argsort(cluster, kind="stable")
                own, first = np.unique(cluster[order], return_index=True)
                total[own] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(count)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(list(total[own]))], ["cluster", "n", "total"])

    parts = table.select("v", "sums", "norms").mapInArrow(lean(run), "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("place", "total"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = centroids.copy()
    for r in each.groupBy("cluster", "place").agg(exact("n"), exact("total")).collect():  # k * width rows at most
        out[r.cluster, r.place] = int(r.total) // int(r.n)
    return out


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, and n_exact, the exact distances that the vector's chunk took, on its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, cluster, distance, exact in _nearest_of(b, centroids):
                took = np.zeros(len(cluster), np.int64)
                took[0] = exact
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(took)], ["vec_id", "cluster", "distance", "n_exact"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(lean(run), f"vec_id {kind}, cluster int, distance long, n_exact long")


def fit(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids of a compressed table after these rounds."""
    first = table.select("v", start_hash(F.col("vec_id")).alias("h")).orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in sorted(first, key=lambda r: (r.h, r.v))], np.int64)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(table, centroids)
    return centroids


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    table = materialize(compressed_table(integers(vectors, width, scale), segments), "vectors")
    centroids = fit(table, k, rounds)
    if not len(centroids):
        return table.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").where("false")
    out = materialize(assigned(table, centroids), "assigned")
    found = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    per = {r.cluster: int(r.s) for r in found}
    whole = min(sum(per.values()), _MOST)
    names = [(c, min(s, _MOST), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(per.items())]
    facts = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Plain rounds: every vector meets every centroid."""
    d = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    most = float(largest(WIDTH))
    out = [f"""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(greatest(-{most}, least({most}, {SCALE} * x::DOUBLE)))::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {CENTROIDS})"""]
    for k in range(ROUNDS):
        out.append(f"""a{k} AS MATERIALIZED (SELECT r, v, arg_min(cluster, (d, cluster)) AS cluster FROM (SELECT r, v, cluster, {d} AS d FROM kept, c{k}) GROUP BY r, v),
m{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM (
  SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{k}) GROUP BY cluster, place) GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c::BIGINT[], o.c) AS c FROM c{k} o LEFT JOIN m{k} m ON o.cluster = m.cluster)""")
    out.append(f"last AS MATERIALIZED (SELECT r, vec_id, min((d, cluster)) AS best FROM (SELECT r, vec_id, cluster, {d} AS d FROM kept, c{ROUNDS}) GROUP BY r, vec_id)")
    return ",\n".join(out) + f"""
SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
  sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} ON best[2] = cluster"""


SQL = _sql()

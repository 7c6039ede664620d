"""Vector tables as a whole: near-duplicates of evaluation rows, training candidates, subspaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.search import _matrix, nearest
from quillspan.sources.scratch import staged

EVAL_BYTES = 64 << 20  # of evaluation vectors that a task holds


def _floats(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda x: x.cast("double")))


def farther_than(rows: DataFrame, evals: DataFrame, limit: float, digits: int = 6) -> DataFrame:
    """id, nearest: the rows (id, unit vector) whose best product with an evaluation row is below
    limit. The evaluation rows go to the tasks in blocks of EVAL_BYTES, the rows are streamed;
    only ids and numbers are shuffled, and only if there are several blocks."""
    held = staged(_floats(evals.select("id", "vector"), "vector"), "evals")
    size = held.agg(F.sum(8 * F.size("vector") + 16)).first()[0] or 0
    blocks, found = max(1, -(-size // EVAL_BYTES)), None
    stream = _floats(rows.select("id", "vector"), "vector")
    for b in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        data = rows.sparkSession.sparkContext.broadcast(_matrix(part.toArrow().column("vector")))  # EVAL_BYTES at most, about

        def run(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            e = data.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, best = _matrix(batch.column(1)), np.full(batch.num_rows, -np.inf)
                for at in range(0, len(e), 4096):
                    best = np.maximum(best, (v @ e[at : at + 4096].T).max(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(best, digits))], ["id", "nearest"])

        one = stream.mapInArrow(run, "id long, nearest double")
        found = one if found is None else found.union(one)
    if blocks > 1:
        found = found.groupBy("id").agg(F.max("nearest").alias("nearest"))
    return found.where(F.col("nearest") < limit)


def candidates(items: DataFrame, queries: DataFrame, positives: DataFrame, k: int, drawn: int) -> DataFrame:
    """qid, id, picked: every query against the items of a training step, which are the union of all
    queries' k best a category, the positives (id) and `drawn` items in the order of a hash.

    A query carries its own picks (k a category) to the items, so the pairs aren't shuffled."""
    top = staged(nearest(items, queries, k, per_creator=False).select("qid", "id"), "picked")
    lot = items.select("id").orderBy(F.sha2(F.concat(F.lit("draw:"), F.col("id").cast("string")), 256)).limit(drawn)
    every = staged(top.select("id").union(positives.select("id")).union(lot).distinct(), "step")
    own = queries.select("qid").join(top.groupBy("qid").agg(F.collect_set("id").alias("_own")), "qid", "left")
    return own.crossJoin(every).select("qid", "id", F.coalesce(F.array_contains("_own", F.col("id")), F.lit(False)).alias("picked"))


def directions(items: DataFrame, dims: int) -> np.ndarray:
    """The `dims` directions that best keep the vectors' products: leading eigenvectors of the sum
    of outer products, which tasks add up (its size is the square of the vectors' length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(0))
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "x"])

    sums = _floats(items.select("vector"), "vector").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")
    n = int(round(len(sums) ** 0.5))
    return np.linalg.eigh(sums.x.to_numpy().reshape(n, n))[1][:, ::-1][:, :dims] if n else np.zeros((0, dims))


def project(items: DataFrame, dims: int) -> DataFrame:
    """id, vector: unit vectors in the space of `dims` directions. Signs of directions are arbitrary
    and cancel out in products."""
    onto = items.sparkSession.sparkContext.broadcast(directions(items, dims))  # length x dims numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1)) @ onto.value
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["id", "vector"])

    return _floats(items.select("id", "vector"), "vector").mapInArrow(run, "id long, vector array<double>")

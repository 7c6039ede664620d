"""Shared scratch tables, Hadoop file access and grouped streaming."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of the Arrow batches that go to a Python worker, about
_caches: dict[str, dict] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a
    local session that has none, a temporary folder of this process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(lambda p=_OWN[app]: __import__("shutil").rmtree(p, ignore_errors=True))
    return _OWN[app]


_folders: set[str] = set()
#: What materialize() has written inside the tables_inside() of this thread or task of the driver.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which goes when the driver process ends."""
    folder = f"{shared_root(spark)}/quillspan/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_sweep, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session has no file access left
        with contextlib.suppress(Exception):  # nor has one whose JVM is going down
            delete(spark, folder)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again. The lineage ends
    there, so a lost executor costs a reread and not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path, compression=compression)
    own = _written.get()
    if own is not None:
        own.append(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._quillspan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no plan needs any more."""
    path = getattr(df, "_quillspan_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    filesystem(spark, path).delete(hadoop_path(spark, path), True)


@contextlib.contextmanager
def tables_inside(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end or when it fails, what materialize() has written inside it in this
    thread: for work whose result is written too."""
    own: list[str] = []
    token = _written.set(own)
    try:
        yield
    finally:
        _written.reset(token)
        for path in own:
            delete(spark, path)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as make it differ from all taken ones."""
    out: list[str] = []
    for name in wanted:
        while name.lower() in {t.lower() for t in [*taken, *out]}:
            name += "_"
        out.append(name)
    return out


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def filesystem(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file: from folder, or the installed public_tokenizers package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a decode."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def wide(df: DataFrame) -> DataFrame:
    """Spread a small table that has few partitions over the cluster's cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def worker_cache(owner: str) -> dict:
    """What a module keeps in a Python worker between tasks, until another module's task runs there."""
    return _caches.setdefault(owner, {})


def _let_go(owner: str) -> None:
    for k in [k for k in _caches if k != owner]:
        del _caches[k]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _batch_default(spark: SparkSession) -> str:
    return spark.newSession().conf.get(_BATCH_SETTING)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow with bounded memory. Workers are reused and outlive their stages:
    a task first drops what other modules cached, and at its end freed memory goes back to
    the system. Batches are bounded by bytes, as 10,000 long texts are too many to hold."""
    owner, spark = run.__module__, SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH_SETTING) == _batch_default(spark):  # not one that the user chose
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(owner)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inside


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys. The caller hash-partitions and sorts
    by the keys first, so a table is one whole group; only that group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.zeros(batch.num_rows, bool)
        edge[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        starts = np.flatnonzero(edge).tolist()
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for s in [*starts, batch.num_rows]:
            held.append(batch.slice(at, s - at))
            if s < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            at = s
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """fn over each group of rows with equal keys, streamed from sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            out = fn(table)
            if out is not None and out.num_rows:
                yield out

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(lean(run), schema)


def keyed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones cannot clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])

"""Tables in and out: Parquet, CSV, JSON lines with a torn tail, half-precision vectors, pickles."""

from __future__ import annotations

import io
import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType, StructField, StructType
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt to all cores by a hash of key, for work that costs much a row: a file of narrow rows has
    few row groups, and so few tasks, however many rows it has."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def csv_columns(spark: SparkSession, path: str, header: list[str], wanted: list[str]) -> DataFrame:
    """The wanted columns of a CSV file with a header, as text; an empty field is null. Spark reads
    no more columns than a plan needs."""
    schema = StructType([StructField(c, StringType()) for c in header])
    return spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').schema(schema).csv(path).select(*wanted)


def json_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines that are all whole; a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a JSON-lines log. A broken last line of a file is dropped, any other is an error;
    no file at all gives no rows."""
    from py4j.protocol import Py4JError

    whole = StructType([*schema.fields, StructField("_bad", StringType())])
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], schema)
    except Py4JError:
        raise ValueError(f"no path: {path}") from None
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
    rows = lines.where(F.trim("value") != "").withColumn("_row", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = rows.groupBy("_file").agg(F.max("_at").alias("_last"))
    broken = rows.where("_row._bad IS NOT NULL").join(last, "_file")
    if broken.where("_at < _last").limit(1).count():
        raise ValueError(f"{path}: a line before the last one is no JSON")
    return rows.where("_row._bad IS NULL").select(*[F.col(f"_row.{f.name}") for f in schema.fields])


def sorted_json(df: DataFrame) -> Column:
    """Each row as JSON with its keys in order."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def replace_folder(spark: SparkSession, path: str, write) -> None:
    """write(staging) beside path, then swap it in: readers see the old rows or the new ones."""
    from quillspan.operators.publish import swapped_in

    staging = f"{path}.new-{uuid.uuid4().hex}"
    write(staging)
    swapped_in(spark, staging, path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Overwrite as JSON lines with sorted keys, whole or not at all."""
    replace_folder(df.sparkSession, path, lambda p: df.select(sorted_json(df).alias("value")).write.text(p))


def write_sorted(df: DataFrame, path: str, key: str) -> None:
    """Overwrite as JSON lines in order of key, then of the whole row. df may come from path."""
    line = sorted_json(df)
    rows = df.select(F.col(key).cast("string").alias("_k"), line.alias("value")).orderBy("_k", "value").select("value")
    replace_folder(df.sparkSession, path, lambda p: rows.write.text(p))


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append as JSON lines. A new file is added in one commit, so no half line can stand before it."""
    df.select(sorted_json(df).alias("value")).write.mode("append").text(path)


@F.pandas_udf(ArrayType(FloatType()))
def decode_half(raw: pd.Series) -> pd.Series:
    """Little-endian half-precision bytes to floats; null if the length is odd or a value isn't finite."""

    def one(b: bytes | None):
        if b is None or len(b) % 2:
            return None
        v = np.frombuffer(b, "<f2").astype(np.float32)
        return v if np.isfinite(v).all() else None

    return raw.map(one)


@F.pandas_udf(BinaryType())
def encode_half(vector: pd.Series) -> pd.Series:
    """Floats to little-endian half-precision bytes; null if one is null or doesn't fit."""

    def one(v):
        if v is None or any(x is None for x in v):
            return None
        with np.errstate(over="ignore"):
            h = np.asarray(v, float).astype("<f2")
        return h.tobytes() if np.isfinite(h).all() else None

    return vector.map(one)


def vector_file(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """file, row, vector of files that hold rows of `dims` half-precision numbers; raises on a file
    of another length."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    odd = files.where(F.length("content") % (2 * dims) != 0).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].path} holds no rows of {dims} numbers")
    rows = files.select("path", F.posexplode(F.expr(f"transform(sequence(0, length(content) div {2 * dims} - 1), i -> substring(content, {2 * dims} * i + 1, {2 * dims}))")).alias("row", "raw"))
    return rows.select("path", "row", decode_half("raw").alias("vector"))


def verified(files: DataFrame, registry: DataFrame) -> DataFrame:
    """name, problem: files (path, content, length) against a registry (name, bytes, sha256)."""
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    both = registry.join(found, "name", "left")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("digest") != F.col("sha256"), "digest")
    return both.select("name", problem.alias("problem"))


class _PlainUnpickler(pickle.Unpickler):
    """Lists, numbers, texts and arrays; anything else in a pickle is refused."""

    _ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.multiarray", "scalar"), ("_codecs", "encode")}

    def find_class(self, module: str, name: str):
        if (module, name) not in self._ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed")
        return super().find_class(module, name)


def pickled_palettes(names: bytes, palettes: bytes) -> list[tuple[str, list[list[float]]]]:
    """(phrase, colours) pairs of two pickles: names (texts or lists of words) and palettes."""
    load = lambda b: _PlainUnpickler(io.BytesIO(b), encoding="latin1").load()
    pairs = zip(load(names), load(palettes), strict=False)
    return [(" ".join(n) if isinstance(n, list | tuple) else str(n), np.asarray(p, float).reshape(-1, 3).tolist()) for n, p in pairs]


def palette_rows(pairs: DataFrame) -> DataFrame:
    """phrase, rgb: the first five colours in 0..255 (those in 0..1 are scaled), rounded half to even;
    pairs (phrase, colors) with fewer colours, other shapes or no phrase go."""
    fit = lambda five: (F.size(five) == 5) & F.forall(five, lambda c: F.size(c) == 3)
    top = lambda five: F.array_max(F.flatten(five))
    scaled = lambda s: F.transform(s["five"], lambda c: F.transform(c, lambda x: F.rint(F.when(s["top"] <= 1, x * 255).otherwise(x)).cast("int")))
    # none or one, worked out once a row: a filter or a colour that named them would do it again
    five = F.filter(F.array(F.slice("colors", 1, 5)), lambda f: F.coalesce(fit(f), F.lit(False)))
    found = F.transform(F.transform(five, lambda f: F.struct(f.alias("five"), top(f).alias("top"))), scaled)
    return pairs.where(F.trim("phrase") != "").select(F.trim("phrase").alias("phrase"), F.explode(found).alias("rgb"))


# --- landed answers of remote sources -----------------------------------------------------


def request_key(url: Column, body: Column | None, secret: str = "api_key") -> Column:
    """The key of a request: its address without the secret parameter, and its body."""
    bare = F.regexp_replace(F.regexp_replace(url, rf"(?<=[?&]){secret}=[^&#]*&?", ""), r"[?&]$", "")
    return F.sha1(bare if body is None else F.concat_ws("#", bare, body))


def cached_answers(requests: DataFrame, landed: DataFrame) -> DataFrame:
    """key, hit, body: whether a request (key) is answered by what has landed (key, at, status, body).
    An answer counts if it is a 200 with a JSON body, or a 404, which is a known nothing; the
    first that counts stays, all others are tried again."""
    good = landed.where((F.col("status") == 404) | ((F.col("status") == 200) & F.try_parse_json("body").isNotNull()))
    first = good.groupBy("key").agg(F.min_by(F.struct(F.when(F.col("status") == 200, F.col("body")).alias("body")), "at").alias("_a"))
    return requests.join(first, "key", "left").select("key", F.col("_a").isNotNull().alias("hit"), F.col("_a.body").alias("body"))


def paged(pages: DataFrame, quota: int) -> DataFrame:
    """source, page, item of landed pages (source, page, pages, items): pages up to the total that the
    source names, up to the first empty one, until the quota is met."""
    w = W.partitionBy("source").orderBy("page")
    n = F.size("items")
    rows = pages.where(F.col("page") <= F.col("pages")).withColumn("_empty", F.max((n <= 0).cast("int")).over(w))
    rows = rows.withColumn("_before", F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where((F.col("_empty") == 0) & (F.col("_before") < quota))
    return rows.select("source", "page", F.explode("items").alias("item"))


def stopped_hosts(log: DataFrame, limit: int) -> DataFrame:
    """host, at, ok, allowed of a request log (host, at, ok): a host is stopped for good after `limit`
    failures in a row."""
    w = W.partitionBy("host").orderBy("at")
    run = log.withColumn("_run", F.sum(F.col("ok").cast("int")).over(w)).withColumn("_fails", F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("host", "_run").orderBy("at")))
    broken = F.max((F.col("_fails") >= limit).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return run.select("host", "at", "ok", (F.coalesce(broken, F.lit(0)) == 0).alias("allowed"))


def paced(requests: DataFrame, interval: float) -> DataFrame:
    """host, at, start: when each request (host, at: seconds, in order of arrival) may start, with at
    least `interval` seconds between two of one host."""
    w = W.partitionBy("host").orderBy("at", "id")
    k = F.row_number().over(w) * F.lit(float(interval))
    rows = requests.withColumn("_k", k)
    return rows.select("host", "id", "at", (F.max(F.col("at") - F.col("_k")).over(w) + F.col("_k")).alias("start"))


def snapshot_poems(lists: DataFrame, single: DataFrame, least: int = 8, most: int = 40) -> DataFrame:
    """author, title, text, once each: authors' whole lists, and for authors without one the poems
    that were fetched by title and have the length that is used."""
    failed = single.join(lists.select("author").distinct(), "author", "left_anti").where(F.size(F.split("text", "\n")).between(least, most))
    return lists.select("author", "title", "text").unionByName(failed.select("author", "title", "text")).distinct()

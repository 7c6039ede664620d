"""Bundles and stores: content-addressed publishing, nested addresses, lookups by code."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.hashing import content_version


def image_key(digest: Column) -> Column:
    """Where an image with this SHA-256 is published: equal images share it."""
    return F.concat(F.lit("img/"), F.substring(digest, 1, 20), F.lit(".webp"))


def uploads(files: DataFrame, online: DataFrame, manifest: str) -> DataFrame:
    """name, turn of the files (name) that aren't online yet; the manifest goes last (turn 1), so a
    prefix that has one has all of its files."""
    return files.join(online.select("name").distinct(), "name", "left_anti").select("name", F.when(F.col("name") == manifest, 1).otherwise(0).alias("turn"))


def reused_prefix(prefixes: DataFrame, content: Column, day: Column) -> DataFrame:
    """One row, prefix, reused: the first online prefix that ends in the content's hash, else a new one."""
    found = prefixes.where(F.col("prefix").endswith(F.concat(F.lit("-"), content, F.lit("/")))).agg(F.min("prefix").alias("_p"))
    return found.select(F.coalesce("_p", F.concat(F.lit("bundles/"), day, F.lit("-"), content, F.lit("/"))).alias("prefix"), F.col("_p").isNotNull().alias("reused"))


def _read(col: Column, parts: list[str]) -> Column:
    """All values at a path of field names; one that ends in [] is an array to go through."""
    head, *rest = parts
    if head.endswith("[]"):
        inner = F.transform(col[head[:-2]], lambda x: _read(x, rest))
        return F.coalesce(F.flatten(inner), F.array().cast("array<string>"))
    return _read(col[head], rest) if rest else F.array(col[head])


def _edit(col: Column, parts: list[str], change) -> Column:
    head, *rest = parts
    if head.endswith("[]"):
        return col.withField(head[:-2], F.transform(col[head[:-2]], lambda x: _edit(x, rest, change)))
    return col.withField(head, _edit(col[head], rest, change) if rest else change(col[head]))


def repointed(rows: DataFrame, record: str, paths: list[str], urls: DataFrame, key: str | None = None) -> DataFrame:
    """rows whose record has, at each path, the url that urls (src, url; one row a src) gives for the
    address there; other addresses stay. Addresses meet urls by a join, so neither is held whole."""
    key = key or next(c for c in rows.columns if c != record)
    parts = [p.split(".") for p in paths]
    every = F.array_distinct(F.concat(*[_read(F.col(record), p) for p in parts]))
    found = rows.select(F.col(key).alias("_key"), F.explode(every).alias("src")).join(urls, "src")
    found = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("src", "url"))).alias("_urls"))
    out = rows.join(found, F.col(key) == F.col("_key"), "left").drop("_key")
    new = F.col(record)
    for p in parts:
        new = _edit(new, p, lambda v: F.coalesce(F.try_element_at(F.col("_urls"), F.coalesce(v, F.lit(""))), v))
    return out.withColumn(record, new).drop("_urls")


def looked_up(codes: DataFrame, stores: list[tuple[str, DataFrame]]) -> DataFrame:
    """code, origin, value: from the first store (code, value) that has the code; null if none has."""
    for k, (_, s) in enumerate(stores):
        codes = codes.join(s.select("code", F.col("value").alias(f"_v{k}")), "code", "left")
    values = [F.col(f"_v{k}") for k in range(len(stores))]
    origin = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for v, (name, _) in zip(values, stores, strict=True)])
    return codes.select("code", origin.alias("origin"), F.coalesce(*values).alias("value"))


def ready_or_computed(asked: DataFrame, ready: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """key, value, precomputed: the stored result if there is one, else the computed one."""
    rows = asked.select(key).join(ready.select(key, F.col("value").alias("_r")), key, "left").join(computed.select(key, F.col("value").alias("_c")), key, "left")
    return rows.select(key, F.coalesce("_r", "_c").alias("value"), F.col("_r").isNotNull().alias("precomputed"))


def opened_path(shared: DataFrame, bundle: Column) -> DataFrame:
    """code, text, trail, note of share links (code, text, trail, bundle; null text: unknown code): a
    path whose bundle isn't this one opens as its feeling."""
    other = (F.size("trail") > 0) & ~F.coalesce(F.col("bundle") == bundle, F.lit(False))
    note = F.when(F.col("text").isNull(), "faded").when(other, "changed")
    empty = F.array().cast("array<string>")
    return shared.select("code", F.coalesce("text", F.lit("")).alias("text"), F.when(other | F.col("trail").isNull(), empty).otherwise(F.col("trail")).alias("trail"), note.alias("note"))


# --- bundles on disk ----------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, path: str, value) -> None:
    """A JSON document, whole or not at all: written beside its place and renamed."""
    part, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()))
    out.close()
    place, _ = _path(spark, path)
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"could not put {path} in place")


def read_document(spark: SparkSession, path: str):
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def swapped_in(spark: SparkSession, staging: str, target: str) -> None:
    """Put a finished folder in the place of another: the old one moves away first, and goes last."""
    new, fs = _path(spark, staging)
    place, _ = _path(spark, target)
    old, _ = _path(spark, f"{target}.old-{uuid.uuid4().hex}")
    if not fs.exists(new):
        raise FileNotFoundError(staging)
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"could not move {target} away")
    done = False
    try:
        done = fs.rename(new, place)
    finally:
        if had and not done:
            fs.rename(old, place)
    if not done:
        raise OSError(f"could not put {target} in place")
    if had:
        fs.delete(old, True)


def bundle_manifest(tables: dict[str, DataFrame], key: str) -> dict:
    """Counts and a version that only the tables' contents decide, whatever files hold them."""
    parts = {}
    for name, df in sorted(tables.items()):
        body = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}), 256)
        rows = df.select(F.col(key).cast("string").alias("k"), body.alias("d"))
        parts[name] = {"rows": df.count(), "digest": content_version(rows, "k", "d").first().version}
    import hashlib

    version = hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:8]
    return {"version": version, "tables": parts}


def write_bundle(tables: dict[str, DataFrame], key: str, target: str, problems: DataFrame | None = None) -> dict:
    """Tables and manifest under target, checked first and swapped in whole; returns the manifest.
    problems: rows that stop the bundle, if there are any."""
    spark = next(iter(tables.values())).sparkSession
    if problems is not None:
        bad = problems.limit(5).collect()
        if bad:
            raise ValueError(f"items have problems, for example {[tuple(r) for r in bad]}")
    staging = f"{target}.new-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    manifest = bundle_manifest({n: spark.read.parquet(f"{staging}/{n}") for n in tables}, key)
    write_document(spark, f"{staging}/manifest.json", manifest)
    swapped_in(spark, staging, target)
    return manifest


def write_rooms(rooms: DataFrame, path: str, code: str = "code") -> None:
    """Precomputed results, one folder a code, so a lookup reads one file."""
    twice = rooms.groupBy(code).agg(F.count_distinct("text").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two texts share the code {twice[0][code]}")
    rooms.repartition(F.col(code)).write.mode("overwrite").partitionBy(code).parquet(path)

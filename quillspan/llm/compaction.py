"""Sharding with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable shards (Parquet files). Compaction groups the
live shards into tiers by size, each tier `FAN` times larger than the one below, and
merges the shards of a tier once there are `FAN` of them, into files of about
`target_bytes`; files that have the target size are left alone. A merge reads its
shards and writes new ones without a shuffle. Every change is one new manifest version:
it is written under a temporary name and renamed to its number, which fails if another
writer had that number first (on file systems whose rename is atomic; on an object store
one writer at a time may commit). Readers use a version's list of files, so they never see
half a change; vacuum() forgets old versions and removes files that none of the kept ones
lists, once they are old enough not to be another writer's next change.

A failed or lost task leaves files that no manifest names. Defined results: an append of
no rows commits a version without a new shard; nulls, repeated rows and any columns are
stored as they are (shard_documents gives a null text 0 bytes and a null digest); 
an append whose columns differ from the store's in name, type or order is refused before anything is written.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.llm.common import filesystem, hadoop_path, scratch_path

FAN = 4
SMALL = 1 << 20
TARGET = 128 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    level: int  # merges behind it


class ShardStore:
    """Immutable shards under root, as listed by the newest manifest."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET, fan: int = FAN) -> None:
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        self.fs = filesystem(spark, root)

    def _path(self, name: str):
        return hadoop_path(self.spark, f"{self.root}/{name}")

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path("manifest")):
            return []
        return sorted(int(n[1:-5]) for s in self.fs.listStatus(self._path("manifest")) if (n := s.getPath().getName()).startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"manifest/v{found[-1] if version is None else version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        out = json.loads(text)
        return out | {"shards": [Shard(**s) for s in out["shards"]]}

    def _commit(self, base: dict, shards: list[Shard], schema: str | None) -> int:
        version = base["version"] + 1
        body = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]})
        temporary, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{version:08d}.json")
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(temporary, final):
            self.fs.delete(temporary, False)
            raise RuntimeError(f"version {version} was committed by another writer; retry from the newest one")
        return version

    def _write(self, df: DataFrame, level: int) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return [Shard(f"{folder}/{n}", s.getLen(), level) for s in self.fs.listStatus(self._path(folder)) if (n := s.getPath().getName()).endswith(".parquet") and s.getLen()]

    def append(self, df: DataFrame) -> int:
        """Store df's partitions as new small shards and commit; returns the version."""
        base = self.manifest()
        if base["schema"]:
            shape = lambda schema: [(f.name, f.dataType.simpleString()) for f in schema.fields]
            have, new = shape(StructType.fromJson(json.loads(base["schema"]))), shape(df.schema)
            if have != new:
                raise ValueError(f"the store has the columns {have}, the append {new}")
        new = self._write(df, 0)
        return self._commit(base, base["shards"] + new, base["schema"] or df.schema.json())

    def tiers(self, shards: list[Shard]) -> dict[int, list[Shard]]:
        """Shards below the target size by tier: SMALL * fan ** tier bytes at most."""
        out: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes <= self.target:
                tier = 0
                while s.bytes > SMALL * self.fan**tier:
                    tier += 1
                out.setdefault(tier, []).append(s)
        return out

    def compact(self) -> int:
        """Merge full tiers, smallest first, until none is full; returns the version."""
        while True:
            base = self.manifest()
            full = [(t, s) for t, s in sorted(self.tiers(base["shards"]).items()) if len(s) >= self.fan]
            if not full:
                return base["version"]
            tier, runs = full[0]
            runs = sorted(runs, key=lambda s: s.path)
            rows = self._read(base, runs)
            total = sum(s.bytes for s in runs)
            # files of the next tier's size, or of the target size
            files = max(1, round(total / min(self.target, SMALL * self.fan ** (tier + 1))))
            merged = self._write(rows.coalesce(min(files, max(1, len(runs) // 2))), 1 + max(s.level for s in runs))
            gone = {s.path for s in runs}
            self._commit(base, [s for s in base["shards"] if s.path not in gone] + merged, base["schema"])

    def _read(self, manifest: dict, shards: list[Shard]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m, m["shards"])

    def vacuum(self, keep_versions: int = 10, min_age: float = 86_400.0) -> int:
        """Forget all but the newest keep_versions manifests, and delete files that none of
        those lists and that are older than min_age seconds, so that what another writer has
        written but not yet committed stays; returns how many files."""
        versions = self.versions()
        live = {s.path for v in versions[-keep_versions:] for s in self.manifest(v)["shards"]}
        for v in versions[:-keep_versions]:
            self.fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        if not self.fs.exists(self._path("data")):
            return 0
        gone, before = 0, (time.time() - min_age) * 1000
        for folder in self.fs.listStatus(self._path("data")):
            name, kept = folder.getPath().getName(), False
            for f in self.fs.listStatus(folder.getPath()):
                if f"data/{name}/{f.getPath().getName()}" in live or f.getModificationTime() > before:
                    kept = True
                else:
                    gone += bool(self.fs.delete(f.getPath(), True))
            if not kept and folder.getModificationTime() <= before:
                self.fs.delete(folder.getPath(), True)
        return gone


def shard_documents(docs: DataFrame, target_bytes: int = TARGET, arrivals: int = 3) -> DataFrame:
    """Append docs in `arrivals` batches (halving in size, by a hash of the row),
    compacting after each, and read the newest version back: doc_id, n_bytes,
    text_md5, shard (file name), version."""
    store = ShardStore(docs.sparkSession, scratch_path(docs.sparkSession, "shards"), target_bytes)
    # 2 ** (arrivals - 1) slices: the first batch has half of them, the last two have one each
    slices = 1 << (arrivals - 1)
    draw = F.pmod(F.xxhash64(*[c for c in ("doc_id", "n_chars", "source", "lang") if c in docs.columns]), F.lit(slices))
    lo = 0
    for k in range(arrivals):
        hi = lo + max(1, slices >> (k + 1)) if k < arrivals - 1 else slices
        store.append(docs.where((draw >= lo) & (draw < hi)))
        store.compact()
        store.vacuum(keep_versions=1, min_age=-60)  # the store is this call's own, so nobody else writes
        lo = hi
    out = store.read().select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"))
    return out.withColumn("version", F.lit(store.versions()[-1]).cast("long"))


#: The rows that come back; their files have no fixed names.
SQL = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents"

"""Tables that several writers change: every change is a new version, and one writer gets it.

A store is a folder with `data`, one folder a change, and `versions`, one small document a
version that names the data folder that it shows. A version's document is created only if
nobody has created it before, so of two writers that start from one version one wins;
the other begins again from the newest. Readers take the newest document and the folder
it names; neither is ever moved or overwritten, so they never find half a table or none.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from quillspan.operators.publish import _path, read_document


class Lost(RuntimeError):
    """Another writer has committed the version."""


def put_once(spark: SparkSession, path: str, body: bytes) -> bool:
    """Create a file with this content; False if there is one. HDFS and object stores with
    conditional writes decide it in create(); a local file system only in link()."""
    p, fs = _path(spark, path)
    if fs.getUri().getScheme() == "file":
        place = urlparse(path).path if path.startswith("file:") else path
        os.makedirs(os.path.dirname(place), exist_ok=True)
        part = f"{place}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    try:
        out = fs.create(p, False)
        out.write(bytearray(body))
        out.close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getSimpleName() or fs.exists(p):
            return False
        raise
    return True


class VersionedTable:
    """A table under root, as its newest version shows it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _document(self, version: int) -> str:
        return f"{self.root}/versions/{version:010d}.json"

    def version(self) -> int:
        """The newest version, 0 before the first."""
        p, fs = _path(self.spark, f"{self.root}/versions")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[:10]) for n in names if n.endswith(".json") and n[:10].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        shown = read_document(self.spark, self._document(self.version() if version is None else version))
        return self.spark.read.parquet(f"{self.root}/data/{shown['data']}")

    def note(self, version: int) -> dict:
        return read_document(self.spark, self._document(version))

    def commit(self, base: int, rows: DataFrame, **note) -> int:
        """Write rows and show them as the version after base; Lost if that exists. What a loser has
        written goes."""
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{data}")
        if not put_once(self.spark, self._document(base + 1), json.dumps({"data": data, **note}, sort_keys=True).encode()):
            p, fs = _path(self.spark, f"{self.root}/data/{data}")
            fs.delete(p, True)
            raise Lost(f"version {base + 1} of {self.root} was committed by another writer")
        return base + 1

    def change(self, to: Callable[[DataFrame | None], DataFrame], tries: int = 10, **note) -> int:
        """Commit to(newest rows, None before the first), again from the newest version each time that
        another writer is faster."""
        for left in range(tries - 1, -1, -1):
            base = self.version()
            try:
                return self.commit(base, to(self.read(base) if base else None), **note)
            except Lost:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest `keep` versions and their data; what no version shows yet stays, as
        its writer may still commit it. Returns how many versions went."""
        newest, gone = self.version(), 0
        for version in range(max(1, newest - keep), 0, -1):
            p, fs = _path(self.spark, self._document(version))
            if not fs.exists(p):
                break
            if version <= newest - keep:
                data, _ = _path(self.spark, f"{self.root}/data/{read_document(self.spark, self._document(version))['data']}")
                fs.delete(p, False)
                fs.delete(data, True)
                gone += 1
        return gone


def prune(store: VersionedTable, seen: int, keep: Callable[[DataFrame], DataFrame]) -> int:
    """Commit what keep() leaves of the version that was inspected; Lost if it is no longer the newest:
    the report that the prune was decided on doesn't hold any more."""
    if store.version() != seen:
        raise Lost(f"{store.root} changed after version {seen} was inspected")
    return store.commit(seen, keep(store.read(seen)), pruned=True)

"""Tables that are replaced or corrected as a whole: write aside, then swap a pointer.

A table is a folder with ``data/`` (Parquet, one folder a write and bucket) and
``_versions/`` (one small JSON file a version, naming the folder of each bucket).
A write puts its rows into new folders and then adds the next version file; the
highest version is the table.  So readers see a whole version or the one before,
never a mix, and a write that dies leaves only folders that no version names.

``bucket`` is an expression over a row's columns, kept in the table; a write that
touches some keys rewrites only the buckets in which they lie.  The driver handles
bucket names (days, hash buckets), never rows.  Files go through Hadoop's file
system, as Spark's own do, so any shared store will do.

Two writers at once: the version file of one exists first, the other gets
``ConcurrentWrite`` and may start again from the new version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.materialize import materialize

_BUCKET = "_bucket"


class ConcurrentWrite(RuntimeError):
    """Another writer committed the version that this one was about to."""


def hash_bucket(key: str, count: int = 16) -> str:
    """A bucket expression for keys of no natural range."""
    return f"cast(pmod(xxhash64({key}), {count}) as string)"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], bucket: str):
        self.spark, self.path, self.key, self.bucket = spark, path.rstrip("/"), key, bucket

    # ------------------------------------------------------------ versions

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._file("_versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "buckets": {}, "marks": {}}
        path, fs = self._file(f"_versions/{version or known[-1]:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        name = f"{manifest['version']:010d}.json"
        aside, fs = self._file(f"_versions/_{uuid.uuid4().hex}")
        final, _ = self._file(f"_versions/{name}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise ConcurrentWrite(f"{self.path}: version {manifest['version']} is there already")

    def marks(self) -> dict:
        """What writers noted with the current version, as the last epoch of a stream."""
        return self._manifest()["marks"]

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(version), None)

    def _rows(self, manifest: dict, buckets: set[str] | None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} holds no version")
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/data/{f}" for b, f in sorted(manifest["buckets"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Folders of the buckets that ``rows`` fill."""
        name = uuid.uuid4().hex
        rows.withColumn(_BUCKET, F.expr(self.bucket)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
        folder, fs = self._file(f"data/{name}")
        names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith(f"{_BUCKET}=")]
        return {n.removeprefix(f"{_BUCKET}="): f"{name}/{n}" for n in names}

    def replace(self, rows: DataFrame, marks: dict | None = None) -> int:
        """The table becomes ``rows``; the number of the new version."""
        old = self._manifest()
        version = old["version"] + 1
        self._commit({"version": version, "schema": rows.schema.jsonValue(), "buckets": self._write(rows), "marks": old["marks"] | (marks or {})})
        return version

    def upsert(self, rows: DataFrame, marks: dict | None = None) -> int:
        """The rows of each key in ``rows`` replace those that the table has of it."""
        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            keys = new.select(*[F.col(k).alias(f"_new_{k}") for k in self.key]).distinct()
            same: Column = F.lit(True)
            for k in self.key:
                same = same & old[k].eqNullSafe(keys[f"_new_{k}"])
            return old.join(keys, same, "left_anti").unionByName(new)

        return self.merge(rows, combine, marks)

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], marks: dict | None = None) -> int:
        """Each bucket that ``rows`` touch becomes ``combine(its rows, the new rows)``; the others stay as they are."""
        old = self._manifest()
        version = old["version"] + 1
        rows = materialize(rows)
        buckets = {r[0] for r in rows.select(F.expr(self.bucket)).distinct().collect()}  # names of days or hash buckets
        named = {"__HIVE_DEFAULT_PARTITION__" if b in (None, "") else str(b) for b in buckets}
        if old["schema"] is not None:
            rows = combine(self._rows(old, named), rows)
        kept = {b: f for b, f in old["buckets"].items() if b not in named}
        self._commit({"version": version, "schema": rows.schema.jsonValue(), "buckets": kept | self._write(rows), "marks": old["marks"] | (marks or {})})
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the last ``keep`` name; how many folders went.  Not beside a running write."""
        known = self.versions()
        if not known:
            return 0
        wanted = {f for v in known[-keep:] for f in self._manifest(v)["buckets"].values()}
        gone = 0
        data, fs = self._file("data")
        for write in fs.listStatus(data):
            for bucket in fs.listStatus(write.getPath()):
                if bucket.isDirectory() and f"{write.getPath().getName()}/{bucket.getPath().getName()}" not in wanted:
                    gone += bool(fs.delete(bucket.getPath(), True))
        for v in known[:-keep]:
            fs.delete(self._file(f"_versions/{v:010d}.json")[0], False)
        return gone

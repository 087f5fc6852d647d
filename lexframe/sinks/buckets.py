"""SNK2-SNK4: tables whose merges rewrite only the buckets they touch.

A table is a folder of parquet buckets (``pmod(xxhash64(key), buckets)``) and numbered
manifests that name the folder of each bucket.  A merge reads the touched buckets,
writes their new content beside the old and commits by renaming the next manifest into
place; the folders of all other buckets stay as they are.  A reader takes the newest
manifest, so it sees a whole table before and after; two merges that start from one
manifest cannot both commit.  ``vacuum`` deletes folders that no manifest names.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: a bucket is written by up to so many tasks, so that one large key is not one task's
WRITERS = 8


class BucketTable:
    """A table of ``schema`` (DDL) in buckets of ``key``; made on first use.  The number
    of buckets is fixed when the table is made: choose it so that a bucket is some
    hundred megabytes at the table's final size."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "law_id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), T._parse_datatype_string(schema), key
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)
        if not self._versions():
            self._commit(0, {"buckets": buckets, "folders": {}})

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _versions(self) -> list[int]:
        folder = self._path("_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest."""
        version = self._versions()[-1]
        stream = self._fs.open(self._path("_manifest", f"{version:010d}.json"))
        try:
            return version, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, content: dict) -> None:
        draft = self._path("_manifest", f"_{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        final = self._path("_manifest", f"{version:010d}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise OSError(f"another merge wrote manifest {version} of {self.path}")

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col(self.key).cast("bigint")), F.lit(buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table, or only some buckets of it."""
        folders = self.manifest()[1]["folders"]
        chosen = [f"{self.path}/{f}" for b, f in sorted(folders.items()) if only is None or int(b) in only]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def merge(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of ``keys`` by ``change`` of their rows; the others stay.
        ``change`` must give rows of these buckets only.  Returns the touched buckets."""
        version, content = self.manifest()
        n = content["buckets"]
        touched = sorted(r[0] for r in keys.select(self.bucket(n)).distinct().collect())  # n rows at most
        if not touched:
            return []
        columns = self.schema.fieldNames()
        rows = change(self.read(touched)).select(*columns).withColumn("_bucket", self.bucket(n))
        folder = f"data-{uuid.uuid4().hex}"
        writer = F.pmod(F.xxhash64(*[c for c in columns if not isinstance(self.schema[c].dataType, T.MapType)]), F.lit(WRITERS))
        rows.repartition("_bucket", writer).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        folders = {b: f for b, f in content["folders"].items() if int(b) not in touched}
        written = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()}
        if not written <= set(touched):
            raise ValueError(f"the change gave rows of other buckets: {sorted(written - set(touched))}")
        folders |= {str(b): f"{folder}/_bucket={b}" for b in sorted(written)}
        self._commit(version + 1, {"buckets": n, "folders": folders})
        return touched

    def replace(self, batch: DataFrame, keys: DataFrame | None = None) -> list[int]:
        """SNK3/SNK4: every key of ``keys`` (of ``batch`` by default) loses its rows and
        gets those of ``batch``; a key may come back with none."""
        asked = (keys if keys is not None else batch).select(self.key).distinct()
        columns = self.schema.fieldNames()
        return self.merge(asked, lambda old: old.join(asked, self.key, "left_anti").select(*columns)
                          .unionByName(batch.select(*columns)))

    def vacuum(self) -> None:
        """Delete the older manifests and the folders that the newest does not name."""
        version, content = self.manifest()
        used = set(content["folders"].values())
        for v in self._versions()[:-1]:
            self._fs.delete(self._path("_manifest", f"{v:010d}.json"), False)
        for data in self._fs.listStatus(self._path()):
            name = data.getPath().getName()
            if name.startswith("data-"):
                for b in self._fs.listStatus(data.getPath()):
                    if f"{name}/{b.getPath().getName()}" not in used:
                        self._fs.delete(b.getPath(), True)
                if not any(f.startswith(f"{name}/") for f in used):
                    self._fs.delete(data.getPath(), True)

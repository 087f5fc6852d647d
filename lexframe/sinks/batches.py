"""SNK6/SNK8: a table that grows by whole batches.

The folder holds one sub-folder per batch (``batch=0``, ``batch=1``, ..).  A batch is
written to a hidden folder beside them and takes its place by one rename, so a reader
sees all rows of a batch or none, and a job that ends between two batches is taken up
where it stopped.  One writer at a time.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "batch="


class BatchTable:
    """Rows of ``ddl`` under ``path``; the folder is made when it is missing."""

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path, self.ddl = spark, path.rstrip("/"), ddl
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[len(_PREFIX):]) for n in names if n.startswith(_PREFIX))

    def read(self) -> DataFrame:
        """The rows of all batches that are committed now."""
        paths = [f"{self.path}/{_PREFIX}{n}" for n in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(*paths)

    def append(self, rows: DataFrame) -> int:
        """Commit ``rows`` as the next batch; its number."""
        done = self.batches()
        number = done[-1] + 1 if done else 0
        staging = self._path(f"{self.path}/_new-{uuid.uuid4().hex}")
        target = self._path(f"{self.path}/{_PREFIX}{number}")
        columns = self.spark.createDataFrame([], self.ddl).columns
        rows.select(*columns).write.parquet(staging.toString())
        if self._fs.exists(target) or not self._fs.rename(staging, target):
            self._fs.delete(staging, True)
            raise OSError(f"batch {number} of {self.path} was committed by another writer")
        return number

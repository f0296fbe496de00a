"""Tables of several pieces in a shared folder, with numbered versions that say which pieces are in force."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see. Where it is unset, a local master gets
    a temporary folder; a cluster is an error, as no local folder would do there."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int = 1000, size: str = "8m", read: int | None = None) -> Iterator[None]:
    """Jobs that run inside get Arrow batches of at most so many rows and bytes, and read so many rows of a Parquet file at
    once; the session's settings come back after it."""
    mine = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    if read:
        mine["spark.sql.parquet.columnarReaderBatchSize"] = str(read)
    before = {k: spark.conf.get(k, None) for k in mine}
    try:
        for k, v in mine.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Versions:
    """The pieces of a table under `path`, and which of them each version has.

    A writer writes its piece first and then a version that names it, so a reader sees all of a change or nothing, and
    what a failed writer left is never read. A version is a few lines of JSON, one a piece; pieces are only ever added
    or left out, so they are few (one a batch) between compactions. There is one writer at a time: of two that commit
    the same number, one fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.read: dict[int, list[dict]] = {}  # a version never changes

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def number(self) -> int:
        """The newest whole version, 0 if there is none."""
        fs, p = self._files(f"{self.path}/versions")
        if not fs.exists(p):
            return 0
        found = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)]
        done = [int(n) for n, at in found if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))]
        return max(done, default=0)

    def pieces(self, number: int | None = None) -> list[dict]:
        number = self.number() if number is None else number
        if not number:
            return []
        if number not in self.read:
            self.read[number] = [json.loads(r.value) for r in self.spark.read.text(f"{self.path}/versions/{number}").collect()]
        return self.read[number]

    def commit(self, after: int, pieces: list[dict]) -> int:
        """Make `pieces` the version after that number; fails if somebody else has."""
        if self.number() != after:
            raise RuntimeError(f"{self.path} has got another version than {after}")
        rows = self.spark.createDataFrame([(json.dumps(x, sort_keys=True),) for x in pieces] or [], "value string")
        # what a writer left that died in here has no _SUCCESS and is written over
        rows.coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/{after + 1}")
        return after + 1

    def next_piece(self) -> int:
        """A number above those of all pieces in the newest version; what a failed writer left under it is written over."""
        return max((x["piece"] for x in self.pieces()), default=0) + 1

    def drop(self) -> None:
        fs, p = self._files(self.path)
        fs.delete(p, True)

    def exists(self) -> bool:
        return self.number() > 0


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)

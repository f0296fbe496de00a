"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A-Z to a-z for byte strings, all other bytes as they are.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd number, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly if it comes in fewer pieces than there are cores, as one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def bucket_of(key: Column | str, n: int) -> Column:
    """crc32 of a key's text modulo n; the fold rule of the labelled tables."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def unused(name: str, df: DataFrame) -> str:
    """The name, with as many underscores before it as keep it apart from df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16_000_000) -> None:
    """From now on, the session's Arrow batches have at most `rows` rows and `size` bytes (a single longer row is a batch
    of its own); smaller limits that are set stay. Operators that return a lazy table can't take this back after them:
    it bounds what a Python worker holds, here and in later jobs, and changes no result."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = "".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-")
        if not 0 < int(now or 0) < most or spark.conf.get(key)[-1].isalpha():
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see.

    Where it is unset, a local master gets a temporary folder; a cluster is an error, as no local folder would do there."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


class Scratch:
    """Tables that are written to the shared folder and read again. They cut lineage, outlive lost executors, and go
    when they are superseded, so that rounds of a job take no more disk than one round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df written and read again; an earlier table of that name is dropped after that."""
        path, old = f"{self.folder}/{name}-{len(self.paths)}-{uuid.uuid4().hex[:8]}", self.paths.get(name)
        df.write.parquet(path)
        self.paths[name] = path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there; the table stays as long as the folder."""
    return Scratch(df.sparkSession).keep("table", df)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of text or a single row."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(c).to_numpy(zero_copy_only=False), dtype=float))
        total, start = 0.0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0.0
            total += n
        yield b.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (BASE, BASE_INV):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[size] = tuple(tables)
    return _powers[size]


def hash_words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of A-Z-lower-cased UTF-8 bytes, in order."""
    a = np.frombuffer(data.translate(LOWER_BYTES), dtype=np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    word = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * M2)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h * M1 + words[j : n - k + 1 + j])
    return np.unique(h)

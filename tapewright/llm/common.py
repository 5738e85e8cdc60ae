"""What the text operators share: reading, scratch tables, key arithmetic."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is on this machine (the files are installed on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a local one only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tapewright-shared")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that later stages read them instead of recomputing lineage.

    ``put`` writes Parquet and reads it back with the known schema; ``drop`` removes a table that nothing needs any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.sweep)

    @contextlib.contextmanager
    def tidy(self):
        """Queries started within let go of their shuffle files as soon as they end, since what they wrote stands."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, before)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path, schema = f"{self.at}/{self.n}-{name}", df.schema
        with self.tidy():
            df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        del df
        return out

    def put_bucketed(self, df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
        """As ``put``, in files by a hash of ``key``: grouping what is read by that key needs no shuffle."""
        self.n += 1
        path, known = f"{self.at}/{self.n}-{name}", f"{name}_{uuid.uuid4().hex}"
        with self.tidy():
            df.write.bucketBy(buckets, key).option("path", path).saveAsTable(known, format="parquet")
        out = self.spark.table(known)
        out._scratch_path, out._scratch_name = path, known
        return out

    def forget(self, bucketed: DataFrame) -> None:
        """Takes a bucketed table, which nothing reads any more, from the catalog and the folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {bucketed._scratch_name}")
        self.drop(bucketed)

    def delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.delete(t._scratch_path)

    def sweep(self) -> None:
        """At the driver's end, while its session still stands, what it left goes: results are read lazily, so not before."""
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                self.delete(self.at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(column: str, m: int):
    """crc32 of the column's text, modulo m (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shift-xor-multiply rounds) on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """uint64 hashes to doubles in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def texts(batch, column: str = "text") -> list[str]:
    """A column of an Arrow batch as Python strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bounded(batches: Iterator, rows: int = 512, mb: int = 8) -> Iterator:
    """Slices of Arrow batches, of few rows and bytes, so that a worker's memory does not follow Spark's batch size."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * mb * 2**20 / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def doc_columns(docs: DataFrame, *more) -> DataFrame:
    """doc_id and text alone, whatever other columns the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def runs(batches: Iterator, *keys: str) -> Iterator:
    """Arrow tables, one for each run of equal keys, from batches sorted by them; only one run is held."""
    import pyarrow as pa

    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for i in range(len(starts) - 1):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(starts[i], starts[i + 1] - starts[i]))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)

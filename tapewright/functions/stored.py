"""Tables that several branches of a query read: written once to the shared folder instead of being derived by each."""

from __future__ import annotations

import atexit
import contextlib
import gc
import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tapewright-shared")
    return folder.rstrip("/")


def forget(spark: SparkSession, folder: str) -> None:
    """Removes a folder while the session still stands; results are read lazily, so not before all that reads it is written, or the driver's end."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of the tables stored within each open ``scratch``, the innermost last.
_scratches: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are removed at its end, and shuffle files that nothing refers to any more with them.

    Spark removes those when the driver happens to collect its garbage, which may be after the query. Nothing that is
    still to be read may be within: what leaves is stored with ``outlive``.
    """
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            forget(spark, path)
        gc.collect()
        with contextlib.suppress(Exception):
            spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, outlive: int = 0) -> DataFrame:
    """The table as Parquet in the shared folder, read back: later reads prune columns and survive a lost executor without its lineage.

    It goes with the innermost ``scratch`` but for ``outlive``, or with the driver.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_scratches) > outlive:
        _scratches[-1 - outlive].append(path)
    else:
        atexit.register(forget, spark, path)
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, root: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built once for its settings and then read, by later sessions too.

    ``settings`` must name all that the table depends on (days, weights, factors, the version of its data): the folder
    below ``root`` is a digest of all of them. A folder without the mark of a finished write, as a lost run leaves it, is
    built again.
    """
    path = f"{root.rstrip('/')}/{hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:32]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""A table that micro-batches merge into, whose readers see whole snapshots only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.stored import exists
from ..operators.feeds import upsert


class VersionedTable:
    """One row a key, in parts by a hash of it. A merge writes the parts that it touches anew and then a manifest that names every part's folder.

    A manifest counts once its write has ended, so whatever is lost before leaves the snapshot before it, and a batch that
    is run again does its work again, or none if it was committed. Folders that neither of the two newest manifests names
    are removed, so readers of the snapshot before are not disturbed. Where parts have grown past ``rows`` rows on average
    there are twice as many from the next merge on, which rewrites all of them.

    Of rows of one key the one with the largest ``order`` stays, or the smallest with ``first``; of equal ones that with
    the largest hash. A table that nothing was merged into is empty.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str, first: bool = False, rows: int = 1_000_000):
        self.spark, self.path, self.schema, self.keys, self.order, self.first, self.rows = spark, path.rstrip("/"), schema, keys, order, first, rows

    def numbers(self) -> list[int]:
        """Batches that were committed, the oldest first."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit() and exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS"))

    def manifest(self, n: int | None = None) -> dict:
        """batch, parts, folders (of each part that has rows) and counts, of the newest commit or a given one."""
        if n is None:
            done = self.numbers()
            if not done:
                return {"batch": -1, "parts": 1, "folders": {}, "counts": {}}
            n = done[-1]
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{n}").first()[0])

    def folders(self, found: dict, parts: list[str] | None = None) -> list[str]:
        return [f"{self.path}/{found['folders'][p]}/_part={p}" for p in (found["folders"] if parts is None else parts) if p in found["folders"]]

    def load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The newest snapshot."""
        return self.load(self.folders(self.manifest()))

    def write(self, batch: DataFrame, n: int) -> dict | None:
        """Writes the parts that a batch touches, and gives the manifest that would make them count; nothing if that was committed."""
        before = self.manifest()
        if before["batch"] >= n:
            return None
        parts, total = before["parts"], sum(before["counts"].values())
        grown = parts
        while total > grown * self.rows:
            grown *= 2
        part = F.pmod(F.xxhash64(*self.keys), F.lit(grown)).cast("int")
        new = batch.select(*self.schema.names)
        if grown == parts:
            touched = [str(r[0]) for r in new.select(part.alias("p")).distinct().collect()]
            if not touched and before["batch"] >= 0:
                return before | {"batch": n}
            kept, old = dict(before["folders"]), self.load(self.folders(before, touched))
        else:
            kept, old = {}, self.load(self.folders(before))
        order = F.struct(F.col(self.order), F.xxhash64(*self.schema.names))
        merged = upsert(old.unionByName(new), self.keys, order.asc() if self.first else order.desc()).withColumn("_part", part)
        folder = f"data/{n}"
        merged.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/{folder}")
        whole = StructType([*self.schema.fields, StructField("_part", IntegerType())])
        counts = {str(r["_part"]): r["count"] for r in self.spark.read.schema(whole).parquet(f"{self.path}/{folder}").groupBy("_part").count().collect()}
        return {"batch": n, "parts": grown, "folders": kept | dict.fromkeys(counts, folder), "counts": {p: c for p, c in before["counts"].items() if p in kept} | counts}

    def commit(self, found: dict) -> None:
        """Makes a manifest the newest; its write's end mark is what readers go by."""
        self.spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{found['batch']}")

    def sweep(self) -> None:
        """Removes what neither of the two newest manifests names."""
        done = self.numbers()
        live = {f for n in done[-2:] for f in self.manifest(n)["folders"].values()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = data.getFileSystem(conf)
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in live and int(s.getPath().getName()) <= done[-1]:
                fs.delete(s.getPath(), True)
        for n in done[:-2]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{n}"), True)

    def merge(self, batch: DataFrame, n: int) -> None:
        """For ``foreachBatch``: batches come by rising number, one at a time."""
        found = self.write(batch, n)
        if found is not None:
            self.commit(found)
            self.sweep()


def merge_stream(rows: DataFrame, table: VersionedTable, checkpoint: str) -> DataFrame:
    """Merges what a stream has now and gives the snapshot. With the same checkpoint it goes on where it stopped."""
    query = rows.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()

"""Stores for the records of task successes.

record rows: task_id, side, ref_key, stamp (see plans.skip). SnapshotStore keeps them as versions of a Parquet table; a version counts once
the one-line file CURRENT names it, which is replaced by a rename, so a writer that dies leaves the last version. One
writer at a time. All paths go through Hadoop's file systems, so the folder may be in any store Spark can use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "task_id string, side string, ref_key string, stamp string"


class StoreError(RuntimeError):
    """The store's files can't be read."""


class MemoryStore:
    """Records of this session only."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._rows: list[tuple] = []

    def read(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, SCHEMA)

    def set(self, rows: DataFrame) -> None:
        new = [tuple(r) for r in rows.select("task_id", "side", "ref_key", "stamp").collect()]
        touched = {r[0] for r in new}
        self._rows = [r for r in self._rows if r[0] not in touched] + new

    def delete(self, task_ids: list[str]) -> None:
        gone = set(task_ids)
        self._rows = [r for r in self._rows if r[0] not in gone]

    def clear(self) -> None:
        self._rows = []


class SnapshotStore:
    """Versioned Parquet snapshots below a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("CURRENT").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """0: nothing was written yet."""
        fs, path = self._fs(), self._path("CURRENT")
        if not fs.exists(path):
            return 0
        text = self.spark.read.text(f"{self.folder}/CURRENT").first()
        try:
            return int(text[0])
        except (TypeError, ValueError):
            raise StoreError(f"{self.folder}/CURRENT doesn't name a version") from None

    def read(self) -> DataFrame:
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], SCHEMA)
        try:
            df = self.spark.read.parquet(f"{self.folder}/v={v}")
        except Exception as e:
            raise StoreError(f"version {v} of {self.folder} can't be read") from e
        if df.dtypes != [tuple(x.strip().split(" ")) for x in SCHEMA.split(",")]:
            raise StoreError(f"version {v} of {self.folder} has other columns")
        return df

    def _write(self, rows: DataFrame) -> None:
        v = self.version() + 1
        rows.select("task_id", "side", "ref_key", "stamp").repartition(self.buckets, "task_id").write.mode("overwrite").parquet(f"{self.folder}/v={v}")
        fs, temp, at = self._fs(), self._path("CURRENT.new"), self._path("CURRENT")
        out = fs.create(temp, True)
        out.write(f"{v}\n".encode())
        out.close()
        # rename onto an existing file isn't atomic in every store: FileContext's is
        jvm = self.spark._jvm
        opts = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(temp), fs.makeQualified(at), opts)
        if v > 2:  # the version before may still be read by a plan made earlier
            fs.delete(self._path(f"v={v - 2}"), True)

    def set(self, rows: DataFrame) -> None:
        """Replaces the records of the tasks in rows."""
        kept = self.read().join(rows.select("task_id").distinct(), "task_id", "left_anti")
        self._write(kept.select("task_id", "side", "ref_key", "stamp").unionByName(rows.select("task_id", "side", "ref_key", "stamp")))

    def delete(self, task_ids: list[str]) -> None:
        gone = self.spark.createDataFrame([(t,) for t in task_ids], "task_id string")
        self._write(self.read().join(gone, "task_id", "left_anti"))

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The table after a changelog with `op` ('found' or 'gone'): the last change per key wins; gone keys leave."""
    from ..operators.changes import latest

    cols = [c for c in table.columns if c != order]
    old = table.select(*cols, F.lit(-1).cast("long").alias(order), F.lit("found").alias("op"))
    return latest(old.unionByName(changes.select(*cols, order, "op")), keys, order).where("op = 'found'").select(*cols)

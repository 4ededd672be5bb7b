"""Keyed tables kept as Parquet: a base plus the changed rows of every later batch.

A batch writes only the rows it changed, under its own version, so a batch that is run again overwrites its own
output and nothing else. Plain Parquet has no MERGE; where a table format offers one, use it instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from feedloom.operators.skew import bounded, restrict


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``root`` whose rows are unique on ``keys``."""

    spark: SparkSession
    root: str
    keys: Sequence[str]
    schema: str

    def _struct(self) -> StructType:
        return StructType.fromDDL(self.schema)

    def _versions(self, part: str) -> list[int]:
        """Complete versions below ``part``; one directory entry per batch since the last compaction."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "version=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _load(self, part: str, versions: list[int]) -> DataFrame:
        paths = [f"{self.root}/{part}/version={v}" for v in versions]
        return self.spark.read.schema(self._struct()).option("basePath", f"{self.root}/{part}").parquet(*paths)

    def write_base(self, rows: DataFrame, version: int = 0) -> None:
        rows.select(self._struct().names).write.mode("overwrite").parquet(f"{self.root}/base/version={version}")

    def write(self, changed: DataFrame, version: int) -> None:
        """Store the changed rows of a batch; versions start at 1."""
        changed.select(self._struct().names).write.mode("overwrite").parquet(f"{self.root}/changes/version={version}")

    def newest(self) -> int:
        """The last complete version, 0 of an empty table."""
        return max([0, *self._versions("base"), *self._versions("changes")])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version`` (default: the newest): the newest change of each key, else its base row."""
        version = self.newest() if version is None else version
        names = self._struct().names
        bases = [v for v in self._versions("base") if v <= version]
        start = bases[-1] if bases else 0
        changes = [v for v in self._versions("changes") if start < v <= version]
        base = self._load("base", bases[-1:]) if bases else self.spark.createDataFrame([], self._struct())
        if not changes:
            return base.select(names)
        logged = (
            self.spark.read.schema(self._struct().add("version", IntegerType()))
            .option("basePath", f"{self.root}/changes")
            .parquet(*[f"{self.root}/changes/version={v}" for v in changes])
        )
        newest = logged.groupBy(*self.keys).agg(F.max_by(F.struct(*names), "version").alias("_row")).select("_row.*")
        if not bases:
            return newest
        untouched = base.join(bounded(newest.select(*self.keys)), list(self.keys), "left_anti")
        return untouched.select(names).unionByName(newest)

    def lookup(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose keys occur in ``wanted``."""
        return restrict(self.read(version), wanted, self.keys)

    def compact(self, version: int) -> None:
        """Fold all changes up to ``version`` into a new base."""
        self.write_base(self.read(version), version)

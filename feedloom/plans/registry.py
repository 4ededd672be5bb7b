"""Name, plan and checking SQL of every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import configure

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` computes the same rows by other means."""

    def register(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


# A Parquet file below this size is one row group as a rule, which one task reads alone.
ROW_GROUP_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table; ``spread`` lets the rows of a file too small to be split use all cores.

    Use it in front of costly row expressions. Larger files are split by the scan and never shuffled for this.
    """
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    if spread:
        jvm = spark.sparkContext._jvm
        file = jvm.org.apache.hadoop.fs.Path(path)
        fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getContentSummary(file).getLength() < ROW_GROUP_BYTES:
            return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows


def stamp(col: str | Column) -> Column:
    """Timestamp as text with microseconds."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"

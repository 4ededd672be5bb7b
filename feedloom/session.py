"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans rely on. They can be applied to a session somebody else made.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let AQE split a skewed join even where the split costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sessions of a busy key are merged in each task before they meet.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "feedloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's SQL settings; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for name, value in SQL_SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A local-mode session without the setting gets a fresh temporary folder. Anywhere else a missing
    setting is an error: a folder on one machine would be lost with that machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if current is not None:
            return current
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="run-")
    if current is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``df`` as a table below ``root`` (default: the shared folder) and go on from the stored rows.

    Later stages then neither recompute the plan above nor depend on the executors that ran it. The table is columnar,
    so a stage that needs two columns of a wide frame reads two columns, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table") if root is None else f"{root}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of one piece of work, removed when the work is done."""
    root = scratch_path(spark, "work")
    try:
        yield root
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Session helpers: building a session, shared working folders, cutting lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tillframe", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session.

    ``conf`` takes Spark settings with dots written as double underscores,
    e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that functions in tasks find it from any folder."""
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    context = spark.sparkContext
    if any(os.path.basename(f) == f"{name}.zip" for f in context.listFiles):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix=f'{name}-')}/{name}", "zip", os.path.dirname(package), name)
    context.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Only a local session without either gets a temporary folder, which it then
    remembers; on a cluster that would be another folder on each machine, so
    it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_folder(spark)
    folder = folder or spark.conf.get("tillframe.work.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tillframe-")
        spark.conf.set("tillframe.work.dir", folder)
    return folder.rstrip("/")


def _checkpoint_folder(spark: SparkSession) -> str | None:
    return spark.sparkContext.getCheckpointDir()


_working: ContextVar[list[str] | None] = ContextVar("working", default=None)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, which goes at the end of ``working_tables`` if called within."""
    path = f"{shared_folder(spark)}/tillframe/{label}-{uuid.uuid4().hex}"
    noted = _working.get()
    if noted is not None:
        noted.append(path)
    return path


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, the tables that were written to fresh paths within it by this thread.

    For steps whose results are written elsewhere before the block ends: a frame that reads one of the tables is of no
    use afterwards.
    """
    token = _working.set([])
    try:
        yield
    finally:
        noted = _working.get()
        _working.reset(token)
        for path in noted:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
            if fs.exists(place):
                fs.delete(place, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative trainers checkpoint their state; give them a folder if the session has none."""
    if not _checkpoint_folder(spark):
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")


def materialize(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with the writer's ``options``, and read it back.

    For frames that are read many times: the joins behind them run once, and a
    lost executor costs a re-read instead of a recompute.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.mode("error").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan_bytes(*scans: DataFrame) -> int:
    """Stored size of plain table scans, as Spark's statistics state it."""
    return sum(int(str(s._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for s in scans)

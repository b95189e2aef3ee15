"""Session helpers.  Nothing here overrides what the cluster already set."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def build_session(app: str = "spanloom", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session for local work and tests; on a cluster use the session spark-submit gives."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPANLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only where the cluster names none (local runs, tests) a fresh temporary folder is used,
    and that is refused on a real cluster because a machine-local folder is lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spanloom-")
    return _LOCAL[app]


_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written yet, inside the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/spanloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside are removed at the end, so that a job that runs for ever does not pile them up."""
    token = _SCRATCH.set(made := [])
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df, name: str):
    """Cut lineage through a table in the shared folder and read it back.

    Used where several jobs share an expensive intermediate; survives the loss of executors.  Columns that repeat each other's
    texts take much less room by this codec than by the default one.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)

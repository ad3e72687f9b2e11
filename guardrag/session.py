"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "guardrag") -> SparkSession:
    """Local/test session. On a cluster, use the session the platform provides."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("GUARDRAG_MASTER", "local[*]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("GUARDRAG_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``guardrag`` importable in the Python workers (``addPyFile`` of a zip of
    the package), once per application. Pandas/Arrow functions are pickled by
    reference to this package, so workers must be able to import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="guardrag-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is only filled in here when unset
    on a local master (local runs and tests), with a fresh scratch folder. On a
    cluster an unset value is an error rather than a machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster "
                               f"(master={master!r}); a machine-local scratch folder would not survive executor loss")
        configured = tempfile.mkdtemp(prefix="guardrag-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for a written intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """What a run creates for itself: written intermediate tables and broadcasts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.broadcasts = spark, [], []

    def release(self) -> None:
        """Delete the tables and destroy the broadcasts; nothing may read them any more."""
        for broadcast in self.broadcasts:
            broadcast.destroy()
        for path in self.paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.paths, self.broadcasts = [], []


_scratch: ContextVar[Scratch | None] = ContextVar("guardrag_scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Release at the end what ``materialize`` writes and ``track`` is given inside.

    For runs that write their results before the scope ends, such as a streaming micro-batch.
    """
    scratch = Scratch(spark)
    token = _scratch.set(scratch)
    try:
        yield scratch
    finally:
        _scratch.reset(token)
        scratch.release()


def track(broadcast):
    """Leave a broadcast to the enclosing scratch scope, if there is one."""
    if (scratch := _scratch.get()) is not None:
        scratch.broadcasts.append(broadcast)
    return broadcast


def write_scratch(df, name: str) -> str:
    """Write ``df`` as a parquet table in the shared checkpoint folder and return its path; an enclosing scratch scope deletes it."""
    path = scratch_path(df.sparkSession, name)
    if (scratch := _scratch.get()) is not None:
        scratch.paths.append(path)
    df.write.mode("errorifexists").parquet(path)
    return path


def materialize(df, name: str):
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads the table instead of recomputing the
    plan) and is columnar, unlike ``DataFrame.checkpoint``'s row serialisation.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name))

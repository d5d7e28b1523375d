"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Kept in one place so that tests, bench and users start alike.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "citeloom", **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` entries (dots written as `__`) win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a session on a `local` master may fall back to a folder of this machine; a cluster
    without the setting gets an error, because its executors share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="citeloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    local = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet under the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no recomputation of what came before, and
    several consumers share one computation. The files go at the end of the innermost `tables_removed`
    block around the call, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/citeloom-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    discard(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Have a path removed when its time comes, as `materialize` does."""
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)


_scopes: list[list[str]] = []


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what operators wrote inside; results have to be written or collected before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass

"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, name: str = "repaylens", **conf: str) -> SparkSession:
    """A local session. On a cluster, use the session that spark-submit provides."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without: it gets one folder of its own. On a cluster a
    missing setting is an error, because executors cannot see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or "") is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _own_folder(spark.conf.get("spark.app.id", None) or "session")


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@contextmanager
def spent_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files when they end.

    For queries whose result is stored: nothing reads their shuffles again, and without
    this the files stay until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store its path names; none is no error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

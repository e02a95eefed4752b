"""Tables written between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The application's own folders, deleted when the driver ends.
_MADE: dict[str, str] = {}
#: The folders handed out inside scratch(), innermost last.
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder within what driver and executors share (spark.checkpoint.dir).

    On one machine, where none is set, one below the system's temporary folder is made; the setting itself is left alone.
    """
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    name = f"{base.rstrip('/')}/{context.applicationId}" if base else context.applicationId
    if name not in _MADE:
        _MADE[name] = name if base else "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(deleted, spark, _MADE[name])
    return _MADE[name]


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there and Spark still runs."""
    with contextlib.suppress(Exception):  # nothing is left to remove it with once the JVM has gone
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH[-1:]:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders handed out inside are deleted at its end: nothing made inside may be read later, unless its path was named before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            deleted(spark, path)


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query inside shuffled is removed as soon as the query ends, so that steps in rounds need the disk of one."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

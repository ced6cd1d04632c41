"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: dict[tuple[str, str], str] = {}
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Where that is unset and Spark runs in one
    process, as in tests, a temporary folder is made and used; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under a folder that goes when this process ends."""
    key = (shared_dir(spark), spark.sparkContext.applicationId)
    if key not in _roots:
        _roots[key] = f"{key[0]}/skein/{uuid.uuid4().hex}"
        atexit.register(_ended, spark, _roots[key])
    return f"{_roots[key]}/{uuid.uuid4().hex}/{name}"


def _ended(spark: SparkSession, root: str) -> None:
    """Delete what is left of this process' tables, if its JVM still runs."""
    with suppress(Exception):  # the JVM, or the store, may be gone already
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again.

    This cuts the lineage with files that outlive the executors which made them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._skein_path = path
    for made in _scopes[-1:]:
        made.append(stored)
    return stored


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete, at the end, the tables that are stored meanwhile, but for those put on the list given.

    What is still lazy then must read kept tables only. In a scope within another the kept
    tables are the outer one's to delete.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.pop()
        for table in made:
            if not any(table is k for k in kept):
                forget(table)
        for outer in _scopes[-1:]:
            outer.extend(kept)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read again."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._skein_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

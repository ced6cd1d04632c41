"""Folders whose data counts only once a manifest of it is written."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "MANIFEST.json"


def _at(spark: SparkSession, path: str):
    """A path of the file system that Spark finds it in, and that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)


def _written(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there, so that it's whole or absent."""
    at, system = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(at):
        system.delete(at, False)
    if not system.rename(beside, at):
        raise OSError(f"{path} can't be written")


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _files(rows: DataFrame) -> DataFrame:
    """file, rows and digest of what was written, by file: the number of rows and sums of two hashes of them, in any order."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    row = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    told = rows.select(name.alias("__file"), *rows.columns).groupBy(F.col("__file").alias("file"))
    return told.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("/", *sums).alias("digest"))


def commit(rows: DataFrame, path: str, *, form: str = "parquet", facts: dict | None = None) -> dict:
    """Write rows into a new folder under the path, then a manifest that points to it.

    Tasks write their files and, reading them again, their counts and digests; those are a table
    beside the data. The manifest, with the totals, comes last and replaces any earlier one as a
    whole. Until then readers see what was committed before, or nothing.

    Args:
        form: a format of Spark's, as parquet or json.
        facts: what the manifest tells besides.

    Returns:
        the manifest.
    """
    spark, own = rows.sparkSession, uuid.uuid4().hex
    before = manifest(spark, path)["data"] if exists(spark, f"{path}/{MANIFEST}") else None
    rows.write.format(form).option("ignoreNullFields", "false").save(f"{path}/data-{own}")
    written = spark.read.schema(rows.schema).format(form).load(f"{path}/data-{own}")
    _files(written).write.parquet(f"{path}/files-{own}")
    files = spark.read.parquet(f"{path}/files-{own}")
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    told = {"data": own, "facts": facts or {}, "files": n, "form": form, "rows": total, "schema": json.loads(rows.schema.json())}
    _written(spark, f"{path}/{MANIFEST}", json.dumps(told, indent=2, sort_keys=True) + "\n")
    if before:
        delete(spark, f"{path}/data-{before}"), delete(spark, f"{path}/files-{before}")
    return told


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a folder; without one the folder isn't whole, which is an error."""
    if not exists(spark, f"{path}/{MANIFEST}"):
        raise ValueError(f"{path} has no manifest: nothing is committed there")
    return json.loads(_read(spark, f"{path}/{MANIFEST}"))


def torn(spark: SparkSession, path: str) -> DataFrame:
    """Files of a committed folder that are missing, unrecorded or differ from the record: file, problem."""
    told = manifest(spark, path)
    kind = T.StructType.fromJson(told["schema"])
    actual = _files(spark.read.schema(kind).format(told["form"]).load(f"{path}/data-{told['data']}")).alias("b")
    met = spark.read.parquet(f"{path}/files-{told['data']}").alias("a").join(actual, F.col("a.file") == F.col("b.file"), "full")
    problem = (
        F.when(F.col("b.file").isNull(), "missing").when(F.col("a.file").isNull(), "unrecorded")
        .when(F.col("a.rows") != F.col("b.rows"), "count").when(F.col("a.digest") != F.col("b.digest"), "digest")
    )
    return met.select(F.coalesce("a.file", "b.file").alias("file"), problem.alias("problem")).filter("problem is not null")


def read(spark: SparkSession, path: str, *, verify: bool = True) -> DataFrame:
    """What was committed last; verified, a file that differs from its record is an error that names it."""
    told = manifest(spark, path)
    if verify and (bad := torn(spark, path).limit(5).collect()):
        raise ValueError(f"{path} isn't what was committed: " + ", ".join(f"{r['file']} ({r['problem']})" for r in bad))
    return spark.read.schema(T.StructType.fromJson(told["schema"])).format(told["form"]).load(f"{path}/data-{told['data']}")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a log of Parquet files. Each task's file is there once the task is done, whatever becomes of the rest."""
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def logged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a log, that of a job that didn't end included; none if nothing was logged."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)

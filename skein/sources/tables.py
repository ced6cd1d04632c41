"""Table readers: every scan goes through Spark, so any store that Spark can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table of a data folder.

    Raises:
        KeyError: if the name is not one of the known tables.
    """
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

"""Parquet tables of a code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE_TABLES = ("codebases", "codebase_meta", "source_files", "indexed_files", "chunks", "symbols", "edges", "metric_index_runs")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def delivered_once(df: DataFrame, *key: str) -> DataFrame:
    """One row per `key` of a table whose rows may be delivered twice (whole rows, id included).

    Rows with a NULL in the key are kept once per distinct key, as `dropDuplicates` treats NULLs alike.
    """
    return df.dropDuplicates(list(key))


def extension(path: str = "file_path"):
    """Lower-case extension with its dot, '' where there is none."""
    return F.regexp_extract(F.lower(F.col(path)), r"(\.[^./]*)$", 1)

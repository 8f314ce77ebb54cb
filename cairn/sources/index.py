"""The logical tables of a code index: rows once, current files, derived workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.sources.tables import delivered_once, table


class Index:
    """Lazy access to one index folder; every property is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def once(self, name: str, *columns: str) -> DataFrame:
        """The rows of `name`, each id once, with `columns` only (and the id)."""
        df = self.raw(name)
        return delivered_once(df.select("id", *columns) if columns else df, "id")

    def current(self, name: str, *columns: str) -> DataFrame:
        """The newest row per codebase and file of a manifest, as the store would hold it."""
        newest = Window.partitionBy("codebase_id", "file_path").orderBy(F.desc_nulls_last("indexed_at"), F.desc("id"))
        df = self.raw(name).select("id", "codebase_id", "file_path", "indexed_at", *columns)
        return df.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")

    @property
    def codebases(self) -> DataFrame:
        return self.raw("codebases")

    @property
    def members(self) -> DataFrame:
        """(workspace, codebase_id): a codebase belongs to the workspace that its root path's third part names."""
        return self.codebases.select(F.element_at(F.split("root_path", "/"), 4).alias("workspace"), F.col("id").alias("codebase_id")).filter("workspace is not null and workspace <> ''")

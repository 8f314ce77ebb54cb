"""Whole files out of the chunks they were cut into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import extension

#: Extension -> language, for the languages whose files are read whole.
LANGUAGES = {".go": "go", ".py": "python", ".ts": "typescript", ".js": "javascript", ".rs": "rust"}


def known_code(source_files: DataFrame) -> DataFrame:
    """(codebase_id, file_path) of the code files of source_files, once each; superseded rows count as well."""
    return source_files.filter(extension().isin(*LANGUAGES)).select("codebase_id", "file_path").dropna().distinct()


def whole_files(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(codebase_id, file_path, ext, text): the text of each `known` file, its chunks once each in line order.

    Chunks delivered twice count once; of chunks that overlap, the first by (start_line, end_line, snippet)
    is taken. Wholly blank windows, which aren't stored, come back as blank lines. A group is one file, never
    more, so no hot codebase gathers in one task.
    """
    part = F.struct(F.coalesce("start_line", F.lit(1)).alias("first"), F.coalesce("end_line", "start_line", F.lit(1)).alias("last"), F.coalesce("snippet", F.lit("")).alias("text"))
    rows = chunks.filter(extension().isin(*LANGUAGES)).select("codebase_id", "file_path", part.alias("part")).join(known, ["codebase_id", "file_path"], "left_semi")
    parts = rows.groupBy("codebase_id", "file_path").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    before = lambda i: F.when(i > 0, F.get(F.col("parts"), i - 1)["last"]).otherwise(0)
    once = parts.withColumn("parts", F.filter("parts", lambda p, i: (i == 0) | (p["first"] > before(i))))
    pieces = F.transform("parts", lambda p, i: F.concat(F.repeat(F.lit("\n"), F.greatest(F.lit(0), p["first"] - 1 - before(i)).cast("int")), p["text"]))
    return once.select("codebase_id", "file_path", extension().alias("ext"), F.array_join(pieces, "\n").alias("text"))

"""Source files that do not parse, per file and as rates (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.files import LANGUAGES, known_code, whole_files


_ERROR = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("nature", T.StringType())])


@F.pandas_udf(_ERROR)
def _first_error(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    from cairn.llm.syntax import checker_of

    for exts, texts in batches:
        found = [checker_of(ext[1:]).first_error(text.replace("\r\n", "\n")) for ext, text in zip(exts, texts, strict=True)]
        yield pd.DataFrame(found, columns=["line", "nature"]).astype({"line": "int32"})


def parsed_files(chunks: DataFrame, source_files: DataFrame) -> DataFrame:
    """(codebase_id, file_path, language, error_line, error): one row per known code file with chunks.

    error_line is NULL for a file that is valid for its extension's language; else the line of the first
    error that no parse of the whole file recovers from, and `error` says of what nature it is: token (no
    token of the language, as an open string), bracket (closed by another), unclosed, content (of a bracket)
    or statement. The language is that of the extension, whatever the tables say. A file without text is
    valid but in Go, whose grammar wants a package. Files known to source_files without chunks give no row.
    """
    files = whole_files(chunks, known_code(source_files))
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    checked = files.select("codebase_id", "file_path", names[F.col("ext")].alias("language"), _first_error("ext", "text").alias("e"))
    wrong = F.col("e.line") > 0
    return checked.select("codebase_id", "file_path", "language", F.when(wrong, F.col("e.line")).alias("error_line"), F.when(wrong, F.col("e.nature")).alias("error"))


def broken_files(chunks: DataFrame, source_files: DataFrame) -> DataFrame:
    """(codebase_id, file_path) of the known files whose text isn't valid for their extension."""
    return parsed_files(chunks, source_files).filter("error_line is not null").select("codebase_id", "file_path")


def broken_rates(chunks: DataFrame, source_files: DataFrame) -> DataFrame:
    """Files, broken files and their share per codebase and language."""
    return (
        parsed_files(chunks, source_files)
        .groupBy("codebase_id", "language")
        .agg(F.count("*").alias("files"), F.count("error_line").alias("broken"))
        .withColumn("broken_share", F.round(F.col("broken") / F.col("files"), 6))
    )

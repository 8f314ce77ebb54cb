"""Generated, minified, vendored and data files among source files (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.files import known_code, whole_files
from cairn.session import cut_lineage

FIELDS = T.StructType(
    [
        T.StructField("codebase_id", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("lines", T.IntegerType()),  # with code on them
        T.StructField("canonical", T.IntegerType()),  # lines of the canonical re-emission
        T.StructField("kept", T.IntegerType()),  # of these, lines that the file has as well
        T.StructField("indented", T.IntegerType()),  # of these, with the same indent
        T.StructField("chars", T.IntegerType()),  # of tokens, comments left out
        T.StructField("literal_chars", T.IntegerType()),
        T.StructField("units", T.IntegerType()),  # top-level units of 8 tokens or more
        T.StructField("same_shape", T.IntegerType()),  # of these, with the commonest row of token kinds
        T.StructField("machine", T.BooleanType()),  # its head says that a tool wrote it
        T.StructField("holder", T.StringType()),  # whom its head names beside a licence
        T.StructField("prints", T.ArrayType(T.LongType())),  # of its larger units, token by token
    ]
)
#: Canonical lines per line from which a file is minified, and characters per line it must have.
EXPANSION, WIDTH = 4.0, 100
#: Share of canonical lines that a minified file may have kept.
KEPT_SHARE = 0.5
#: Share of literals from which a file is data, and characters it must have.
DATA_SHARE, DATA_CHARS = 0.78, 200
#: Share of equal shapes from which a layout is a machine's, and units it must have.
UNIFORM_SHARE, UNIFORM_UNITS = 0.8, 5
#: Share of a file's prints that must lie in files headed as a library's elsewhere.
COPIED_SHARE, COPIED_PRINTS = 0.5, 2
#: Parts into which a print that many files hold is divided for the join.
SALT = 8


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from cairn.llm.layout import measured

    for batch in batches:
        rows = [measured(text.replace("\r", ""), ext) for text, ext in zip(batch["text"], batch["ext"], strict=True)]
        yield pd.concat([batch[["codebase_id", "file_path"]].reset_index(drop=True), pd.DataFrame(rows, columns=FIELDS.names[2:])], axis=1)


def figures(chunks: DataFrame, source_files: DataFrame) -> DataFrame:
    """FIELDS of each known code file with chunks."""
    return whole_files(chunks, known_code(source_files)).mapInPandas(_measure, FIELDS)


def judged_files(chunks: DataFrame, source_files: DataFrame, codebases: DataFrame) -> DataFrame:
    """(codebase_id, file_path, minified, data, generated, vendored), one row per known code file with chunks.

    minified: the canonical formatting needs many times the file's lines. data: literals make up nearly all of
    it. generated: its head says so, or its units are all of one shape. vendored: its head names a holder that
    isn't its codebase beside a licence, or half its units are, token by token, in such files of other
    codebases (so copies that were stripped of their head or patched count as well). Paths decide nothing.
    A library's prints are one row each; those of other files are salted by their path and meet one of SALT copies
    of that row, so a library copied everywhere is no hot key. Where a file has one print only, that one suffices.
    """
    found = cut_lineage(figures(chunks, source_files))
    names = codebases.select(F.col("id").alias("codebase_id"), F.lower("name").alias("own")).dropDuplicates(["codebase_id"])
    held = found.join(names, "codebase_id", "left").withColumn(
        "headed", F.col("holder").isNotNull() & ~F.coalesce((F.col("own") == F.col("holder")) | (F.substring_index("own", "-", 1) == F.col("holder")), F.lit(False))
    )
    library = held.filter("headed").select(F.explode("prints").alias("print"), F.col("codebase_id").alias("at")).groupBy("print").agg(F.min("at").alias("lowest"), F.max("at").alias("highest"))
    library = library.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    copied = (
        held.filter(~F.col("headed"))
        .select("codebase_id", "file_path", F.size("prints").alias("all_prints"), F.pmod(F.xxhash64("file_path"), F.lit(SALT)).cast("int").alias("salt"), F.explode("prints").alias("print"))
        .join(library, ["print", "salt"])
        .filter("lowest <> codebase_id or highest <> codebase_id")
        .groupBy("codebase_id", "file_path")
        .agg(F.count("*").alias("shared"), F.first("all_prints").alias("all_prints"))
        .filter((F.col("shared") >= F.least(F.lit(COPIED_PRINTS), "all_prints")) & (F.col("shared") >= COPIED_SHARE * F.col("all_prints")))
        .select("codebase_id", "file_path", F.lit(True).alias("copied"))
    )
    data = (F.col("literal_chars") >= DATA_SHARE * F.col("chars")) & (F.col("chars") >= DATA_CHARS)
    return held.join(copied, ["codebase_id", "file_path"], "left").select(
        "codebase_id",
        "file_path",
        ((F.col("canonical") >= EXPANSION * F.col("lines")) & (F.col("chars") >= WIDTH * F.col("lines")) & (F.col("lines") > 0) & (F.col("kept") <= KEPT_SHARE * F.col("canonical")) & ~data).alias("minified"),
        data.alias("data"),
        (F.col("machine") | ((F.col("units") >= UNIFORM_UNITS) & (F.col("same_shape") >= UNIFORM_SHARE * F.col("units")))).alias("generated"),
        (F.col("headed") | F.coalesce("copied", F.lit(False))).alias("vendored"),
    )


def not_hand_written(chunks: DataFrame, source_files: DataFrame, codebases: DataFrame) -> DataFrame:
    """(codebase_id, file_path) of the files that weren't written by hand in their codebase."""
    return judged_files(chunks, source_files, codebases).filter("minified or data or generated or vendored").select("codebase_id", "file_path")


def hand_written(chunks: DataFrame, source_files: DataFrame, codebases: DataFrame) -> DataFrame:
    """(codebase_id, file_path) of what is left."""
    return judged_files(chunks, source_files, codebases).filter("not (minified or data or generated or vendored)").select("codebase_id", "file_path")

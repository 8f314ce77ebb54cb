"""Sentences of every document, with their offsets (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OFFSETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from cairn.llm.boundaries import sentences

    for batch in batches:
        found = [sentences(t) for t in batch["text"]]
        flat = np.array([pair for pairs in found for pair in pairs], dtype=np.int32).reshape(-1, 2)
        yield pd.DataFrame({"doc_id": np.repeat(batch["doc_id"].to_numpy(), [len(f) for f in found]), "start_char": flat[:, 0], "end_char": flat[:, 1]})


def document_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence, in code points from 0, end exclusive.

    Whole texts in any of their languages, without a shuffle. NULL and blank texts give no row; documents
    with a NULL doc_id give none either, as their rows couldn't be told apart; a repeated row is split again.
    """
    return documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInPandas(_split, _OFFSETS)


def sentence_counts(documents: DataFrame) -> DataFrame:
    """Sentences and their code points per document, 0 where a document has none."""
    found = document_sentences(documents).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))
    ids = documents.select("doc_id").dropna().distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("sentences"), F.coalesce("chars", F.lit(0)).alias("sentence_chars"))

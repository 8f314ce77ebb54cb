"""Queries of this subpackage and their SQL, as far as SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import authorship, broken, contamination, credentials, mixture, pairs, sentences
from cairn.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(function: Callable[..., DataFrame], *tables: str, **options: object) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return function(*(table(spark, folder, t) for t in tables), **options)

    return query


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(broken.broken_files, "chunks", "source_files"),
        "p1_files": _on(broken.parsed_files, "chunks", "source_files"),
        "p1_rates": _on(broken.broken_rates, "chunks", "source_files"),
        "p2_found": _on(authorship.not_hand_written, "chunks", "source_files", "codebases"),
        "p2_files": _on(authorship.judged_files, "chunks", "source_files", "codebases"),
        "p2_hand_written": _on(authorship.hand_written, "chunks", "source_files", "codebases"),
        "p3_found": lambda s, d: _on(pairs.described, "symbols")(s, d).select("symbol_id"),
        "p3_pairs": _on(pairs.pairs, "symbols"),
        "p4_found": lambda s, d: _on(credentials.credentials, "chunks", "symbols")(s, d).select("source_table", "row_id", "line_no").distinct(),
        "p4_credentials": _on(credentials.credentials, "chunks", "symbols"),
        "p4_redacted": _on(credentials.redacted_texts, "chunks", "symbols"),
        "p7_found": _on(contamination.leaked_items, "documents", "eval_items"),
        "p7_report": _on(contamination.leak_report, "documents", "eval_items"),
        "p8_mix": _on(mixture.mixed_documents, "documents", "mix_targets"),
        "p8_shares": _on(mixture.mixture_shares, "documents", "mix_targets"),
        "p8_filled": _on(mixture.mixture_shares, "documents", "mix_targets", total="all"),
        "p9_found": _on(sentences.document_sentences, "documents"),
        "p9_counts": _on(sentences.sentence_counts, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {}

"""Registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import graph, ingest, lookups, manifest, metrics, references, search, wide
from cairn.plans import oracles
from cairn.sources.index import Index
from cairn.sources.tables import table
from cairn.streaming import debounce

Query = Callable[[SparkSession, str], DataFrame]


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return references.index_orphans(*(table(spark, folder, t) for t in ("edges", "metric_index_runs", "codebases", "symbols", "source_files")))


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    return wide.wide_table(table(spark, folder, "codebase_meta"), table(spark, folder, "meta_attributes"))


def _on(function: Callable[..., DataFrame], **options: object) -> Query:
    return lambda spark, folder: function(Index(spark, folder), **options)


def _texts(ix: Index) -> DataFrame:
    return ix.raw("documents").select("doc_id", "text").filter("text is not null")


def _searched(query: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        hits = search.lexical(Index(spark, folder), query)
        return hits.select("id", "codebase_id", "file_path", F.round("bm25", 6).alias("bm25_score"))

    return run


def queries() -> dict[str, Query]:
    found = {
        "p5_found": lambda s, d: _orphans(s, d).select("source_table", "row_id").distinct(),
        "p5_orphans": _orphans,
        "p5_report": lambda s, d: references.orphan_report(_orphans(s, d)),
        "p6_found": lambda s, d: wide.filled_cells(_wide(s, d)),
        "p6_wide": _wide,
        "line_chunks": lambda s, d: ingest.line_chunks(_texts(Index(s, d)), "doc_id").select("doc_id", "start_line", "end_line", F.md5("snippet").alias("md5")),
        "markdown_sections": lambda s, d: ingest.markdown_sections(_texts(Index(s, d)), "doc_id").select("doc_id", "section", "start_line", "end_line", F.md5("snippet").alias("md5")),
        "prose_chunks": lambda s, d: ingest.prose_chunks(_texts(Index(s, d))),
        "path_rules": lambda s, d: ingest.path_rules(Index(s, d).raw("chunks").select("codebase_id", "file_path").distinct()),
        "debounce_sessions": lambda s, d: debounce.sessions(Index(s, d).raw("events")).withColumn("last_at", F.unix_micros("last_at")),
    }
    found |= {f"search_{name}": _searched(query) for name, query in oracles.SEARCHES.items()}
    found["search_compacted"] = _on(search.search, query=oracles.SEARCHES["and"])
    found["search_annotated"] = _on(search.annotated_hits, query=oracles.SEARCHES["single"])
    found["search_memory"] = _on(search.memory_scan, query="Ctx Context.Context")
    found["locate_sentence"] = _on(search.locate_issue, query=oracles.SENTENCE)
    found["package_outline_prefix"] = _on(lookups.package_outline, prefix="pkg/")
    found["degraded_hits"] = _on(search.degraded_hits, query=oracles.SEARCHES["single"])
    for module, names in {
        lookups: (
            "list_codebases codebase_by_id chunk_listing source_file_listing compacted_symbols annotated_file_symbols capability_gaps workspace_members workspaces symbols_by_kind top_files exported_functions file_symbols symbols_of_kind list_capabilities find_symbol find_symbol_of_kind"
            " find_symbol_fuzzy find_symbol_or_fuzzy find_symbol_workspace find_symbol_fuzzy_workspace file_stats language_breakdown package_list index_status package_outline project_overview compare_capabilities capability_summary"
        ),
        graph: "callers usages usage_edges callees imports dependents unresolved_imports callers_workspace usages_workspace blast_radius blast_entries cross_links cross_repo_resolution",
        search: "locate_issue issue_impact term_statistics",
        manifest: "manifest_delta delta_summary run_counters orphan_chunks upserted_files edges_after_removal policies redacted_symbols stripped_export_sizes",
        metrics: "tool_stats tool_stats_window slow_log recent_errors index_run_stats parse_health zero_symbol_files index_throughput graph_density server_stats",
        ingest: "orientation_documents assembled_files conflicted_files languages codebase_context",
    }.items():
        found |= {name: _on(getattr(module, name)) for name in names.split()}
    found["embeds"] = _on(graph.callers, kind="embeds")
    return found


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

"""Telemetry: tool calls, index runs, parse health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.lookups import top_per
from cairn.sources.index import Index

RING, SLOW_MS, SLOW_TOP, ERROR_RING = 1000, 500, 20, 120


def tool_calls(ix: Index) -> DataFrame:
    """Events as calls of tools: (id, tool, recorded_at in ms, duration_ms, is_error)."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return ix.raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), at.alias("recorded_at"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), (F.col("event_type") == "error").alias("is_error"))


def tool_stats(ix: Index) -> DataFrame:
    """Calls, mean, errors and p95 (the call at place max(floor(0.95 n), 1)) of each tool over all its history.

    The place is found by counts per duration, so no tool's calls are ordered in one task.
    """
    by = tool_calls(ix).groupBy("tool", "duration_ms").agg(F.count("*").alias("n"), F.count_if("is_error").alias("e"))
    w = Window.partitionBy("tool").orderBy("duration_ms")
    placed = by.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("n").over(Window.partitionBy("tool")))
    p95 = F.min(F.when(F.col("upto") >= F.greatest(F.floor(F.col("all") * 95 / 100), F.lit(1)), F.col("duration_ms")))
    return placed.groupBy("tool").agg(F.sum("n").alias("calls"), F.floor(F.sum(F.col("n") * F.col("duration_ms")) / F.sum("n")).alias("avg_ms"), F.sum("e").alias("errors"), p95.alias("p95_ms"))


def tool_stats_window(ix: Index) -> DataFrame:
    """p95 of each tool's last thousand calls, the call at place ceil(0.95 n)."""
    last = top_per(tool_calls(ix), "tool", [F.desc("recorded_at"), F.desc("id")], RING)
    ranked = last.withColumn("rank", F.row_number().over(Window.partitionBy("tool").orderBy("duration_ms", "id"))).withColumn("n", F.count("*").over(Window.partitionBy("tool")))
    return ranked.filter(F.col("rank") == F.floor((95 * F.col("n") + 99) / 100)).select("tool", F.col("n").alias("calls"), F.col("duration_ms").alias("p95_ms"))


def slow_log(ix: Index) -> DataFrame:
    """The last slow calls."""
    return tool_calls(ix).filter(F.col("duration_ms") >= SLOW_MS).orderBy(F.desc("recorded_at"), F.desc("id")).limit(SLOW_TOP)


def recent_errors(ix: Index) -> DataFrame:
    """How many of the last errors fall in the last minute of the log."""
    calls = tool_calls(ix)
    now = calls.agg(F.max("recorded_at").alias("now"))
    errors = calls.filter("is_error").orderBy(F.desc("recorded_at"), F.desc("id")).limit(ERROR_RING)
    return errors.crossJoin(F.broadcast(now)).agg(F.count_if(F.col("recorded_at") >= F.col("now") - 60_000).alias("errors_last_minute"))  # one row


def index_run_stats(ix: Index) -> DataFrame:
    """Runs of each codebase (NULL is a group of its own) and their totals."""
    runs = ix.once("metric_index_runs", "codebase_id", "files_indexed", "chunks_indexed", "duration_ms")
    return runs.groupBy("codebase_id").agg(
        F.count("*").alias("runs"),
        F.sum("files_indexed").alias("files"),
        F.sum("chunks_indexed").alias("chunks"),
        F.coalesce(F.floor(F.sum("duration_ms") / F.count("duration_ms")), F.lit(0)).alias("avg_ms"),
    )


def parse_health(ix: Index) -> DataFrame:
    """Files of each codebase by status, and the share that isn't complete."""
    files = ix.current("indexed_files", "index_status", "status_reason")
    status = F.coalesce("index_status", F.lit(""))
    return files.groupBy("codebase_id").agg(
        F.count("*").alias("files"),
        F.count_if(status == "complete").alias("complete"),
        F.count_if(status == "text_fallback").alias("text_fallbacks"),
        F.count_if(status == "partial").alias("partial"),
        F.count_if(F.col("status_reason").contains("panic")).alias("panics"),
        F.round(F.count_if(status != "complete") / F.count("*"), 6).alias("degraded_share"),
    )


def zero_symbol_files(ix: Index) -> DataFrame:
    """Files of each codebase, and those in which no symbol was found."""
    files = ix.current("source_files", "symbol_count")
    return files.groupBy("codebase_id").agg(F.count("*").alias("files"), F.count_if(F.coalesce("symbol_count", F.lit(0)) == 0).alias("zero_symbols"))


def index_throughput(ix: Index) -> DataFrame:
    """Files and chunks per second over all runs of each codebase, 0 where no time is known."""
    runs = ix.once("metric_index_runs", "codebase_id", "files_indexed", "chunks_indexed", "duration_ms")
    by = runs.groupBy("codebase_id").agg(F.sum("files_indexed").alias("f"), F.sum("chunks_indexed").alias("c"), F.sum("duration_ms").alias("ms"))
    rate = lambda n: F.when(F.col("ms") > 0, F.round(F.coalesce(n, F.lit(0)) * 1000 / F.col("ms"), 6)).otherwise(0.0)
    return by.select("codebase_id", rate("f").alias("files_per_second"), rate("c").alias("chunks_per_second"))


def server_stats(ix: Index) -> DataFrame:
    """The server's figures as (section, name, value) rows: requests, tools, errors, parsing, runs, graph, codebases."""
    tools = tool_stats(ix).join(tool_stats_window(ix).select("tool", F.col("p95_ms").alias("p95")), "tool")
    parse = ix.current("indexed_files", "index_status", "status_reason").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("index_status") == "complete").alias("complete"), F.count_if(F.col("index_status").isin("text_fallback", "partial")).alias("degraded")
    )
    runs = ix.once("metric_index_runs", "files_indexed", "chunks_indexed", "duration_ms").agg(
        F.count("*").alias("run_count"), F.sum("files_indexed").alias("files_indexed"), F.sum("chunks_indexed").alias("chunks_indexed"), F.coalesce(F.floor(F.sum("duration_ms") / F.count("*")), F.lit(0)).alias("avg_duration_ms")
    )
    symbols = ix.once("symbols").agg(F.count("*").alias("total_symbols"))
    edges = ix.once("edges").agg(F.count("*").alias("total_edges"))
    codebases = ix.codebases.agg(F.count("*").alias("active_codebases"))
    requests = tools.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("total_requests"))

    def long(section: str, df: DataFrame, names: list[str], of: str = "") -> DataFrame:
        """One row per figure; those of a tool are named tool.figure."""
        name = lambda n: F.concat_ws(".", F.col(of), F.lit(n)) if of else F.lit(n)
        rows = F.array(*(F.struct(name(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names))
        return df.select(F.lit(section).alias("section"), F.explode(rows).alias("r")).select("section", "r.name", "r.value")

    parts = [
        long("tools", tools, ["calls", "avg_ms", "p95", "errors"], "tool"),
        long("parse", parse, ["total_files", "complete", "degraded"]),
        long("index", runs, ["run_count", "files_indexed", "chunks_indexed", "avg_duration_ms"]),
        long("graph", symbols, ["total_symbols"]),
        long("graph", edges, ["total_edges"]),
        long("server", codebases, ["active_codebases"]),
        long("server", requests, ["total_requests"]),
        long("server", recent_errors(ix), ["errors_last_minute"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_density(ix: Index) -> DataFrame:
    """Edges per symbol of each codebase, 0 without symbols."""
    e = ix.once("edges", "codebase_id").groupBy("codebase_id").agg(F.count("*").alias("edges"))
    s = ix.once("symbols", "codebase_id").groupBy("codebase_id").agg(F.count("*").alias("symbols"))
    joined = e.join(s, "codebase_id", "full_outer").na.fill(0, ["edges", "symbols"])
    return joined.withColumn("density", F.when(F.col("symbols") > 0, F.round(F.col("edges") / F.col("symbols"), 6)).otherwise(0.0))

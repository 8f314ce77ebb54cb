"""Manifests: what changed, what is orphaned, upserts and deletes, export and import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.index import Index


def is_legacy(file_hash: Column) -> Column:
    """A short hexadecimal hash of old; such files count as changed."""
    return file_hash.rlike("^[0-9a-fA-F]{1,63}$")


def delta(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(codebase_id, file_path, state): added, changed, unchanged or removed, by the hashes of both sides.

    One full outer join; a stored hash that is NULL, empty or legacy counts as changed.
    """
    a = current.select("codebase_id", "file_path", F.col("file_hash").alias("now"), F.lit(True).alias("here"))
    b = stored.select("codebase_id", "file_path", F.col("file_hash").alias("then"), F.lit(True).alias("there"))
    state = (
        F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when((F.col("now") == F.col("then")) & ~is_legacy(F.col("then")), "unchanged").otherwise("changed")
    )
    return a.join(b, ["codebase_id", "file_path"], "full_outer").select("codebase_id", "file_path", state.alias("state"))


def manifest_delta(ix: Index) -> DataFrame:
    return delta(ix.current("source_files", "file_hash"), ix.current("indexed_files", "file_hash"))


def delta_summary(ix: Index) -> DataFrame:
    return manifest_delta(ix).groupBy("codebase_id", "state").agg(F.count("*").alias("files"))


def run_summary(states: DataFrame) -> DataFrame:
    """Counters of a run per codebase, from the states of its files."""
    n = lambda *of: F.count_if(F.col("state").isin(*of))
    return states.groupBy("codebase_id").agg(
        F.count("*").alias("total_files"), n("changed", "added").alias("files_indexed"), n("unchanged").alias("files_skipped"), n("changed").alias("files_changed"), n("added").alias("files_added"), n("removed").alias("files_removed")
    )


def run_counters(ix: Index) -> DataFrame:
    """run_summary of a run that brings the manifest up to the source files."""
    return run_summary(manifest_delta(ix))


def orphan_chunks(ix: Index) -> DataFrame:
    """Chunks per codebase whose file hash no manifest row of the codebase has."""
    held = ix.raw("indexed_files").select("codebase_id", "file_hash").distinct()
    return ix.once("chunks", "codebase_id", "file_hash").join(held, ["codebase_id", "file_hash"], "left_anti").groupBy("codebase_id").agg(F.count("*").alias("orphans"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`base` with the rows of `new` in place of those with equal keys; NULL keys never are equal."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upserted_files(ix: Index) -> DataFrame:
    """The manifest as it is once source_files' hashes are written into it."""
    base = ix.current("indexed_files", "file_hash").select("codebase_id", "file_path", "file_hash")
    return upsert(base, ix.current("source_files", "file_hash").select("codebase_id", "file_path", "file_hash"), ["codebase_id", "file_path"])


def keep_edges_of_other_files(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that don't begin in a removed file: from_ref is neither its path nor its path, a colon and more."""
    start = F.substring_index("from_ref", ":", 1)
    gone = removed.select("codebase_id", F.col("file_path").alias("__path")).distinct()
    rows = edges.withColumn("__start", start)
    return rows.join(gone, (rows["codebase_id"] == gone["codebase_id"]) & (rows["__start"] == gone["__path"]), "left_anti").drop("__start")


def edges_after_removal(ix: Index) -> DataFrame:
    """Edges left per codebase when those of removed files are deleted."""
    from cairn.operators.graph import edges

    gone = manifest_delta(ix).filter("state = 'removed'")
    return keep_edges_of_other_files(edges(ix), gone).groupBy("codebase_id", "edge_kind").agg(F.count("*").alias("edges"))


def policies(ix: Index, meta: DataFrame | None = None) -> DataFrame:
    """(codebase_id, closed_source, source_stripped): whether any row of the flag reads as true.

    Codebases without a row of either flag have those of the global `meta` (key, value), where there is one.
    """
    if meta is not None:
        flags = meta.filter(F.col("key").isin("closed_source", "source_stripped")).select("key", "value")
        rows = ix.raw("codebase_meta").select("codebase_id", "key", "value")
        own = rows.filter(F.regexp_replace(F.lower("key"), "[^a-z]", "").isin("closedsource", "sourcestripped")).select("codebase_id").distinct()
        bare = ix.codebases.select(F.col("id").alias("codebase_id")).join(own, "codebase_id", "left_anti")
        rows = rows.unionByName(bare.join(F.broadcast(flags)).select("codebase_id", "key", "value"))  # two rows of flags
        return _flags(rows)
    return _flags(ix.raw("codebase_meta"))


def _flags(rows: DataFrame) -> DataFrame:
    from cairn.operators.wide import normal_key

    key = normal_key(F.col("key"))
    yes = F.lower(F.trim("value")) == "true"
    return rows.groupBy("codebase_id").agg(
        F.coalesce(F.bool_or(yes & (key == "closedsource")), F.lit(False)).alias("closed_source"), F.coalesce(F.bool_or(yes & (key == "sourcestripped")), F.lit(False)).alias("source_stripped")
    )


SECRET_COLUMNS = ("signature", "doc_comment", "body_snippet")


def redacted_symbols(ix: Index) -> DataFrame:
    """Symbols, the text of those in closed or stripped codebases left empty."""
    rows = ix.once("symbols", "codebase_id", "file_path", "name", *SECRET_COLUMNS).join(policies(ix), "codebase_id", "left")
    hidden = F.coalesce(F.col("closed_source") | F.col("source_stripped"), F.lit(False))
    return rows.select("id", "codebase_id", "name", hidden.alias("redacted"), *(F.when(hidden, F.lit("")).otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in SECRET_COLUMNS))


EXPORTED = ("codebases", "codebase_meta", "chunks", "symbols", "source_files", "indexed_files", "edges")
STRIPPED = {"chunks": ("signature", "snippet"), "symbols": ("signature", "doc_comment", "body_snippet")}


def exported(ix: Index, name: str, codebase_id: int | None, strip: bool = False) -> DataFrame:
    """The rows of one table that an artifact holds, without their source where asked for."""
    df = ix.raw(name)
    owner = "id" if name == "codebases" else "codebase_id"
    df = df if codebase_id is None else df.filter(F.col(owner) == codebase_id)
    if "id" in df.columns:
        df = df.dropDuplicates(["id"])
    for column in STRIPPED.get(name, ()) if strip else ():
        df = df.withColumn(column, F.lit(""))
    return df


def export_artifact(ix: Index, codebase_id: int, folder: str, strip: bool = False) -> None:
    """Write one codebase's tables to `folder`, a Parquet bundle with its meta table."""
    for name in EXPORTED:
        exported(ix, name, codebase_id, strip).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    meta = [("schema_version", "2"), ("source_stripped", str(strip).lower())]
    ix.spark.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta.parquet")


def stripped_export_sizes(ix: Index) -> DataFrame:
    """Rows, and characters of source, that an export of each codebase holds of chunks and symbols, whole and stripped."""
    parts = []
    for name, columns in STRIPPED.items():
        for strip in (False, True):
            chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0))
            df = exported(ix, name, None, strip).groupBy("codebase_id").agg(F.count("*").alias("rows"), F.sum(chars).cast("long").alias("source_chars"))
            parts.append(df.select(F.lit(name).alias("table_name"), F.lit(strip).alias("stripped"), "codebase_id", "rows", "source_chars"))
    return reduce(DataFrame.unionByName, parts)

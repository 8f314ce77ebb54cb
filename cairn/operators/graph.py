"""The relationship graph: callers, callees, imports, usages, blast radius, resolution across codebases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import ascii_lower, dotted_suffixes
from cairn.sources.index import Index


def edges(ix: Index, *kinds: str) -> DataFrame:
    rows = ix.raw("edges").select("id", "codebase_id", "from_kind", "from_ref", "to_kind", "to_ref", "edge_kind", "line", "resolved", "target_codebase_id")
    if kinds:
        rows = rows.filter(F.col("edge_kind").isin(*kinds))
    return rows.dropDuplicates(["id"])


def targets(ix: Index) -> DataFrame:
    """(codebase_id, target): the qualified names to look for, once each."""
    return ix.raw("symbols").select("codebase_id", F.col("qualified_name").alias("target")).filter("target <> ''").distinct()


def matching_edges(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges whose to_ref is a target letter for letter, or ends with it after a dot whatever the case.

    The suffix LIKE would be a nested-loop join; instead each reference is exploded into its dotted suffixes
    and joined by equality, keys lowered, the whole reference compared exactly. Wildcards in targets count as
    letters here. An edge matches a target once.
    """
    parts = rows.withColumn("suffix", F.explode(dotted_suffixes(F.col("to_ref")))).withColumn("key", ascii_lower(F.col("suffix")))
    keyed = wanted.withColumn("key", ascii_lower(F.col("target")))
    same = (F.col("suffix") != F.col("to_ref")) | (F.col("to_ref") == F.col("target"))
    return parts.join(keyed, ["codebase_id", "key"]).filter(same).drop("key", "suffix").dropDuplicates(["id", "target"])


def callers(ix: Index, kind: str = "calls") -> DataFrame:
    """(codebase_id, target, from_ref, line, edge_id) of each symbol's callers (or who embeds it)."""
    found = matching_edges(edges(ix, kind), targets(ix))
    return found.select("codebase_id", "target", "from_ref", "line", F.col("id").alias("edge_id"))


def usages(ix: Index) -> DataFrame:
    """References of any kind to each symbol, counted by kind."""
    found = matching_edges(edges(ix), targets(ix))
    return found.groupBy("codebase_id", "target", "edge_kind").agg(F.count("*").alias("usages"), F.count_distinct("from_ref").alias("users"))


def usage_edges(ix: Index) -> DataFrame:
    """The references of any kind to each symbol, one row per symbol and edge."""
    return matching_edges(edges(ix), targets(ix)).select("codebase_id", "target", "edge_kind", "from_ref", "to_ref", "line", F.col("id").alias("edge_id"))


def callees(ix: Index) -> DataFrame:
    """What each symbol calls: edges from exactly its qualified name."""
    named = targets(ix).withColumnRenamed("target", "from_ref")
    return edges(ix, "calls").join(named, ["codebase_id", "from_ref"]).select("codebase_id", "from_ref", "to_ref", "line", F.col("id").alias("edge_id"))


def imports(ix: Index) -> DataFrame:
    """What each file imports, in line order."""
    w = Window.partitionBy("codebase_id", "from_ref").orderBy("line", "id")
    return edges(ix, "imports").select("codebase_id", "from_ref", "to_ref", "line", F.row_number().over(w).alias("position"))


def dependents(ix: Index) -> DataFrame:
    """Which files import each known file, by its path letter for letter."""
    paths = ix.raw("source_files").select("codebase_id", F.col("file_path").alias("to_ref")).distinct()
    return edges(ix, "imports").join(paths, ["codebase_id", "to_ref"]).select("codebase_id", "to_ref", "from_ref", "line", F.col("id").alias("edge_id"))


def unresolved_imports(ix: Index) -> DataFrame:
    return edges(ix, "imports").filter("resolved = 0").select(F.col("id").alias("edge_id"), "codebase_id", "from_ref", "to_ref", "line")


def callers_workspace(ix: Index) -> DataFrame:
    """Callers per workspace and target name, from all its codebases."""
    found = callers(ix).join(ix.members, "codebase_id")
    return found.groupBy("workspace", "target").agg(F.count("*").alias("calls"), F.count_distinct("codebase_id").alias("codebases"))


def usages_workspace(ix: Index) -> DataFrame:
    """References of any kind per workspace and target name, from all its codebases."""
    found = matching_edges(edges(ix), targets(ix)).groupBy("codebase_id", "target", "edge_kind").agg(F.count("*").alias("n"))
    return found.join(ix.members, "codebase_id").groupBy("workspace", "target", "edge_kind").agg(F.sum("n").alias("usages"), F.count_distinct("codebase_id").alias("codebases"))


def blast_entries(ix: Index) -> DataFrame:
    """One row per symbol, role and edge: (codebase_id, target, file_path, role, edge_id, ref); each list in the order
    of the edges' ids, repeats kept. One hop: who calls the symbol, what it calls, which files import its file."""
    symbols = ix.raw("symbols").select("codebase_id", F.col("qualified_name").alias("target"), "file_path").filter("target <> ''").distinct()
    named = [
        callers(ix).select("codebase_id", "target", F.lit("callers").alias("role"), "edge_id", F.col("from_ref").alias("ref")),
        callees(ix).select("codebase_id", F.col("from_ref").alias("target"), F.lit("callees").alias("role"), "edge_id", F.col("to_ref").alias("ref")),
    ]
    importing = dependents(ix).select("codebase_id", F.col("to_ref").alias("file_path"), F.lit("dependents").alias("role"), "edge_id", F.col("from_ref").alias("ref"))
    columns = ["codebase_id", "target", "file_path", "role", "edge_id", "ref"]
    by_name = named[0].unionByName(named[1]).join(symbols, ["codebase_id", "target"]).select(*columns)
    return by_name.unionByName(importing.join(symbols, ["codebase_id", "file_path"]).select(*columns))


def blast_radius(ix: Index) -> DataFrame:
    """Per symbol, how many call it, what it calls, and which files import its file, with the first of each by edge.

    The lists themselves are the rows of `blast_entries`; here they are counted before they are joined.
    """
    symbols = ix.raw("symbols").select("codebase_id", F.col("qualified_name").alias("target"), "file_path").filter("target <> ''").distinct()
    by = lambda df, keys, what, name: df.groupBy(*keys).agg(F.count("*").alias(name), F.min_by(what, "edge_id").alias(f"first_{name}"))
    calling = by(callers(ix), ["codebase_id", "target"], "from_ref", "callers")
    called = by(callees(ix).withColumnRenamed("from_ref", "target"), ["codebase_id", "target"], "to_ref", "callees")
    importing = by(dependents(ix).withColumnRenamed("to_ref", "file_path"), ["codebase_id", "file_path"], "from_ref", "dependents")
    joined = symbols.join(calling, ["codebase_id", "target"], "left").join(called, ["codebase_id", "target"], "left").join(importing, ["codebase_id", "file_path"], "left")
    return joined.na.fill(0, ["callers", "callees", "dependents"])


def cross_links(ix: Index, outbound: int = 10, inbound: int = 5) -> DataFrame:
    """Links of each symbol with other codebases: its first edges that lead there, and the first calls of its bare name
    from each sibling in its workspaces. (codebase_id, name, direction, edge_id, other_codebase_id, other_ref, edge_kind)"""
    from cairn.operators.lookups import top_per

    columns = ["codebase_id", "name", "direction", "edge_id", "other_codebase_id", "other_ref", "edge_kind"]
    out = edges(ix).filter("target_codebase_id is not null and target_codebase_id <> codebase_id")
    first = top_per(out, ["codebase_id", "from_ref"], [F.asc("id")], outbound)
    leaving = first.select("codebase_id", F.col("from_ref").alias("name"), F.lit("out").alias("direction"), F.col("id").alias("edge_id"), F.col("target_codebase_id").alias("other_codebase_id"), F.col("to_ref").alias("other_ref"), "edge_kind")
    calls = top_per(edges(ix, "calls"), ["codebase_id", "to_ref"], [F.asc("id")], inbound).drop("position")  # before they meet their siblings
    known = ix.raw("symbols").select("codebase_id", "name").distinct()
    siblings = ix.members.join(ix.members.withColumnRenamed("codebase_id", "other_codebase_id"), "workspace").filter("other_codebase_id <> codebase_id").select("codebase_id", "other_codebase_id").distinct()
    arriving = calls.withColumnRenamed("codebase_id", "other_codebase_id").join(siblings, "other_codebase_id").withColumn("name", F.col("to_ref")).join(known, ["codebase_id", "name"])
    return leaving.unionByName(arriving.select("codebase_id", "name", F.lit("in").alias("direction"), F.col("id").alias("edge_id"), "other_codebase_id", F.col("from_ref").alias("other_ref"), "edge_kind")).select(*columns)


def cross_repo_resolution(ix: Index) -> DataFrame:
    """Unresolved imports that a symbol of another codebase in a workspace of theirs answers.

    In each workspace the first symbol by (exact name, name, id) of a sibling; later workspaces, by name,
    overwrite earlier ones.
    """
    open_ = edges(ix, "imports").filter("resolved = 0").select(F.col("id").alias("edge_id"), "codebase_id", "to_ref").join(ix.members, "codebase_id")
    symbols = ix.raw("symbols").select(F.col("id").alias("symbol_id"), F.col("codebase_id").alias("sibling"), "name", "qualified_name").dropDuplicates(["symbol_id"])
    named = symbols.select("symbol_id", "sibling", "name", F.col("name").alias("to_ref"), F.lit(0).alias("rank")).unionByName(
        symbols.filter("qualified_name <> name").select("symbol_id", "sibling", "name", F.col("qualified_name").alias("to_ref"), F.lit(1).alias("rank"))
    )
    there = named.join(ix.members.withColumnRenamed("codebase_id", "sibling"), "sibling")
    hits = open_.join(there, ["workspace", "to_ref"]).filter("sibling <> codebase_id")
    best = hits.groupBy("edge_id", "codebase_id", "to_ref", "workspace").agg(F.min(F.struct("rank", "name", "symbol_id", "sibling")).alias("s"))
    return best.groupBy("edge_id", "codebase_id", "to_ref").agg(F.max_by("s.sibling", "workspace").alias("target_codebase_id"), F.max_by("s.symbol_id", "workspace").alias("symbol_id"))

"""Symbol, file and overview lookups, set-based: for every codebase at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import compact, sqlite_like
from cairn.sources.index import Index

# How many characters of a text an answer holds.
COMPACTED = {"signature": 160, "doc_comment": 280, "body_snippet": 240}
FUZZY_TOP, SYMBOL_TOP, FILES_TOP, EXPORTED_TOP = 20, 50, 10, 20


def top_per(df: DataFrame, group: str | list[str], order: list, most: int, name: str = "position") -> DataFrame:
    """The first `most` rows per group with their position; Spark limits each group before it shuffles."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= most)


def list_codebases(ix: Index) -> DataFrame:
    """Codebases, newest id first."""
    return ix.codebases.select("id", "root_path", "name", "indexed_at").orderBy(F.desc("id"))


def codebase_by_id(ix: Index, codebase_id: int = 1) -> DataFrame:
    """The codebase with this id; no row where there is none."""
    return ix.codebases.filter(F.col("id") == codebase_id).select("id", "root_path", "name", "indexed_at")


def chunk_listing(ix: Index) -> DataFrame:
    """The chunks of each codebase by path and line."""
    rows = ix.once("chunks", "codebase_id", "file_path", "chunk_key", "kind", "start_line", "end_line")
    return rows.orderBy("codebase_id", "file_path", "start_line", "id")


def source_file_listing(ix: Index) -> DataFrame:
    """The files of each codebase by path, each as its newest row has it."""
    rows = ix.current("source_files", "language", "package_name", "loc", "symbol_count")
    return rows.select("codebase_id", "file_path", "language", "package_name", "loc", "symbol_count").orderBy("codebase_id", "file_path")


def compacted_symbols(ix: Index) -> DataFrame:
    """Symbols with their texts cut to what an answer holds."""
    rows = ix.once("symbols", *COMPACTED)
    return rows.select("id", *(compact(F.coalesce(c, F.lit("")), most).alias(c) for c, most in COMPACTED.items()))


def workspace_members(ix: Index) -> DataFrame:
    """Members of each workspace with their codebase's name."""
    return ix.members.join(ix.codebases.select(F.col("id").alias("codebase_id"), "name"), "codebase_id").select("workspace", "codebase_id", "name")


def workspaces(ix: Index) -> DataFrame:
    return ix.members.groupBy("workspace").agg(F.count("*").alias("codebases"))


def symbols_by_kind(ix: Index) -> DataFrame:
    return ix.once("symbols", "codebase_id", "kind").groupBy("codebase_id", "kind").agg(F.count("*").alias("symbols"))


def top_files(ix: Index) -> DataFrame:
    """The files with most symbols per codebase."""
    counted = ix.once("symbols", "codebase_id", "file_path").groupBy("codebase_id", "file_path").agg(F.count("*").alias("symbols"))
    return top_per(counted, "codebase_id", [F.desc("symbols"), F.asc("file_path")], FILES_TOP)


def exported_functions(ix: Index) -> DataFrame:
    """The first exported functions and methods per codebase in file and line order."""
    rows = ix.raw("symbols").filter(F.col("kind").isin("func", "method") & (F.col("visibility") == "exported")).select("id", "codebase_id", "file_path", "name", "start_line").dropDuplicates(["id"])
    return top_per(rows, "codebase_id", [F.asc("file_path"), F.asc("start_line"), F.asc("id")], EXPORTED_TOP)


def file_symbols(ix: Index) -> DataFrame:
    """All symbols of each file with their place in line order."""
    rows = ix.once("symbols", "codebase_id", "file_path", "kind", "name", "start_line", "end_line")
    w = Window.partitionBy("codebase_id", "file_path").orderBy("start_line", "id")
    return rows.withColumn("position", F.row_number().over(w))


def annotated_file_symbols(ix: Index) -> DataFrame:
    """file_symbols, those of files that weren't indexed completely marked."""
    from cairn.operators.search import annotated

    return annotated(ix, file_symbols(ix)).select("id", "codebase_id", "file_path", "name", "position", "degraded", "reason")


def symbols_of_kind(ix: Index, kind: str = "struct") -> DataFrame:
    return ix.raw("symbols").filter(F.col("kind") == kind).select("id", "codebase_id", "file_path", "name", "start_line").dropDuplicates(["id"])


def list_capabilities(ix: Index) -> DataFrame:
    """Names, kinds and files of what each codebase can do."""
    return ix.raw("symbols").select("codebase_id", "name", "kind", "file_path").distinct()


def find_symbol(ix: Index, query: str = "parse") -> DataFrame:
    """Per codebase the best symbols whose name or qualified name has the query in it.

    Exact name first, then exact qualified name, then the rest by name; LIKE as SQLite has it.
    """
    like = f"%{query}%"
    hits = ix.raw("symbols").filter(sqlite_like(F.col("name"), like) | sqlite_like(F.col("qualified_name"), like))
    rank = F.when(F.col("name") == query, 0).when(F.col("qualified_name") == query, 1).otherwise(2)
    rows = hits.select("id", "codebase_id", "name", "qualified_name", "kind", rank.alias("rank")).dropDuplicates(["id"])
    return top_per(rows, "codebase_id", [F.asc("rank"), F.asc("name"), F.asc("id")], SYMBOL_TOP)


def find_symbol_of_kind(ix: Index, query: str = "parse", kind: str = "method") -> DataFrame:
    """As find_symbol, the kind looked at after the limit, so that fewer may be left."""
    return find_symbol(ix, query).filter(F.col("kind") == kind)


def _near_symbols(ix: Index, query: str) -> DataFrame:
    """The symbols within an edit distance of a quarter of the query's length (1 to 3)."""
    size = len(query.encode())
    most = max(1, min(3, size // 4))
    near = lambda c: F.levenshtein(F.lower(c), F.lit(query.lower()), most)
    far = F.lit(most + 1)
    distance = F.least(*(F.when(near(c) >= 0, near(c)).otherwise(far) for c in ("name", "qualified_name")))
    band = F.length("name").between(size - most, size + most) | F.length("qualified_name").between(size - most, size + most)
    return ix.raw("symbols").filter(band).select("id", "codebase_id", "name", "qualified_name", distance.alias("distance")).filter(F.col("distance") <= most).dropDuplicates(["id"])


def find_symbol_fuzzy(ix: Index, query: str = "parseRecrd") -> DataFrame:
    """Per codebase the nearest symbols."""
    return top_per(_near_symbols(ix, query), "codebase_id", [F.asc("distance"), F.asc("id")], FUZZY_TOP)


def find_symbol_or_fuzzy(ix: Index, query: str = "parseRecrd") -> DataFrame:
    """find_symbol per codebase and, where it finds nothing there, find_symbol_fuzzy."""
    exact, near = find_symbol(ix, query), find_symbol_fuzzy(ix, query)
    columns = ["id", "codebase_id", "name", "qualified_name", "position"]
    missing = near.join(exact.select("codebase_id").distinct(), "codebase_id", "left_anti")
    return exact.select(*columns, F.lit(False).alias("fuzzy")).unionByName(missing.select(*columns, F.lit(True).alias("fuzzy")))


def _in_workspaces(ix: Index, rows: DataFrame) -> DataFrame:
    return rows.join(workspace_members(ix).withColumnRenamed("name", "codebase_name"), "codebase_id")


def find_symbol_workspace(ix: Index, query: str = "merge") -> DataFrame:
    """The best symbols per workspace, ranked as find_symbol does, with their codebase's name."""
    like = f"%{query}%"
    hits = ix.raw("symbols").filter(sqlite_like(F.col("name"), like) | sqlite_like(F.col("qualified_name"), like)).select("id", "codebase_id", "name", "qualified_name").dropDuplicates(["id"])
    rank = F.when(F.col("name") == query, 0).when(F.col("qualified_name") == query, 1).otherwise(2)
    return top_per(_in_workspaces(ix, hits).withColumn("rank", rank), "workspace", [F.asc("rank"), F.asc("name"), F.asc("id")], SYMBOL_TOP)


def find_symbol_fuzzy_workspace(ix: Index, query: str = "parseRecrd") -> DataFrame:
    """The nearest symbols per workspace."""
    rows = _in_workspaces(ix, _near_symbols(ix, query))
    return top_per(rows, "workspace", [F.asc("distance"), F.asc("id")], FUZZY_TOP)


def file_stats(ix: Index) -> DataFrame:
    """Files and lines of each codebase, of the newest row per file."""
    return ix.current("source_files", "loc").groupBy("codebase_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))


def language_breakdown(ix: Index) -> DataFrame:
    """Files per codebase and language, the language's spelling levelled, unknown where it is missing."""
    language = F.lower(F.trim("language"))
    plain = F.create_map(*(F.lit(x) for pair in {"py": "python", "golang": "go", "rs": "rust", "ts": "typescript", "js": "javascript"}.items() for x in pair))
    name = F.when(F.coalesce(language, F.lit("")) == "", F.lit("unknown")).otherwise(F.coalesce(plain[language], language))
    return ix.current("source_files", "language").groupBy("codebase_id", name.alias("language")).agg(F.count("*").alias("files"))


def package_list(ix: Index) -> DataFrame:
    return ix.current("source_files", "package_name").filter("package_name <> ''").select("codebase_id", "package_name").distinct()


def index_status(ix: Index) -> DataFrame:
    """Chunks of each codebase and when they were last indexed; codebases without any are not indexed."""
    chunks = ix.once("chunks", "codebase_id", "indexed_at").groupBy("codebase_id").agg(F.count("*").alias("n"), F.max("indexed_at").alias("last"))
    ids = ix.codebases.select(F.col("id").alias("codebase_id"))
    return ids.join(chunks, "codebase_id", "left").select("codebase_id", F.coalesce("n", F.lit(0)).alias("chunks"), F.coalesce("last", F.lit(0)).alias("last_indexed_at"), (F.coalesce("n", F.lit(0)) > 0).alias("indexed"))


def package_outline(ix: Index, package: str | None = None, prefix: str | None = None) -> DataFrame:
    """Each file of each package (or of one, or under a path) with its symbols in line order, its lines and those of
    all listed files of its codebase."""
    symbols = ix.once("symbols", "codebase_id", "file_path", "kind", "name", "start_line")
    listed = symbols.groupBy("codebase_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "id", "kind", "name"))).alias("s"))
    named = listed.select("codebase_id", "file_path", F.size("s").alias("symbols"), F.array_join(F.transform("s", lambda s: F.concat_ws(" ", s["kind"], s["name"])), ", ").alias("outline"))
    files = ix.current("source_files", "package_name", "loc").select("codebase_id", "file_path", "package_name", "loc")
    if package is not None:
        files = files.filter(F.col("package_name") == package)
    if prefix is not None:
        files = files.filter(F.col("file_path").startswith(prefix))
    files = files.join(files.groupBy("codebase_id").agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc")), "codebase_id")
    return files.join(named, ["codebase_id", "file_path"], "left").select("codebase_id", "package_name", "file_path", "loc", "total_loc", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("outline", F.lit("")).alias("outline"))


def project_overview(ix: Index) -> DataFrame:
    """Files, lines, packages, symbols and functions of each codebase in one row."""
    files = ix.current("source_files", "loc", "package_name").groupBy("codebase_id").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.count_distinct(F.when(F.col("package_name") != "", F.col("package_name"))).alias("packages")
    )
    symbols = ix.once("symbols", "codebase_id", "kind", "visibility").groupBy("codebase_id").agg(
        F.count("*").alias("symbols"), F.count_if(F.col("kind").isin("func", "method") & (F.col("visibility") == "exported")).alias("exported_functions")
    )
    return files.join(symbols, "codebase_id", "full_outer").na.fill(0)


def capabilities(ix: Index) -> DataFrame:
    from cairn.functions.text import path_domain

    return ix.raw("symbols").select("codebase_id", path_domain(F.col("file_path")).alias("domain"), "name", "kind").distinct()


def _capability_sides(ix: Index, pairs: DataFrame | None) -> DataFrame:
    """What either codebase of each pair can: (first, second, domain, name, kind, in_a, in_b)."""
    w = Window.partitionBy("workspace").orderBy("codebase_id")
    compared = pairs if pairs is not None else ix.members.withColumn("first", F.lag("codebase_id").over(w)).filter("first is not null").select("first", F.col("codebase_id").alias("second"))
    able = capabilities(ix)
    keys = ["first", "second", "domain", "name", "kind"]
    a = compared.join(able.withColumnRenamed("codebase_id", "first"), "first").select(*keys, F.lit(1).alias("in_a"))
    b = compared.join(able.withColumnRenamed("codebase_id", "second"), "second").select(*keys, F.lit(1).alias("in_b"))
    return a.withColumn("in_b", F.lit(0)).unionByName(b.withColumn("in_a", F.lit(0))).groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def compare_capabilities(ix: Index, pairs: DataFrame | None = None) -> DataFrame:
    """The codebases of `pairs` (first, second), by default each and the one before it in its workspace, by domain.

    implemented: seven tenths or more of what the first can are there; partial: some; missing: the second has
    nothing there; extra: only the second has.
    """
    by = _capability_sides(ix, pairs).groupBy("first", "second", "domain").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"), F.sum(F.col("in_a") * F.col("in_b")).alias("both"))
    status = F.when(F.col("a") == 0, "extra").when(F.col("b") == 0, "missing").when(10 * F.col("both") >= 7 * F.col("a"), "implemented").otherwise("partial")
    return by.withColumn("status", status)


def capability_gaps(ix: Index, pairs: DataFrame | None = None) -> DataFrame:
    """What only one codebase of a pair can, one row each, with the side that has it."""
    only = _capability_sides(ix, pairs).filter("in_a <> in_b")
    return only.select("first", "second", "domain", "name", "kind", F.when(F.col("in_a") == 1, "first").otherwise("second").alias("only_in"))


def capability_summary(ix: Index) -> DataFrame:
    return compare_capabilities(ix).groupBy("first", "second", "status").agg(F.count("*").alias("domains"))

"""Lexical search over chunks: BM25 with the full-text grammar, tiered fallbacks, issue localisation."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import compact, escape_fts, query_terms, words
from cairn.operators.lookups import top_per
from cairn.session import cut_lineage, shared_folder
from cairn.sources.index import Index
from cairn.sources.tables import table

COLUMNS = ("snippet", "name", "file_path")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_TOKEN = re.compile(r'\s*(?:(AND|OR|NOT)(?=\s|$)|(?:(\w+)\s*:\s*)?(?:"([^"]*)"|([^\s"():^+*,.\'?/=;-]+)(\*)?)|(\()|(\)))')


class Phrase:
    """One bareword, quoted phrase or prefix of a query, perhaps confined to a column."""

    def __init__(self, text: str, prefix: bool = False, column: str | None = None):
        from cairn.functions.text import ACCENTED, PLAIN

        folded = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
        self.terms, self.prefix, self.column = re.findall(r"[^\W_]+", folded), prefix, column
        if not self.terms:
            raise ValueError("a phrase without a word")

    def hits(self, postings: DataFrame) -> DataFrame:
        """(chunk_id, f): how often the phrase occurs in each chunk, overlapping occurrences too.

        Only the row groups of its words are read; words of a phrase meet where they begin at one place.
        """
        if self.column:
            postings = postings.filter(F.col("col") == self.column)
        last = len(self.terms) - 1
        of = [postings.filter(F.col("term").startswith(t) if self.prefix and j == last else F.col("term") == t) for j, t in enumerate(self.terms)]
        if not last:
            return of[0].groupBy("chunk_id").agg(F.sum(F.size("positions")).alias("f"))
        begins = [p.select("chunk_id", "col", F.explode(F.expr(f"transform(positions, p -> p - {j})")).alias("begin"), F.lit(j).alias("j")) for j, p in enumerate(of)]
        met = reduce(DataFrame.unionByName, begins).groupBy("chunk_id", "col", "begin").agg(F.count_distinct("j").alias("n")).filter(F.col("n") == last + 1)
        return met.groupBy("chunk_id").agg(F.count("*").alias("f"))


def compile_query(query: str) -> tuple[list[Phrase], Column]:
    """Phrases of a query and which rows it matches, as a condition on their hits f0, f1, ...

    Implicit AND binds before NOT, AND and OR as in the full-text grammar; ValueError for what that refuses.
    """
    tokens, at = [], 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"syntax error near {query[at:at + 20]!r}")
        tokens.append(m)
        at = m.end()
    if not tokens:
        raise ValueError("empty query")
    phrases: list[Phrase] = []
    place = 0

    def take() -> re.Match | None:
        nonlocal place
        place += 1
        return tokens[place - 1] if place <= len(tokens) else None

    def peek() -> str:
        if place >= len(tokens):
            return ""
        m = tokens[place]
        return m.group(1) or m.group(6) or m.group(7) or "phrase"

    def primary() -> Column:
        m = take()
        if m is None or m.group(1) or m.group(7):
            raise ValueError("syntax error: a phrase is missing")
        if m.group(6):
            inner = either()
            if peek() != ")":
                raise ValueError("syntax error: an open parenthesis")
            take()
            return inner
        if m.group(2) and m.group(2) not in COLUMNS:
            raise ValueError(f"no such column: {m.group(2)}")
        phrases.append(Phrase(m.group(3) if m.group(3) is not None else m.group(4), bool(m.group(5)), m.group(2)))
        return F.col(f"f{len(phrases) - 1}") > 0

    def row() -> Column:
        grouped = peek() == "("
        found = primary()
        while peek() == "phrase" and not grouped:
            found = found & primary()
        return found

    def without() -> Column:
        found = row()
        while peek() == "NOT":
            take()
            found = found & ~row()
        return found

    def both() -> Column:
        found = without()
        while peek() == "AND":
            take()
            found = found & without()
        return found

    def either() -> Column:
        found = both()
        while peek() == "OR":
            take()
            found = found | both()
        return found

    condition = either()
    if place < len(tokens):
        raise ValueError("syntax error after the query")
    return phrases, condition


def chunk_words(ix: Index) -> DataFrame:
    """(id, w_snippet, w_name, w_file_path): the words of each chunk's indexed columns, each chunk once."""
    return ix.once("chunks", *COLUMNS).select("id", *(words(F.coalesce(c, F.lit(""))).alias(f"w_{c}") for c in COLUMNS))


def postings(ix: Index) -> DataFrame:
    """The inverted index: (term, chunk_id, col, positions), one row per word, chunk and column."""
    columns = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"w_{c}").alias("words")) for c in COLUMNS))
    rows = chunk_words(ix).select(F.col("id").alias("chunk_id"), F.explode(columns).alias("c")).select("chunk_id", "c.col", F.posexplode("c.words").alias("pos", "term"))
    return rows.groupBy("term", "chunk_id", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def chunk_sizes(ix: Index) -> DataFrame:
    """(chunk_id, size): words of each chunk in all indexed columns."""
    return chunk_words(ix).select(F.col("id").alias("chunk_id"), reduce(lambda a, b: a + b, [F.size(f"w_{c}") for c in COLUMNS]).alias("size"))


def write_text_index(ix: Index, folder: str) -> None:
    """Write postings, ordered by term so that a query reads the row groups of its terms only, and sizes."""
    postings(ix).repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{folder}/postings.parquet")
    chunk_sizes(ix).write.mode("overwrite").parquet(f"{folder}/sizes.parquet")


_WRITTEN: dict[tuple[str, str], str] = {}


def text_index(ix: Index) -> tuple[DataFrame, DataFrame]:
    """(postings, sizes) of an index folder's chunks: written once per session to the shared folder, then read.

    A chunk table that isn't in a folder is indexed anew by each query.
    """
    if not hasattr(ix, "folder"):
        return postings(ix), chunk_sizes(ix)
    spark = ix.spark
    key = (spark.sparkContext.applicationId, ix.folder)
    if key not in _WRITTEN:
        folder = f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"
        write_text_index(ix, folder)
        _WRITTEN[key] = folder
    return table(spark, _WRITTEN[key], "postings"), table(spark, _WRITTEN[key], "sizes")


FIELDS = ("codebase_id", "file_path", "kind", "name", "signature", "snippet", "start_line", "end_line")


def scored(ix: Index, query: str) -> DataFrame:
    """All chunks that match, with `bm25` (less is better), statistics being those of all chunks.

    Only the postings of the query's words are read and grouped; snippets are fetched for what matches.
    """
    phrases, condition = compile_query(query)
    post, sizes = text_index(ix)
    hits = reduce(DataFrame.unionByName, [p.hits(post).withColumn("i", F.lit(i)) for i, p in enumerate(phrases)])
    met = hits.groupBy("chunk_id").agg(*(F.coalesce(F.sum(F.when(F.col("i") == i, F.col("f"))), F.lit(0)).alias(f"f{i}") for i in range(len(phrases))))
    corpus = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("avg_size"))
    figures = met.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases)))).crossJoin(F.broadcast(corpus))  # one row each

    def part(i: int) -> Column:
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        f = F.col(f"f{i}")
        return F.when(idf > 0, idf).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))

    score = -reduce(lambda a, b: a + b, [part(i) for i in range(len(phrases))])
    best = met.filter(condition).join(sizes, "chunk_id").crossJoin(F.broadcast(figures)).select(F.col("chunk_id").alias("id"), score.alias("bm25"))  # one row of figures
    return ix.raw("chunks").select("id", *FIELDS).join(best, "id").dropDuplicates(["id"])


def like_fallback(ix: Index, query: str) -> DataFrame:
    """Chunks that hold the whole query in a column, letter case ignored, without a score."""
    low = query.lower()
    has = reduce(lambda a, b: a | b, [F.lower(c).contains(low) for c in COLUMNS])
    rows = ix.raw("chunks").filter(has).dropDuplicates(["id"])
    return rows.select("id", "codebase_id", "file_path", "kind", "name", "signature", "snippet", "start_line", "end_line", F.lit(0.0).alias("bm25"))


def lexical(ix: Index, query: str) -> DataFrame:
    """The query as it is; where the grammar refuses it, without its marks; else as a plain substring."""
    for text in (query, escape_fts(query)):
        try:
            return scored(ix, text)
        except ValueError:
            continue
    return like_fallback(ix, query)


def search(ix: Index, query: str, limit: int = 20) -> DataFrame:
    """The best hits in all codebases with compacted text."""
    hits = lexical(ix, query).orderBy("bm25", "id").limit(limit)
    return hits.select("id", "codebase_id", "file_path", "name", "kind", "start_line", "end_line", compact(F.col("snippet"), 240).alias("snippet"), F.round("bm25", 6).alias("bm25_score"))


def memory_scan(ix: Index, query: str, limit: int = 20) -> DataFrame:
    """The last resort: the first chunks whose snippet or name holds the query, letter case ignored."""
    low = query.lower()
    rows = ix.raw("chunks").filter(F.lower("snippet").contains(low) | F.lower("name").contains(low)).dropDuplicates(["id"])
    return rows.select("id", "codebase_id", "file_path", "name").orderBy("id").limit(limit)


def annotated(ix: Index, hits: DataFrame) -> DataFrame:
    """`hits` (with codebase_id and file_path) with `degraded` and its `reason`, NULL where the file is indexed whole."""
    states = ix.current("indexed_files", "index_status", "status_reason").filter("index_status <> 'complete'")
    reason = F.concat("index_status", F.lit(": "), F.coalesce("status_reason", F.lit("")))
    return hits.join(states.select("codebase_id", "file_path", reason.alias("reason")), ["codebase_id", "file_path"], "left").withColumn("degraded", F.col("reason").isNotNull())


def annotated_hits(ix: Index, query: str) -> DataFrame:
    """All matches, those whose file wasn't indexed completely marked."""
    return annotated(ix, lexical(ix, query).select("id", "codebase_id", "file_path")).select("id", "codebase_id", "file_path", "degraded", "reason")


def degraded_hits(ix: Index, query: str) -> DataFrame:
    """Matches whose file wasn't indexed completely, with the reason."""
    return annotated_hits(ix, query).filter("degraded").drop("degraded")


def kind_bonus(kind: Column, path: Column) -> Column:
    """What a chunk's kind and path add to its score."""
    kind, path = F.lower(kind), F.lower(path)
    by_kind = F.when(kind.isin("func", "method"), 0.15).when(kind.isin("type", "interface"), 0.06).when(kind.isin("const", "var", "field", "package"), -0.15).otherwise(0.0)
    stored = F.when(path.rlike(r"[._]sql\.go"), -0.2).when(path.contains("/db/"), -0.08).otherwise(0.0)
    near = F.when(path.rlike("/llm/|/handler|/router|/api/|/server/"), 0.08).when(path.rlike("/internal/|/cmd/"), 0.03).otherwise(0.0)
    return by_kind + stored + near


def issue_candidates(ix: Index, query: str, limit: int = 10) -> DataFrame:
    """The likeliest places of an issue: best chunks per codebase, filtered, normalised, raised by kind, path
    and terms, above 0.1, best first.

    Tests, documentation and imports are left out; of one name in one file the best chunk counts.
    """
    from cairn.operators.ingest import path_rules

    clamp = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    best = top_per(lexical(ix, query).drop("snippet", "signature"), "codebase_id", [F.asc("bm25"), F.asc("id")], max(5 * limit, 50)).drop("position")
    # one maximum over at most 50 rows of each codebase
    best = best.join(F.broadcast(best.agg(F.max(F.abs("bm25")).alias("most"))))
    code = path_rules(best).filter("implementation and not test").filter(F.lower(F.coalesce("kind", F.lit(""))) != "import").drop("ignored", "code", "test", "implementation")
    once = top_per(code, ["codebase_id", "file_path", "name"], [F.asc("bm25"), F.asc("id")], 1).drop("position")
    terms = query_terms(query)
    target = F.lower(F.concat_ws(" ", "name", "file_path"))
    met = reduce(lambda a, b: a + b, [target.contains(t).cast("int") for t in terms]) if terms else F.lit(0)
    base = clamp(F.when(F.col("most") > 0, -F.col("bm25") / F.col("most")).otherwise(0.0))
    raised = clamp(clamp(base + kind_bonus(F.col("kind"), F.col("file_path"))) + 0.08 * met / max(1, len(terms)))
    ranked = once.withColumn("confidence", F.round(raised, 6))
    return ranked.filter("confidence >= 0.1").orderBy(F.desc("confidence"), "codebase_id", "file_path", "name").limit(limit).drop("bm25", "most")


def locate_issue(ix: Index, query: str = "merge bucket", limit: int = 10) -> DataFrame:
    """The likeliest places of an issue with what surrounds them: how many call each, what it calls, which files
    import its file (all of them are rows of `issue_impact`), the lines of its first five chunks, and how many links
    lead to other codebases of its workspaces and from them."""
    top = cut_lineage(issue_candidates(ix, query, limit))
    keys = ["codebase_id", "file_path", "name"]
    counted = issue_impact(ix, query, limit, top).groupBy(*keys).agg(*(F.count_if(F.col("role") == role).alias(role) for role in ("callers", "callees", "dependents", "outbound", "inbound")))
    rows = ix.raw("chunks").select("id", *keys, F.col("start_line").alias("s"), F.col("end_line").alias("e")).join(F.broadcast(top.select(*keys)), keys, "left_semi").dropDuplicates(["id"])
    first = top_per(rows, keys, [F.asc("s"), F.asc("id")], 5)
    chunks = first.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "s", "e"))), lambda c: F.concat_ws("-", c["s"], c["e"])), ",").alias("chunks"))
    out = top.join(counted, keys, "left").join(chunks, keys, "left").na.fill(0, ["callers", "callees", "dependents", "outbound", "inbound"])
    return out.select(*keys, "kind", "start_line", "end_line", "confidence", "callers", "callees", "dependents", "chunks", "outbound", "inbound")


def issue_impact(ix: Index, query: str = "merge bucket", limit: int = 10, places: DataFrame | None = None) -> DataFrame:
    """One row per place and edge around it: (codebase_id, file_path, name, role, edge_id, ref), each role in the order
    of the edges' ids. Roles: callers, callees, dependents (files that import its file), outbound (the first ten
    edges into other codebases) and inbound (the first five calls from each sibling of its workspaces).

    The few places (issue_candidates' or those given) are broadcast to the edges, so no edge is exploded or shuffled
    but those that meet one.
    """
    keys = ["codebase_id", "file_path", "name"]
    places = cut_lineage(issue_candidates(ix, query, limit)) if places is None else places
    top = F.broadcast(places.select(*keys))  # `limit` rows at most
    every = ix.raw("edges").select("id", "codebase_id", "from_ref", "to_ref", "edge_kind", "target_codebase_id")
    calls, imports = every.filter("edge_kind = 'calls'"), every.filter("edge_kind = 'imports'")
    suffix = F.lower(F.col("to_ref")).endswith(F.concat(F.lit("."), F.lower("name")))

    def role(name: str, rows: DataFrame, ref: str) -> DataFrame:
        return rows.select(*keys, F.lit(name).alias("role"), F.col("id").alias("edge_id"), F.col(ref).alias("ref")).distinct()

    callers = calls.join(top, "codebase_id").filter((F.col("to_ref") == F.col("name")) | suffix)
    callees = calls.join(top.withColumn("from_ref", F.col("name")), ["codebase_id", "from_ref"])
    dependents = imports.join(top.withColumn("to_ref", F.col("file_path")), ["codebase_id", "to_ref"])
    leaving = every.filter("target_codebase_id is not null").join(top.withColumn("from_ref", F.col("name")), ["codebase_id", "from_ref"])
    siblings = ix.members.join(ix.members.withColumnRenamed("codebase_id", "sibling"), "workspace").filter("sibling <> codebase_id").select("codebase_id", "sibling").distinct()
    there = siblings.join(top, "codebase_id").select(*keys, "sibling", F.col("name").alias("to_ref"))
    arriving = calls.withColumnRenamed("codebase_id", "sibling").join(there, ["sibling", "to_ref"])
    return reduce(
        DataFrame.unionByName,
        [
            role("callers", callers, "from_ref"),
            role("callees", callees, "to_ref"),
            role("dependents", dependents, "from_ref"),
            role("outbound", top_per(leaving.dropDuplicates([*keys, "id"]), keys, [F.asc("id")], 10), "to_ref"),
            role("inbound", top_per(arriving.dropDuplicates([*keys, "sibling", "id"]), [*keys, "sibling"], [F.asc("id")], 5), "from_ref"),
        ],
    )


def term_statistics(ix: Index) -> DataFrame:
    """In how many chunks each term is, and how often."""
    return text_index(ix)[0].groupBy("term").agg(F.count_distinct("chunk_id").alias("chunks"), F.sum(F.size("positions")).alias("occurrences"))

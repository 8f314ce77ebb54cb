"""SQL equivalents of the core's queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

from cairn.functions.text import ACCENTED, PLAIN
from cairn.operators import ingest

#: Registered searches, one per feature of the query grammar.
SENTENCE = "when would the journal and ledger"
SEARCHES = {
    "single": "ledger",
    "and": "merge bucket",
    "or": "tombstone OR mutex",
    "not": "journal NOT palette",
    "phrase": '"retry limit"',
    "prefix": "valid*",
    "column": "name:go",
    "like": "ctx context.Context, journal",
}


def _once(name: str, where: str = "true") -> str:
    return f"(SELECT DISTINCT * FROM {name} WHERE {where})"


def _current(name: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codebase_id, file_path ORDER BY indexed_at DESC NULLS LAST, id DESC) AS rn FROM {name}) WHERE rn = 1)"


_MEMBERS = "(SELECT string_split(root_path, '/')[4] AS workspace, id AS codebase_id, name FROM codebases WHERE coalesce(string_split(root_path, '/')[4], '') <> '')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _top(inner: str, group: str, order: str, most: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order})::INTEGER AS position FROM ({inner})) WHERE position <= {most}"


def _callers(kinds: str) -> str:
    """Edges with the targets they match, once each."""
    return f"""(SELECT DISTINCT e.*, t.target FROM {_once("edges", kinds)} e
        JOIN (SELECT DISTINCT codebase_id, qualified_name AS target FROM symbols WHERE qualified_name <> '') t ON e.codebase_id = t.codebase_id
        AND (e.to_ref = t.target OR ends_with({_LOW.format("e.to_ref")}, '.' || {_LOW.format("t.target")})))"""


def _words(column: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({column}, '')), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(hits: list[str], condition: str, columns: tuple[str, ...] = ("ws", "wn", "wp")) -> str:
    def count(test: str) -> str:
        return " + ".join(f"len(list_filter(range(1, len({c}) + 1), lambda i: {test.replace('@', c)}))" for c in columns)

    f = ", ".join(f"{count(h)} AS f{i}" for i, h in enumerate(hits))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(hits)))
    score = " + ".join(
        f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / avg_size))" for i in range(len(hits))
    )
    return f"""WITH w AS (SELECT id, codebase_id, file_path, {_words("snippet")} AS ws, {_words("name")} AS wn, {_words("file_path")} AS wp FROM {_once("chunks")}),
        h AS (SELECT *, {f}, len(ws) + len(wn) + len(wp) AS size FROM w),
        s AS (SELECT count(*) AS n, avg(size) AS avg_size, {n} FROM h)
        SELECT id, codebase_id, file_path, round(-({score}), 6) AS bm25_score FROM h, s WHERE {condition}"""


def _search_sql() -> dict[str, str]:
    word = "@[i] = '{}'"
    like = " OR ".join(f"contains(lower({c}), '{SEARCHES['like'].lower()}')" for c in ("snippet", "name", "file_path"))
    return {
        "search_single": _bm25([word.format("ledger")], "f0 > 0"),
        "search_and": _bm25([word.format("merge"), word.format("bucket")], "f0 > 0 AND f1 > 0"),
        "search_or": _bm25([word.format("tombstone"), word.format("mutex")], "f0 > 0 OR f1 > 0"),
        "search_not": _bm25([word.format("journal"), word.format("palette")], "f0 > 0 AND NOT f1 > 0"),
        "search_phrase": _bm25(["@[i] = 'retry' AND @[i + 1] = 'limit'"], "f0 > 0"),
        "search_prefix": _bm25(["starts_with(@[i], 'valid')"], "f0 > 0"),
        "search_column": _bm25([word.format("go")], "f0 > 0", ("wn",)),
        "search_like": f"SELECT id, codebase_id, file_path, 0.0::DOUBLE AS bm25_score FROM {_once('chunks')} WHERE {like}",
    }


_CALLS = "(SELECT event_id AS id, event_type AS tool, epoch_us(ts) // 1000 AS recorded_at, floor(value * 10)::BIGINT AS duration_ms, event_type = 'error' AS is_error FROM events)"
_LANGUAGE = "CASE WHEN coalesce(lower(trim(language)), '') = '' THEN 'unknown' ELSE CASE lower(trim(language)) WHEN 'py' THEN 'python' WHEN 'golang' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' ELSE lower(trim(language)) END END"
_LEGACY = "regexp_matches(b.file_hash, '^[0-9a-fA-F]{1,63}$')"
_DELTA = f"""(SELECT coalesce(a.codebase_id, b.codebase_id) AS codebase_id, coalesce(a.file_path, b.file_path) AS file_path,
    CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.file_hash = b.file_hash AND NOT {_LEGACY} THEN 'unchanged' ELSE 'changed' END AS state
    FROM {_current("source_files")} a FULL JOIN {_current("indexed_files")} b ON a.codebase_id = b.codebase_id AND a.file_path = b.file_path)"""
_POLICIES = """(SELECT codebase_id, coalesce(bool_or(lower(trim(value)) = 'true' AND k = 'closedsource'), false) AS closed_source, coalesce(bool_or(lower(trim(value)) = 'true' AND k = 'sourcestripped'), false) AS source_stripped
    FROM (SELECT codebase_id, value, regexp_replace(lower(key), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM codebase_meta) GROUP BY codebase_id)"""
_ABLE = "(SELECT DISTINCT codebase_id, CASE WHEN instr(file_path, '/') > 1 THEN string_split(file_path, '/')[1] || '/' ELSE '(root)' END AS domain, name, kind FROM symbols)"
_COMPARED = f"""(WITH p AS (SELECT * FROM (SELECT lag(codebase_id) OVER (PARTITION BY workspace ORDER BY codebase_id) AS first, codebase_id AS second FROM {_MEMBERS}) WHERE first IS NOT NULL),
    s AS (SELECT first, second, domain, name, kind, max(a) AS a, max(b) AS b FROM (
        SELECT first, second, domain, name, kind, 1 AS a, 0 AS b FROM p JOIN {_ABLE} c ON c.codebase_id = first
        UNION ALL SELECT first, second, domain, name, kind, 0, 1 FROM p JOIN {_ABLE} c ON c.codebase_id = second) GROUP BY ALL),
    d AS (SELECT first, second, domain, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(a * b)::BIGINT AS both_sides FROM s GROUP BY ALL)
    SELECT first, second, domain, a, b, both_sides AS "both", CASE WHEN a = 0 THEN 'extra' WHEN b = 0 THEN 'missing' WHEN 10 * both_sides >= 7 * a THEN 'implemented' ELSE 'partial' END AS status FROM d)"""


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _document_type() -> str:
    from cairn.functions.text import glob_regex

    name = "string_split(file_path, '/')[-1]"
    options = []
    for kind, (priority, globs, excludes, _) in ingest.DOC_TYPES.items():
        fits = " OR ".join(f"regexp_matches({name}, '{glob_regex(g)}')" for g in globs)
        out = "".join(f" AND NOT regexp_matches({name}, '{glob_regex(g)}')" for g in excludes)
        options.append(f"CASE WHEN ({fits}){out} THEN {{'priority': {priority} + CASE WHEN contains(file_path, '/') THEN 10 ELSE 0 END, 'type': '{kind}'}} END")
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _cut(column: str, most: int) -> str:
    """A text trimmed and cut, with a mark where it was."""
    t = f"regexp_replace(coalesce({column}, ''), '^\\s+|\\s+$', '', 'g')"
    mark = f"CASE WHEN contains({t}, chr(10)) THEN chr(10) ELSE ' ' END || '... (truncated)'"
    return f"CASE WHEN length({t}) <= {most} THEN {t} ELSE regexp_replace(left({t}, {most} - length({mark})), '\\s+$', '') || {mark} END AS {column}"


def oracle_sql() -> dict[str, str]:
    like = lambda q: f"{_LOW.format('name')} LIKE '%{q}%' OR {_LOW.format('qualified_name')} LIKE '%{q}%'"
    found = "SELECT id, codebase_id, name, qualified_name, kind, CASE WHEN name = '{q}' THEN 0 WHEN qualified_name = '{q}' THEN 1 ELSE 2 END::INTEGER AS rank FROM " + _once("symbols")
    find = _top(f"{found.format(q='parse')} WHERE {like('parse')}", "codebase_id", "rank, name, id", 50)
    near = "least(levenshtein(lower(name), 'parserecrd'), levenshtein(lower(qualified_name), 'parserecrd'))"
    sql = {
        "list_codebases": "SELECT id, root_path, name, indexed_at FROM codebases",
        "codebase_by_id": "SELECT id, root_path, name, indexed_at FROM codebases WHERE id = 1",
        "chunk_listing": f"SELECT id, codebase_id, file_path, chunk_key, kind, start_line, end_line FROM {_once('chunks')}",
        "source_file_listing": f"SELECT codebase_id, file_path, language, package_name, loc, symbol_count FROM {_current('source_files')}",
        "compacted_symbols": f"SELECT id, {_cut('signature', 160)}, {_cut('doc_comment', 280)}, {_cut('body_snippet', 240)} FROM {_once('symbols')}",
        "annotated_file_symbols": f"""SELECT s.id, s.codebase_id, s.file_path, s.name, row_number() OVER (PARTITION BY s.codebase_id, s.file_path ORDER BY s.start_line, s.id)::INTEGER AS position, f.id IS NOT NULL AS degraded, f.index_status || ': ' || coalesce(f.status_reason, '') AS reason
            FROM {_once('symbols')} s LEFT JOIN (SELECT * FROM {_current('indexed_files')} WHERE index_status <> 'complete') f ON s.codebase_id = f.codebase_id AND s.file_path = f.file_path""",
        "usage_edges": f"SELECT codebase_id, target, edge_kind, from_ref, to_ref, line, id AS edge_id FROM {_callers('true')}",
        "capability_gaps": f"""WITH p AS (SELECT * FROM (SELECT lag(codebase_id) OVER (PARTITION BY workspace ORDER BY codebase_id) AS first, codebase_id AS second FROM {_MEMBERS}) WHERE first IS NOT NULL),
            a AS (SELECT p.*, domain, name, kind FROM p JOIN {_ABLE} c ON c.codebase_id = first), b AS (SELECT p.*, domain, name, kind FROM p JOIN {_ABLE} c ON c.codebase_id = second)
            SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
        "workspace_members": f"SELECT workspace, codebase_id, name FROM {_MEMBERS}",
        "workspaces": f"SELECT workspace, count(*) AS codebases FROM {_MEMBERS} GROUP BY workspace",
        "symbols_by_kind": f"SELECT codebase_id, kind, count(*) AS symbols FROM {_once('symbols')} GROUP BY ALL",
        "top_files": _top(f"SELECT codebase_id, file_path, count(*) AS symbols FROM {_once('symbols')} GROUP BY ALL", "codebase_id", "symbols DESC, file_path", 10),
        "exported_functions": _top(f"SELECT id, codebase_id, file_path, name, start_line FROM {_once('symbols')} WHERE kind IN ('func', 'method') AND visibility = 'exported'", "codebase_id", "file_path, start_line, id", 20),
        "file_symbols": f"SELECT id, codebase_id, file_path, kind, name, start_line, end_line, row_number() OVER (PARTITION BY codebase_id, file_path ORDER BY start_line, id)::INTEGER AS position FROM {_once('symbols')}",
        "symbols_of_kind": f"SELECT id, codebase_id, file_path, name, start_line FROM {_once('symbols')} WHERE kind = 'struct'",
        "list_capabilities": "SELECT DISTINCT codebase_id, name, kind, file_path FROM symbols",
        "find_symbol": find,
        "find_symbol_of_kind": f"SELECT * FROM ({find}) WHERE kind = 'method'",
        "find_symbol_fuzzy": _top(
            f"SELECT id, codebase_id, name, qualified_name, {near}::INTEGER AS distance FROM {_once('symbols')} WHERE (length(name) BETWEEN 7 AND 11 OR length(qualified_name) BETWEEN 7 AND 11) AND {near} <= 2", "codebase_id", "distance, id", 20
        ),
        "find_symbol_workspace": _top(
            f"SELECT m.codebase_id, s.id, s.name, s.qualified_name, m.workspace, m.name AS codebase_name, CASE WHEN s.name = 'merge' THEN 0 WHEN s.qualified_name = 'merge' THEN 1 ELSE 2 END::INTEGER AS rank FROM (SELECT * FROM {_once('symbols')} WHERE {like('merge')}) s JOIN {_MEMBERS} m ON s.codebase_id = m.codebase_id",
            "workspace",
            "rank, name, id",
            50,
        ),
        "find_symbol_fuzzy_workspace": _top(
            f"SELECT s.id, s.codebase_id, s.name, s.qualified_name, {near.replace('(name)', '(s.name)').replace('(qualified_name)', '(s.qualified_name)')}::INTEGER AS distance, m.workspace, m.name AS codebase_name FROM {_once('symbols')} s JOIN {_MEMBERS} m ON s.codebase_id = m.codebase_id WHERE (length(s.name) BETWEEN 7 AND 11 OR length(s.qualified_name) BETWEEN 7 AND 11) AND distance <= 2",
            "workspace",
            "distance, id",
            20,
        ),
        "find_symbol_or_fuzzy": f"""WITH e AS ({_top(f"{found.format(q='parseRecrd')} WHERE {like('parserecrd')}", "codebase_id", "rank, name, id", 50)}), f AS ({_top(f"SELECT id, codebase_id, name, qualified_name, {near}::INTEGER AS distance FROM {_once('symbols')} WHERE (length(name) BETWEEN 7 AND 11 OR length(qualified_name) BETWEEN 7 AND 11) AND {near} <= 2", "codebase_id", "distance, id", 20)})
            SELECT id, codebase_id, name, qualified_name, position, false AS fuzzy FROM e UNION ALL SELECT id, codebase_id, name, qualified_name, position, true FROM f WHERE codebase_id NOT IN (SELECT codebase_id FROM e)""",
        "file_stats": f"SELECT codebase_id, count(*) AS files, coalesce(sum(loc), 0)::BIGINT AS loc FROM {_current('source_files')} GROUP BY codebase_id",
        "language_breakdown": f"SELECT codebase_id, {_LANGUAGE} AS language, count(*) AS files FROM {_current('source_files')} GROUP BY ALL",
        "package_list": f"SELECT DISTINCT codebase_id, package_name FROM {_current('source_files')} WHERE package_name <> ''",
        "index_status": f"SELECT c.id AS codebase_id, count(k.id) AS chunks, coalesce(max(k.indexed_at), 0) AS last_indexed_at, count(k.id) > 0 AS indexed FROM codebases c LEFT JOIN {_once('chunks')} k ON k.codebase_id = c.id GROUP BY c.id",
        "package_outline": f"""SELECT f.codebase_id, package_name, f.file_path, loc, coalesce(sum(loc) OVER (PARTITION BY f.codebase_id), 0)::BIGINT AS total_loc, coalesce(n, 0)::INTEGER AS symbols, coalesce(o, '') AS outline FROM {_current('source_files')} f
            LEFT JOIN (SELECT codebase_id, file_path, count(*) AS n, string_agg(concat_ws(' ', kind, name), ', ' ORDER BY start_line, id) AS o FROM {_once('symbols')} GROUP BY ALL) s ON f.codebase_id = s.codebase_id AND f.file_path = s.file_path""",
        "project_overview": f"""SELECT coalesce(f.codebase_id, s.codebase_id) AS codebase_id, coalesce(files, 0) AS files, coalesce(loc, 0) AS loc, coalesce(packages, 0) AS packages, coalesce(symbols, 0) AS symbols, coalesce(exported_functions, 0) AS exported_functions
            FROM (SELECT codebase_id, count(*) AS files, coalesce(sum(loc), 0)::BIGINT AS loc, count(DISTINCT nullif(package_name, '')) AS packages FROM {_current('source_files')} GROUP BY codebase_id) f
            FULL JOIN (SELECT codebase_id, count(*) AS symbols, count(*) FILTER (kind IN ('func', 'method') AND visibility = 'exported') AS exported_functions FROM {_once('symbols')} GROUP BY codebase_id) s ON f.codebase_id = s.codebase_id""",
        "compare_capabilities": f"SELECT * FROM {_COMPARED}",
        "capability_summary": f"SELECT first, second, status, count(*) AS domains FROM {_COMPARED} GROUP BY ALL",
        "callers": f"""SELECT codebase_id, target, from_ref, line, id AS edge_id FROM {_callers("edge_kind = 'calls'")}""",
        "embeds": f"""SELECT codebase_id, target, from_ref, line, id AS edge_id FROM {_callers("edge_kind = 'embeds'")}""",
        "usages": f"SELECT codebase_id, target, edge_kind, count(*) AS usages, count(DISTINCT from_ref) AS users FROM {_callers('true')} GROUP BY ALL",
        "callees": f"""SELECT e.codebase_id, e.from_ref, to_ref, line, id AS edge_id FROM {_once("edges", "edge_kind = 'calls'")} e SEMI JOIN symbols s ON e.codebase_id = s.codebase_id AND e.from_ref = s.qualified_name WHERE e.from_ref <> ''""",
        "imports": f"""SELECT codebase_id, from_ref, to_ref, line, row_number() OVER (PARTITION BY codebase_id, from_ref ORDER BY line, id)::INTEGER AS position FROM {_once("edges", "edge_kind = 'imports'")}""",
        "dependents": f"""SELECT e.codebase_id, to_ref, from_ref, line, id AS edge_id FROM {_once("edges", "edge_kind = 'imports'")} e SEMI JOIN source_files s ON e.codebase_id = s.codebase_id AND e.to_ref = s.file_path""",
        "unresolved_imports": f"""SELECT id AS edge_id, codebase_id, from_ref, to_ref, line FROM {_once("edges", "edge_kind = 'imports' AND resolved = 0")}""",
        "callers_workspace": f"""SELECT workspace, target, count(*) AS calls, count(DISTINCT c.codebase_id) AS codebases FROM {_callers("edge_kind = 'calls'")} c JOIN {_MEMBERS} m ON c.codebase_id = m.codebase_id GROUP BY ALL""",
        "blast_radius": f"""WITH s AS (SELECT DISTINCT codebase_id, qualified_name AS target, file_path FROM symbols WHERE qualified_name <> ''),
            a AS (SELECT codebase_id, target, count(*) AS n, arg_min(from_ref, id) AS f FROM {_callers("edge_kind = 'calls'")} GROUP BY ALL),
            b AS (SELECT codebase_id, from_ref AS target, count(*) AS n, arg_min(to_ref, id) AS f FROM {_once("edges", "edge_kind = 'calls'")} GROUP BY ALL),
            d AS (SELECT codebase_id, to_ref AS file_path, count(*) AS n, arg_min(from_ref, id) AS f FROM {_once("edges", "edge_kind = 'imports'")} GROUP BY ALL)
            SELECT s.codebase_id, s.file_path, s.target, coalesce(a.n, 0) AS callers, a.f AS first_callers, coalesce(b.n, 0) AS callees, b.f AS first_callees,
                CASE WHEN k.file_path IS NULL THEN 0 ELSE coalesce(d.n, 0) END AS dependents, CASE WHEN k.file_path IS NOT NULL THEN d.f END AS first_dependents
            FROM s LEFT JOIN a ON s.codebase_id = a.codebase_id AND s.target = a.target LEFT JOIN b ON s.codebase_id = b.codebase_id AND s.target = b.target
            LEFT JOIN d ON s.codebase_id = d.codebase_id AND s.file_path = d.file_path LEFT JOIN (SELECT DISTINCT codebase_id, file_path FROM source_files) k ON s.codebase_id = k.codebase_id AND s.file_path = k.file_path""",
        "cross_links": f"""WITH o AS ({_top(f"SELECT * FROM {_once('edges', 'target_codebase_id IS NOT NULL AND target_codebase_id <> codebase_id')}", "codebase_id, from_ref", "id", 10)}),
            c AS ({_top(f"SELECT * FROM {_once('edges', "edge_kind = 'calls'")}", "codebase_id, to_ref", "id", 5)}),
            p AS (SELECT DISTINCT a.codebase_id, b.codebase_id AS other FROM {_MEMBERS} a JOIN {_MEMBERS} b ON a.workspace = b.workspace AND a.codebase_id <> b.codebase_id),
            k AS (SELECT DISTINCT codebase_id, name FROM symbols)
            SELECT codebase_id, from_ref AS name, 'out' AS direction, id AS edge_id, target_codebase_id AS other_codebase_id, to_ref AS other_ref, edge_kind FROM o
            UNION ALL SELECT p.codebase_id, c.to_ref, 'in', c.id, c.codebase_id, c.from_ref, c.edge_kind FROM c JOIN p ON c.codebase_id = p.other JOIN k ON k.codebase_id = p.codebase_id AND k.name = c.to_ref""",
        "blast_entries": f"""WITH s AS (SELECT DISTINCT codebase_id, qualified_name AS target, file_path FROM symbols WHERE qualified_name <> '')
            SELECT s.codebase_id, s.target, s.file_path, 'callers' AS role, c.id AS edge_id, c.from_ref AS ref FROM s JOIN {_callers("edge_kind = 'calls'")} c ON s.codebase_id = c.codebase_id AND s.target = c.target
            UNION ALL SELECT s.codebase_id, s.target, s.file_path, 'callees', e.id, e.to_ref FROM s JOIN {_once("edges", "edge_kind = 'calls'")} e ON s.codebase_id = e.codebase_id AND s.target = e.from_ref
            UNION ALL SELECT s.codebase_id, s.target, s.file_path, 'dependents', e.id, e.from_ref FROM s JOIN {_once("edges", "edge_kind = 'imports'")} e ON s.codebase_id = e.codebase_id AND s.file_path = e.to_ref
                SEMI JOIN source_files f ON s.codebase_id = f.codebase_id AND s.file_path = f.file_path""",
        "usages_workspace": f"SELECT workspace, target, edge_kind, count(*) AS usages, count(DISTINCT c.codebase_id) AS codebases FROM {_callers('true')} c JOIN {_MEMBERS} m ON c.codebase_id = m.codebase_id GROUP BY ALL",
        "languages": f"""SELECT codebase_id, language, count(*) AS files, sum(n)::BIGINT AS lines FROM (SELECT codebase_id, file_path, sum(len(string_split(snippet, chr(10))))::BIGINT AS n,
            CASE regexp_extract(lower(file_path), '(\\.[^./]*)$', 1) {" ".join(f"WHEN '{e}' THEN '{n}'" for e, n in ingest.LANGUAGES.items())} ELSE 'text' END AS language FROM {_once("chunks")} GROUP BY codebase_id, file_path) GROUP BY ALL""",
        "run_counters": f"""SELECT codebase_id, count(*) AS total_files, count(*) FILTER (state IN ('changed', 'added')) AS files_indexed, count(*) FILTER (state = 'unchanged') AS files_skipped, count(*) FILTER (state = 'changed') AS files_changed,
            count(*) FILTER (state = 'added') AS files_added, count(*) FILTER (state = 'removed') AS files_removed FROM {_DELTA} GROUP BY codebase_id""",
        "zero_symbol_files": f"SELECT codebase_id, count(*) AS files, count(*) FILTER (coalesce(symbol_count, 0) = 0) AS zero_symbols FROM {_current('source_files')} GROUP BY codebase_id",
        "index_throughput": f"SELECT codebase_id, CASE WHEN sum(duration_ms) > 0 THEN round(coalesce(sum(files_indexed), 0) * 1000 / sum(duration_ms), 6) ELSE 0.0 END AS files_per_second, CASE WHEN sum(duration_ms) > 0 THEN round(coalesce(sum(chunks_indexed), 0) * 1000 / sum(duration_ms), 6) ELSE 0.0 END AS chunks_per_second FROM {_once('metric_index_runs')} GROUP BY codebase_id",
        "search_memory": f"SELECT id, codebase_id, file_path, name FROM {_once('chunks')} WHERE contains(lower(snippet), 'ctx context.context') OR contains(lower(name), 'ctx context.context') ORDER BY id LIMIT 20",
        "codebase_context": f"""WITH d AS (SELECT * FROM (SELECT codebase_id, file_path, d.type AS doc_type, d.priority::INTEGER AS priority, row_number() OVER (PARTITION BY codebase_id, d.type ORDER BY file_path) AS k
                FROM (SELECT codebase_id, file_path, {_document_type()} AS d FROM (SELECT DISTINCT codebase_id, file_path FROM documents WHERE file_path IS NOT NULL)) WHERE d IS NOT NULL) WHERE doc_type <> 'general' OR k <= 5),
            o AS (SELECT d.* FROM d LEFT JOIN {_POLICIES} p ON d.codebase_id = p.codebase_id WHERE NOT coalesce(p.closed_source, false) OR doc_type IN ('readme', 'contributing', 'agent-instructions')),
            t AS (SELECT codebase_id, file_path, regexp_replace(coalesce(arg_min(text, doc_id) , ''), '^\\s+|\\s+$', '', 'g') AS text FROM documents GROUP BY ALL),
            v AS (SELECT c.id AS codebase_id, (SELECT count(*) FROM {_current("source_files")} f WHERE f.codebase_id = c.id) AS files, (SELECT coalesce(sum(loc), 0)::BIGINT FROM {_current("source_files")} f WHERE f.codebase_id = c.id) AS loc,
                (SELECT count(DISTINCT s.id) FROM symbols s WHERE s.codebase_id = c.id) AS symbols FROM codebases c WHERE c.id NOT IN (SELECT codebase_id FROM o))
            SELECT o.codebase_id, o.file_path, doc_type, priority, CASE WHEN length(text) <= 4000 THEN text ELSE regexp_replace(left(text, 4000 - length(m)), '\\s+$', '') || m END AS content, false AS fallback
            FROM o JOIN (SELECT *, CASE WHEN contains(text, chr(10)) THEN chr(10) ELSE ' ' END || '... (truncated)' AS m FROM t) t ON o.codebase_id = t.codebase_id AND o.file_path = t.file_path
            UNION ALL SELECT codebase_id, NULL, NULL, NULL, files || ' files, ' || loc || ' lines, ' || symbols || ' symbols', true FROM v""",
        "cross_repo_resolution": f"""WITH o AS (SELECT e.id AS edge_id, e.codebase_id, e.to_ref, m.workspace FROM {_once("edges", "edge_kind = 'imports' AND resolved = 0")} e JOIN {_MEMBERS} m ON e.codebase_id = m.codebase_id),
            n AS (SELECT s.*, m.workspace FROM (SELECT id, codebase_id, name, name AS ref, 0 AS rank FROM {_once("symbols")} UNION ALL SELECT id, codebase_id, name, qualified_name, 1 FROM {_once("symbols")} WHERE qualified_name <> name) s JOIN {_MEMBERS} m ON s.codebase_id = m.codebase_id),
            r AS (SELECT o.edge_id, o.codebase_id, o.to_ref, o.workspace, n.codebase_id AS sibling, n.id AS symbol_id, row_number() OVER (PARTITION BY edge_id, o.workspace ORDER BY rank, n.name, n.id) AS k FROM o JOIN n ON o.workspace = n.workspace AND o.to_ref = n.ref AND n.codebase_id <> o.codebase_id)
            SELECT edge_id, codebase_id, to_ref, max_by(sibling, workspace) AS target_codebase_id, max_by(symbol_id, workspace) AS symbol_id FROM r WHERE k = 1 GROUP BY ALL""",
        "term_statistics": f"SELECT term, count(DISTINCT id) AS chunks, count(*) AS occurrences FROM (SELECT id, unnest(list_concat(list_concat({_words('snippet')}, {_words('name')}), {_words('file_path')})) AS term FROM {_once('chunks')}) GROUP BY term",
        "manifest_delta": f"SELECT * FROM {_DELTA}",
        "delta_summary": f"SELECT codebase_id, state, count(*) AS files FROM {_DELTA} GROUP BY ALL",
        "orphan_chunks": f"SELECT c.codebase_id, count(*) AS orphans FROM {_once('chunks')} c ANTI JOIN indexed_files f ON c.codebase_id = f.codebase_id AND c.file_hash = f.file_hash GROUP BY c.codebase_id",
        "upserted_files": f"SELECT codebase_id, file_path, file_hash FROM {_current('source_files')} UNION ALL SELECT b.codebase_id, b.file_path, b.file_hash FROM {_current('indexed_files')} b ANTI JOIN source_files a ON a.codebase_id = b.codebase_id AND a.file_path = b.file_path",
        "edges_after_removal": f"""SELECT e.codebase_id, edge_kind, count(*) AS edges FROM {_once("edges")} e ANTI JOIN (SELECT * FROM {_DELTA} WHERE state = 'removed') r ON e.codebase_id = r.codebase_id AND (e.from_ref = r.file_path OR starts_with(e.from_ref, r.file_path || ':')) GROUP BY ALL""",
        "policies": f"SELECT * FROM {_POLICIES}",
        "redacted_symbols": f"""SELECT id, s.codebase_id, name, coalesce(closed_source OR source_stripped, false) AS redacted, CASE WHEN closed_source OR source_stripped THEN '' ELSE coalesce(signature, '') END AS signature,
            CASE WHEN closed_source OR source_stripped THEN '' ELSE coalesce(doc_comment, '') END AS doc_comment, CASE WHEN closed_source OR source_stripped THEN '' ELSE coalesce(body_snippet, '') END AS body_snippet
            FROM {_once('symbols')} s LEFT JOIN {_POLICIES} p ON s.codebase_id = p.codebase_id""",
        "stripped_export_sizes": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, {strip} AS stripped, codebase_id, count(*) AS rows, {chars if strip == 'false' else '0'}::BIGINT AS source_chars FROM {_once(t)} GROUP BY codebase_id"
            for t, chars in (("chunks", "sum(coalesce(length(signature), 0) + coalesce(length(snippet), 0))"), ("symbols", "sum(coalesce(length(signature), 0) + coalesce(length(doc_comment), 0) + coalesce(length(body_snippet), 0))"))
            for strip in ("false", "true")
        ),
        "tool_stats": f"""SELECT tool, count(*) AS calls, floor(sum(duration_ms) / count(*))::BIGINT AS avg_ms, count(*) FILTER (is_error) AS errors, max(duration_ms) FILTER (r = greatest(floor(n * 95 / 100), 1)) AS p95_ms
            FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) AS r, count(*) OVER (PARTITION BY tool) AS n FROM {_CALLS}) GROUP BY tool""",
        "tool_stats_window": f"""SELECT tool, n AS calls, duration_ms AS p95_ms FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY duration_ms, id) AS r, count(*) OVER (PARTITION BY tool) AS n
            FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY recorded_at DESC, id DESC) AS k FROM {_CALLS}) WHERE k <= 1000) WHERE r = (95 * n + 99) // 100""",
        "slow_log": f"SELECT * FROM {_CALLS} WHERE duration_ms >= 500 ORDER BY recorded_at DESC, id DESC LIMIT 20",
        "recent_errors": f"SELECT count(*) FILTER (recorded_at >= (SELECT max(recorded_at) FROM {_CALLS}) - 60000) AS errors_last_minute FROM (SELECT * FROM {_CALLS} WHERE is_error ORDER BY recorded_at DESC, id DESC LIMIT 120)",
        "index_run_stats": f"SELECT codebase_id, count(*) AS runs, sum(files_indexed)::BIGINT AS files, sum(chunks_indexed)::BIGINT AS chunks, coalesce(floor(sum(duration_ms) / count(duration_ms)), 0)::BIGINT AS avg_ms FROM {_once('metric_index_runs')} GROUP BY codebase_id",
        "parse_health": f"""SELECT codebase_id, count(*) AS files, count(*) FILTER (index_status = 'complete') AS complete, count(*) FILTER (index_status = 'text_fallback') AS text_fallbacks, count(*) FILTER (index_status = 'partial') AS partial,
            count(*) FILTER (contains(status_reason, 'panic')) AS panics, round(count(*) FILTER (coalesce(index_status, '') <> 'complete') / count(*), 6) AS degraded_share FROM {_current('indexed_files')} GROUP BY codebase_id""",
        "graph_density": f"""SELECT coalesce(e.codebase_id, s.codebase_id) AS codebase_id, coalesce(edges, 0) AS edges, coalesce(symbols, 0) AS symbols, CASE WHEN coalesce(symbols, 0) > 0 THEN round(coalesce(edges, 0) / symbols, 6) ELSE 0.0 END AS density
            FROM (SELECT codebase_id, count(*) AS edges FROM {_once('edges')} GROUP BY 1) e FULL JOIN (SELECT codebase_id, count(*) AS symbols FROM {_once('symbols')} GROUP BY 1) s ON e.codebase_id = s.codebase_id""",
        "line_chunks": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, min(i)::INTEGER AS start_line, max(i)::INTEGER AS end_line, md5(string_agg(line, chr(10) ORDER BY i)) AS md5 FROM l GROUP BY doc_id, (i - 1) // 50 HAVING NOT regexp_full_match(string_agg(line, chr(10) ORDER BY i), '\\s*')""",
        "markdown_sections": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
            s AS (SELECT *, sum(CASE WHEN i > 1 AND starts_with(ltrim(line, ' '), '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS section FROM l)
            SELECT doc_id, section, min(i)::INTEGER AS start_line, max(i)::INTEGER AS end_line, md5(string_agg(line, chr(10) ORDER BY i)) AS md5 FROM s GROUP BY doc_id, section HAVING NOT regexp_full_match(string_agg(line, chr(10) ORDER BY i), '\\s*')""",
        "path_rules": f"""SELECT codebase_id, file_path, list_has_any(string_split(lower(file_path), '/'), {_list(ingest.IGNORED_DIRS)}) OR list_contains({_list(ingest.IGNORED_NAMES)}, string_split(lower(file_path), '/')[-1]) OR regexp_matches(lower(file_path), '\\.(log|tmp)$') AS ignored,
            list_contains({_list(ingest.CODE)}, regexp_extract(lower(file_path), '(\\.[^./]*)$', 1)) AS code,
            regexp_matches(file_path, '(_test\\.go|\\.test\\.ts|\\.test\\.js|\\.spec\\.ts|\\.spec\\.js)$') OR list_contains(string_split(file_path, '/'), '__tests__') AS test,
            NOT list_contains({_list(ingest.NOT_CODE)}, regexp_extract(lower(file_path), '(\\.[^./]*)$', 1)) AND NOT list_has_any(string_split(lower(file_path), '/'), {_list(ingest.NOT_CODE_DIRS)}) AS implementation
            FROM (SELECT DISTINCT codebase_id, file_path FROM chunks)""",
        "orientation_documents": f"""SELECT codebase_id, file_path, d.type AS doc_type, d.priority::INTEGER AS priority FROM (SELECT *, row_number() OVER (PARTITION BY codebase_id, d.type ORDER BY file_path) AS k
            FROM (SELECT codebase_id, file_path, {_document_type()} AS d FROM (SELECT DISTINCT codebase_id, file_path FROM documents WHERE file_path IS NOT NULL)) WHERE d IS NOT NULL) WHERE d.type <> 'general' OR k <= 5""",
        "assembled_files": f"SELECT codebase_id, file_path, count(*)::INTEGER AS chunks, length(string_agg(snippet, chr(10) ORDER BY start_line, id))::INTEGER AS chars, sha256(string_agg(snippet, chr(10) ORDER BY start_line, id)) AS sha256 FROM {_once('chunks')} GROUP BY ALL",
        "conflicted_files": "SELECT codebase_id, file_path FROM chunks GROUP BY ALL HAVING bool_or(contains(snippet, '<<<<<<<')) AND bool_or(contains(snippet, '=======')) AND bool_or(contains(snippet, '>>>>>>>'))",
        "debounce_sessions": """WITH e AS (SELECT user_id AS path, event_type AS op, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS begins FROM events),
            s AS (SELECT *, sum(begins) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM e)
            SELECT path, count(*) AS events, max(epoch_us(ts)) AS last_at, arg_max(op, {'a': ts, 'b': event_id}) AS op FROM s GROUP BY path, burst""",
        "p5_orphans": _ORPHANS,
        "p5_found": f"SELECT DISTINCT source_table, row_id FROM ({_ORPHANS})",
        "p5_report": f"SELECT source_table, period, reason, count(*) AS orphans FROM ({_ORPHANS}) GROUP BY ALL",
    }
    sql["package_outline_prefix"] = sql["package_outline"] + " WHERE starts_with(f.file_path, 'pkg/')"
    searches = _search_sql()
    states = f"(SELECT * FROM {_current('indexed_files')} WHERE index_status <> 'complete')"
    sql["degraded_hits"] = f"SELECT h.id, h.codebase_id, h.file_path, index_status || ': ' || coalesce(status_reason, '') AS reason FROM ({searches['search_single']}) h JOIN {states} f ON h.codebase_id = f.codebase_id AND h.file_path = f.file_path"
    sql["search_annotated"] = f"SELECT h.id, h.codebase_id, h.file_path, f.id IS NOT NULL AS degraded, index_status || ': ' || coalesce(status_reason, '') AS reason FROM ({searches['search_single']}) h LEFT JOIN {states} f ON h.codebase_id = f.codebase_id AND h.file_path = f.file_path"
    candidates = _candidates(searches["search_and"], ["merge", "bucket"])
    sql["locate_issue"], sql["issue_impact"] = _located(candidates), f"WITH t AS ({candidates}), {_IMPACT} SELECT codebase_id, file_path, name, role, edge_id, ref FROM i"
    # "the", "and" are no terms, "when", "would" are; as a query, all words must occur
    words = ["when", "would", "the", "journal", "and", "ledger"]
    hits = _bm25([f"@[i] = '{w}'" for w in words], " AND ".join(f"f{i} > 0" for i in range(len(words))))
    sql["locate_sentence"] = _located(_candidates(hits, ["when", "would", "journal", "ledger"]))
    sql["search_compacted"] = _compacted(searches["search_and"])
    tools, window, runs = sql["tool_stats"], sql["tool_stats_window"], _once("metric_index_runs")
    sql["server_stats"] = f"""WITH t AS (SELECT a.*, w.p95_ms AS p95 FROM ({tools}) a JOIN ({window}) w ON a.tool = w.tool), r AS (SELECT * FROM {runs}), p AS (SELECT * FROM {_current("indexed_files")})
        SELECT 'tools' AS section, tool || '.calls' AS name, calls AS value FROM t UNION ALL SELECT 'tools', tool || '.avg_ms', avg_ms FROM t UNION ALL SELECT 'tools', tool || '.p95', p95 FROM t UNION ALL SELECT 'tools', tool || '.errors', errors FROM t
        UNION ALL SELECT 'parse', 'total_files', count(*) FROM p UNION ALL SELECT 'parse', 'complete', count(*) FILTER (index_status = 'complete') FROM p UNION ALL SELECT 'parse', 'degraded', count(*) FILTER (index_status IN ('text_fallback', 'partial')) FROM p
        UNION ALL SELECT 'index', 'run_count', count(*) FROM r UNION ALL SELECT 'index', 'files_indexed', sum(files_indexed)::BIGINT FROM r UNION ALL SELECT 'index', 'chunks_indexed', sum(chunks_indexed)::BIGINT FROM r
        UNION ALL SELECT 'index', 'avg_duration_ms', coalesce(sum(duration_ms) // count(*), 0)::BIGINT FROM r UNION ALL SELECT 'graph', 'total_symbols', count(DISTINCT id) FROM symbols UNION ALL SELECT 'graph', 'total_edges', count(DISTINCT id) FROM edges
        UNION ALL SELECT 'server', 'active_codebases', count(*) FROM codebases UNION ALL SELECT 'server', 'total_requests', coalesce(sum(calls), 0)::BIGINT FROM t UNION ALL SELECT 'server', 'errors_last_minute', errors_last_minute FROM ({sql["recent_errors"]})"""
    sql["p6_found"], sql["p6_wide"] = cells_sql()
    return sql | searches


def _compacted(hits: str) -> str:
    """The first twenty matches with their snippet cut to 240 characters."""
    mark = "CASE WHEN contains(t, chr(10)) THEN chr(10) ELSE ' ' END || '... (truncated)'"
    return f"""SELECT id, codebase_id, file_path, name, kind, start_line, end_line, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(left(t, 240 - length({mark})), '\\s+$', '') || {mark} END AS snippet, bm25_score
        FROM (SELECT h.id, h.codebase_id, h.file_path, k.name, k.kind, k.start_line, k.end_line, regexp_replace(k.snippet, '^\\s+|\\s+$', '', 'g') AS t, h.bm25_score FROM ({hits}) h JOIN {_once("chunks")} k ON h.id = k.id ORDER BY h.bm25_score, h.id LIMIT 20)"""


# Written out by hand: what counts as no implementation.
_NO_CODE = "['.md', '.markdown', '.yaml', '.yml', '.json', '.css', '.html', '.xml', '.txt']"
_NO_CODE_DIRS = "(^|/)(okf|docs|doc|\\.kiro|kiro|spec|specs)(/|$)"


def _candidates(hits: str, terms: list[str]) -> str:
    """The likeliest places of an issue over the matches of its query."""
    path, name = "lower(file_path)", "lower(concat_ws(' ', name, file_path))"
    bonus = f"""CASE WHEN lower(kind) IN ('func', 'method') THEN 0.15 WHEN lower(kind) IN ('type', 'interface') THEN 0.06 WHEN lower(kind) IN ('const', 'var', 'field', 'package') THEN -0.15 ELSE 0 END
        + CASE WHEN contains({path}, '.sql.go') OR contains({path}, '_sql.go') THEN -0.2 WHEN contains({path}, '/db/') THEN -0.08 ELSE 0 END
        + CASE WHEN regexp_matches({path}, '/llm/|/handler|/router|/api/|/server/') THEN 0.08 WHEN regexp_matches({path}, '/internal/|/cmd/') THEN 0.03 ELSE 0 END"""
    met = "(" + " + ".join(f"CASE WHEN contains({name}, '{t}') THEN 1 ELSE 0 END" for t in terms) + ")"
    hits = hits.replace("round(-(", "(-(").replace("), 6) AS bm25_score", ")) AS bm25")
    return f"""SELECT codebase_id, file_path, name, kind, start_line, end_line, confidence FROM (WITH c AS (SELECT h.id, h.codebase_id, h.file_path, bm25, k.kind, k.name, k.start_line, k.end_line FROM ({hits}) h JOIN {_once("chunks")} k ON h.id = k.id),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codebase_id ORDER BY bm25, id) AS r FROM c) WHERE r <= 50),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codebase_id, file_path, name ORDER BY bm25, id) AS q FROM b
            WHERE NOT regexp_matches(file_path, '(_test\\.go|\\.test\\.ts|\\.test\\.js|\\.spec\\.ts|\\.spec\\.js)$|(^|/)__tests__(/|$)')
            AND NOT regexp_matches(lower(file_path), '{_NO_CODE_DIRS}')
            AND NOT list_contains({_NO_CODE}, regexp_extract(lower(file_path), '(\\.[^./]*)$', 1)) AND coalesce(lower(kind), '') <> 'import') WHERE q = 1),
        m AS (SELECT max(abs(bm25)) AS most FROM b),
        g AS (SELECT f.*, greatest(least(greatest(least(CASE WHEN most > 0 THEN -bm25 / most ELSE 0 END, 1), 0) + {bonus}, 1), 0) AS raised FROM f, m),
        s AS (SELECT g.*, round(greatest(least(raised + 0.08 * {met} / {len(terms)}, 1), 0), 6)::DOUBLE AS confidence FROM g)
        SELECT * FROM s WHERE confidence >= 0.1 ORDER BY confidence DESC, codebase_id, file_path, name LIMIT 10)"""


#: Edges around the places t: relation i.
_IMPACT = f"""c AS (SELECT * FROM {_once("edges", "edge_kind = 'calls'")}),
    o AS (SELECT * FROM (SELECT t.codebase_id, t.file_path, t.name, e.id, e.to_ref, row_number() OVER (PARTITION BY t.codebase_id, t.file_path, t.name ORDER BY e.id) AS k FROM t JOIN {_once("edges")} e ON e.codebase_id = t.codebase_id AND e.from_ref = t.name AND e.target_codebase_id IS NOT NULL) WHERE k <= 10),
    p AS (SELECT DISTINCT a.codebase_id, b.codebase_id AS other FROM {_MEMBERS} a JOIN {_MEMBERS} b ON a.workspace = b.workspace AND a.codebase_id <> b.codebase_id),
    n AS (SELECT * FROM (SELECT t.codebase_id, t.file_path, t.name, c.id, c.from_ref, row_number() OVER (PARTITION BY t.codebase_id, t.file_path, t.name, p.other ORDER BY c.id) AS k FROM t JOIN p ON t.codebase_id = p.codebase_id JOIN c ON c.codebase_id = p.other AND c.to_ref = t.name) WHERE k <= 5),
    i AS (SELECT t.codebase_id, t.file_path, t.name, 'callers' AS role, c.id AS edge_id, c.from_ref AS ref FROM t JOIN c ON c.codebase_id = t.codebase_id AND (c.to_ref = t.name OR ends_with({_LOW.format("c.to_ref")}, '.' || {_LOW.format("t.name")}))
        UNION ALL SELECT t.codebase_id, t.file_path, t.name, 'callees', c.id, c.to_ref FROM t JOIN c ON c.codebase_id = t.codebase_id AND c.from_ref = t.name
        UNION ALL SELECT t.codebase_id, t.file_path, t.name, 'dependents', e.id, e.from_ref FROM t JOIN {_once("edges", "edge_kind = 'imports'")} e ON e.codebase_id = t.codebase_id AND e.to_ref = t.file_path
        UNION ALL SELECT codebase_id, file_path, name, 'outbound', id, to_ref FROM o UNION ALL SELECT codebase_id, file_path, name, 'inbound', id, from_ref FROM n)"""


def _located(candidates: str) -> str:
    """The places with what surrounds them, counted."""
    counts = ", ".join(f"coalesce(count(*) FILTER (role = '{role}'), 0) AS {role}" for role in ("callers", "callees", "dependents", "outbound", "inbound"))
    return f"""WITH t AS ({candidates}), {_IMPACT},
        k AS (SELECT * FROM (SELECT c.id, c.codebase_id, c.file_path, c.name, c.start_line, c.end_line, row_number() OVER (PARTITION BY codebase_id, file_path, name ORDER BY start_line, id) AS r FROM {_once("chunks")} c SEMI JOIN t ON c.codebase_id = t.codebase_id AND c.file_path = t.file_path AND c.name = t.name) WHERE r <= 5),
        l AS (SELECT codebase_id, file_path, name, string_agg(start_line || '-' || end_line, ',' ORDER BY r) AS chunks FROM k GROUP BY ALL),
        q AS (SELECT codebase_id, file_path, name, {counts} FROM i GROUP BY ALL)
        SELECT t.*, chunks, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(dependents, 0) AS dependents, coalesce(outbound, 0) AS outbound, coalesce(inbound, 0) AS inbound
        FROM t LEFT JOIN l ON t.codebase_id = l.codebase_id AND t.file_path = l.file_path AND t.name = l.name LEFT JOIN q ON t.codebase_id = q.codebase_id AND t.file_path = q.file_path AND t.name = q.name"""


_ORPHANS = """SELECT DISTINCT source_table, row_id, reason, period FROM (
    SELECT 'edges' AS source_table, id AS row_id, 'codebase_id' AS reason, indexed_at AS s, codebase_id IS NOT NULL AND codebase_id NOT IN (SELECT id FROM codebases) AS bad FROM edges
    UNION ALL SELECT 'edges', id, 'target_codebase_id', indexed_at, target_codebase_id IS NOT NULL AND target_codebase_id NOT IN (SELECT id FROM codebases) FROM edges
    UNION ALL SELECT 'metric_index_runs', id, 'codebase_id', recorded_at // 1000, codebase_id IS NOT NULL AND codebase_id NOT IN (SELECT id FROM codebases) FROM metric_index_runs
    UNION ALL SELECT 'edges', e.id, 'to_ref', indexed_at, resolved = 1 AND k.ref IS NULL FROM edges e LEFT JOIN (
        SELECT 'symbol' AS kind, codebase_id, name AS ref FROM symbols UNION SELECT 'symbol', codebase_id, qualified_name FROM symbols UNION SELECT 'file', codebase_id, file_path FROM source_files
    ) k ON e.to_kind = k.kind AND coalesce(target_codebase_id, e.codebase_id) = k.codebase_id AND e.to_ref = k.ref
    ), LATERAL (SELECT date_trunc('month', to_timestamp(s) AT TIME ZONE 'UTC')::DATE AS period) WHERE bad"""


#: The attributes of the wide table by type, as the tables declare them.
ATTRIBUTES = {
    "boolean": "closed_source source_stripped archived",
    "integer": "contributor_count retention_days open_issue_count",
    "double": "test_coverage size_mb churn_ratio",
    "date": "first_commit_on next_review_on",
    "string": "default_branch owner_team license_name build_tool release_channel",
}


def cells_sql() -> tuple[str, str]:
    """p6_found and p6_wide: the cells of the wide table that hold a value, and the table."""
    from cairn.operators.wide import FALSE, NO_VALUE, TRUE

    bare = "regexp_replace(value, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')"
    marks = (",", "_", " ", "''")
    grouped = " OR ".join(f"regexp_full_match(v, '[+-]?\\d{{1,3}}({m}\\d{{3}})+(\\.\\d*)?([eE][+-]?\\d+)?')" for m in marks)
    number = f"CASE WHEN {grouped} THEN regexp_replace(v, '[,_ '']', '', 'g') ELSE v END"
    tail = "([T ]\\d{1,2}:\\d{2}(:\\d{2}([.,]\\d+)?)?\\s*(Z|UTC|GMT|[+-]\\d{2}:?\\d{2})?)?"

    def dated(pattern: str, *forms: str, end: str = tail) -> str:
        read = ", ".join(f"try_strptime(regexp_extract(v, '^({pattern})', 1), '{f}')" for f in forms)
        return f"CASE WHEN regexp_full_match(v, '({pattern}){end}') THEN coalesce({read}, NULL)::DATE END"

    month = "'^(\\d{1,2}[ -][A-Za-z]{3,9}[ -]\\d{4}|[A-Za-z]{3,9} \\d{1,2} \\d{4})$'"
    bare_date = "replace(replace(v, '.', ''), ',', '')"
    date = ", ".join(
        [
            dated("\\d{4}-\\d{1,2}-\\d{1,2}", "%Y-%m-%d"),
            dated("\\d{4}/\\d{1,2}/\\d{1,2}", "%Y/%m/%d"),
            dated("\\d{4}\\.\\d{1,2}\\.\\d{1,2}", "%Y.%m.%d"),
            dated("\\d{8}", "%Y%m%d", end=""),
            dated("\\d{1,2}/\\d{1,2}/\\d{4}", "%d/%m/%Y", "%m/%d/%Y"),
            dated("\\d{1,2}\\.\\d{1,2}\\.\\d{4}", "%d.%m.%Y"),
            dated("\\d{1,2}-\\d{1,2}-\\d{4}", "%d-%m-%Y"),
            f"CASE WHEN regexp_matches({bare_date}, {month}) THEN try_strptime(replace({bare_date}, '-', ' '), ['%d %b %Y', '%d %B %Y', '%b %d %Y', '%B %d %Y'])::DATE END",
            "CASE WHEN regexp_full_match(v, '\\d{9,10}') THEN (to_timestamp(v::BIGINT) AT TIME ZONE 'UTC')::DATE WHEN regexp_full_match(v, '\\d{12,13}') THEN (to_timestamp(v::BIGINT // 1000) AT TIME ZONE 'UTC')::DATE END",
        ]
    )
    dates = f"coalesce({date}) IS NOT NULL"
    reads = f"""CASE t WHEN 'boolean' THEN lower(v) IN ({", ".join(f"'{x}'" for x in (*TRUE, *FALSE))})
        WHEN 'integer' THEN regexp_full_match(n, '[+-]?\\d+(\\.0*)?') AND try_cast(regexp_replace(n, '\\.0*$', '') AS BIGINT) IS NOT NULL
        WHEN 'double' THEN regexp_full_match(n, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') AND isfinite(try_cast(n AS DOUBLE))
        WHEN 'date' THEN {dates} ELSE true END"""
    absent = ", ".join(f"'{x}'" for x in NO_VALUE)
    plain = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    cells = f"""(SELECT * FROM (SELECT *, {number} AS n FROM (
        SELECT m.codebase_id, a.attribute, a.value_type AS t, {bare} AS v FROM codebase_meta m JOIN meta_attributes a ON {plain.format("m.key")} = {plain.format("a.attribute")}
        WHERE m.codebase_id IS NOT NULL AND m.value IS NOT NULL)) WHERE lower(v) NOT IN ({absent}) AND coalesce({reads}, false))"""
    # of several readable values the least text
    values = {
        "boolean": f"min(CASE WHEN @ THEN lower(v) IN ({', '.join(f"'{x}'" for x in TRUE)}) END)",
        "integer": "min(CASE WHEN @ THEN try_cast(regexp_replace(n, '\\.0*$', '') AS BIGINT)::VARCHAR END)::BIGINT",
        "double": "min(CASE WHEN @ THEN try_cast(n AS DOUBLE)::VARCHAR END)::DOUBLE",
        "date": f"min(CASE WHEN @ THEN coalesce({date}) END)",
        "string": "min(CASE WHEN @ THEN v END)",
    }
    columns = ", ".join(values[kind].replace("@", f"attribute = '{name}'") + f" AS {name}" for kind, names in ATTRIBUTES.items() for name in names.split())
    wide = f"SELECT e.codebase_id, c.* EXCLUDE (codebase_id) FROM (SELECT DISTINCT codebase_id FROM codebase_meta WHERE codebase_id IS NOT NULL) e LEFT JOIN (SELECT codebase_id, {columns} FROM {cells} GROUP BY codebase_id) c ON e.codebase_id = c.codebase_id"
    return f"SELECT DISTINCT codebase_id, attribute FROM {cells}", wide

import shutil

import pytest
from pyspark.sql import functions as F

from cairn.operators import graph, ingest, manifest, metrics
from cairn.operators.store import Store, feed
from cairn.sources.index import Index
from cairn.streaming import debounce


def test_delta(spark):
    schema = "codebase_id long, file_path string, file_hash string"
    h = "a" * 64
    now = spark.createDataFrame([(1, "same", h), (1, "new", h), (1, "other", h), (1, "old", "abc"), (1, "blank", h)], schema)
    then = spark.createDataFrame([(1, "same", h), (1, "gone", h), (1, "other", "b" * 64), (1, "old", "abc"), (1, "blank", None)], schema)
    assert {r.file_path: r.state for r in manifest.delta(now, then).collect()} == {"same": "unchanged", "new": "added", "gone": "removed", "other": "changed", "old": "changed", "blank": "changed"}
    assert manifest.delta(now.limit(0), then.limit(0)).count() == 0
    assert {r.file_path: r.file_hash for r in manifest.upsert(then, now, ["codebase_id", "file_path"]).collect()}["blank"] == h


def test_edges_of_removed_files(spark):
    edges = spark.createDataFrame([(1, "a.go"), (1, "a.go:3"), (1, "a.gox"), (2, "a.go"), (1, None)], "codebase_id long, from_ref string")
    left = manifest.keep_edges_of_other_files(edges, spark.createDataFrame([(1, "a.go")], "codebase_id long, file_path string"))
    assert sorted((r.codebase_id, r.from_ref or "") for r in left.collect()) == [(1, ""), (1, "a.gox"), (2, "a.go")]


def test_artifact_round_trip(spark, data, tmp_path):
    ix, out = Index(spark, data), str(tmp_path / "artifact")
    manifest.export_artifact(ix, 1, out, strip=True)
    here = Store(spark, str(tmp_path / "here"))
    assert here.register("/elsewhere", "other", 5) == 1
    with pytest.raises(ValueError):
        here.register("/elsewhere", "again", 6)
    local = here.load_artifact(out)
    assert local == 2 and here.codebase(2)["root_path"] == ix.codebases.filter("id = 1").first().root_path
    chunks = here.read("chunks")
    n = ix.raw("chunks").filter("codebase_id = 1").dropDuplicates(["id"]).count()
    assert chunks.count() == n > 0
    assert chunks.filter("codebase_id <> 2 or snippet <> '' or signature <> ''").count() == 0
    assert here.load_artifact(out, name="renamed") == 2 and here.read("chunks").count() == n  # in the place of what was there
    assert here.codebase(2)["name"] == "renamed" and here.read("codebases").count() == 2
    meta = spark.createDataFrame([("schema_version", "1"), ("closed_source", "true"), ("made_by", "x")], "key string, value string")
    meta.write.mode("overwrite").parquet(f"{out}/meta.parquet")
    shutil.rmtree(f"{out}/codebase_meta.parquet")  # as an old artifact is
    here.load_artifact(out)
    assert here.read("codebase_meta").filter("key = 'closed_source' and value = 'true' and codebase_id = 2").count() == 1
    assert {r.key for r in here.read("meta").collect()} == {"source_stripped", "made_by"} - {"source_stripped"}
    spark.createDataFrame([("schema_version", "7")], "key string, value string").write.mode("overwrite").parquet(f"{out}/meta.parquet")
    with pytest.raises(ValueError):
        here.load_artifact(out)


FILES = "codebase_id long, file_path string, text string"


def test_incremental_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = spark.createDataFrame([(1, "a.go", "package a\n" * 60), (1, "r.md", "# t\nx\n# u\ny"), (2, "b.txt", "one\n\ntwo"), (2, None, "x"), (3, "only.go", "x")], FILES)
    got = {r.codebase_id: r for r in store.index(first, 10).collect()}
    assert got[1].files_added == 2 and got[2].total_files == 1
    keys = lambda: sorted(r.chunk_key for r in store.read("chunks").collect())
    assert keys() == ["a.go:0:1-50", "a.go:1:51-61", "b.txt:0:1-3", "only.go:0:1-1", "r.md:0:1-2", "r.md:1:3-4"]
    second = spark.createDataFrame([(1, "a.go", "package a\n"), (1, "new.py", "x = 1"), (1, "r.md", "# t\nx\n# u\ny")], FILES)
    got = store.index(second, 20).first()
    assert (got.files_changed, got.files_added, got.files_removed, got.files_skipped) == (1, 1, 0, 1)
    assert keys() == ["a.go:0:1-2", "b.txt:0:1-3", "new.py:0:1-1", "only.go:0:1-1", "r.md:0:1-2", "r.md:1:3-4"]
    assert {(r.file_path, r.indexed_at) for r in store.read("indexed_files").filter("codebase_id = 1").collect()} == {("a.go", 20), ("new.py", 20), ("r.md", 10)}
    assert store.index(second, 30).first().files_skipped == 3
    assert store.index(second.filter("file_path = 'r.md'"), 40).first().files_removed == 2
    store.delete("chunks", spark.createDataFrame([(3,)], "codebase_id long"), ["codebase_id"])
    assert keys() == ["b.txt:0:1-3", "r.md:0:1-2", "r.md:1:3-4"]
    assert store.rebuild(second, 50).first().files_added == 3 and len(keys()) == 5


def test_incremental_analysis(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    symbols = lambda *rows: spark.createDataFrame(rows, "codebase_id long, file_path string, name string")
    edges = lambda *rows: spark.createDataFrame(rows, "codebase_id long, from_ref string, to_ref string")
    files = spark.createDataFrame([(1, "a.go", "x"), (1, "b.go", "y\nz")], FILES)
    store.analyse(files, symbols((1, "a.go", "A"), (1, "b.go", "B")), edges((1, "a.go:1", "B"), (1, "b.go", "A")), 1)
    changed = spark.createDataFrame([(1, "a.go", "x2"), (1, "b.go", "y\nz")], FILES)
    store.analyse(changed, symbols((1, "a.go", "A2"), (1, "b.go", "ignored")), edges((1, "a.go:9", "C"), (1, "b.go", "ignored")), 2)
    assert {(r.file_path, r.name) for r in store.read("symbols").collect()} == {("a.go", "A2"), ("b.go", "B")}
    assert {(r.from_ref, r.to_ref) for r in store.read("edges").collect()} == {("a.go:9", "C"), ("b.go", "A")}
    assert {(r.file_path, r["loc"], r.symbol_count, r.language) for r in store.read("source_files").collect()} == {("a.go", 1, 1, "go"), ("b.go", 2, 1, "go")}


def test_stream_into_the_index(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "s")), str(tmp_path / "events")
    tree = spark.createDataFrame([(1, "a.go", "x"), (2, "b.go", "y")], FILES)
    spark.createDataFrame([(1, "a.go", "write"), (1, "a.go", "write"), (None, "c", "write")], "codebase_id long, path string, op string").write.parquet(source)
    events = spark.readStream.schema("codebase_id long, path string, op string").parquet(source)
    feed(events, lambda ids: tree.join(ids, "codebase_id", "left_semi"), store, str(tmp_path / "c")).awaitTermination()
    assert [r.file_path for r in store.read("indexed_files").collect()] == ["a.go"]


def test_gitignore(spark):
    rules = {".gitignore": "*.log\n/build\ndocs/*.txt\n!keep.log\ntmp/\n# no\n**/gen/**\na?.go\n", "sub/.gitignore": "!x.log\n/only.go\n"}
    paths = {
        "x.log": False, "sub/x.log": True, "keep.log": True, "sub/y.log": False, "build/a.go": False, "sub/build/a.go": True, "docs/a.txt": False, "docs/b/a.txt": True, "tmp/keep.log": False, "s/tmp/a.go": False, "tmp": True,
        "q/gen/r/s.go": False, "ab.go": False, "abc.go": True, "sub/only.go": False, "sub/sub/only.go": True,
    }
    rows = [(1, p, t) for p, t in rules.items()] + [(c, p, "") for p in paths for c in (1, 2)]
    kept = {(r.c, r.file_path) for r in ingest.not_ignored_by_git(spark.createDataFrame(rows, "c long, file_path string, text string"), ["c"]).collect()}
    assert {p: (1, p) in kept for p in paths} == paths
    assert all((2, p) in kept for p in paths)  # another tree has no rules


class Calls:
    def __init__(self, spark, durations):
        self.df = spark.createDataFrame([(i, f"2024-01-01 00:00:{i % 60:02d}", "t", d / 10) for i, d in enumerate(durations)], "event_id long, ts string, event_type string, value double")

    def raw(self, name):
        return self.df


def test_p95(spark):
    for durations, cli, window in (([42], 42, 42), (list(range(1, 101)), 95, 95), (list(range(1, 21)), 19, 19), ([7] * 5, 7, 7)):
        calls = Calls(spark, durations)
        assert metrics.tool_stats(calls).first().p95_ms == cli
        assert metrics.tool_stats_window(calls).first().p95_ms == window


def test_chunkers(spark):
    texts = spark.createDataFrame([(1, "# a\nx\n\n## b\ny\n"), (2, "\n\n"), (3, "\n".join(f"l{i}" for i in range(120))), (4, "")], "doc_id long, text string")
    lines = {(r.doc_id, r.start_line, r.end_line) for r in ingest.line_chunks(texts, "doc_id").collect()}
    assert lines == {(1, 1, 6), (3, 1, 50), (3, 51, 100), (3, 101, 120)}
    sections = sorted((r.doc_id, r.start_line, r.end_line) for r in ingest.markdown_sections(texts, "doc_id").collect())
    assert sections == [(1, 1, 3), (1, 4, 6), (3, 1, 120)]
    long = "\n\n".join("word " * 60 for _ in range(40)) + "\n\n" + "x" * 9000
    packed = ingest._packed(long, 500, 100)
    assert all(len(s) // 4 <= 620 for _, _, s in packed) and packed[0][0] == 1
    assert [a <= b for a, b, _ in packed] and [p[0] for p in packed] == sorted(p[0] for p in packed)
    assert ingest.prose_chunks(texts).count() == 2


def test_scan_tree(spark, tmp_path):
    for name, body in (("a.go", "package a\n"), ("vendor/b.go", "package b\n"), ("c.bin", "x"), ("d/e.md", "# t\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = {r.file_path: r for r in ingest.scan_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.go", "d/e.md"} and len(rows["a.go"].file_hash) == 64


def test_stream_of_events_equals_batch(spark, data, tmp_path):
    events = Index(spark, data).raw("events")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    late = events.selectExpr("max(event_id) + 1 as event_id", "max(ts) + interval 30 days as ts", "-1L as user_id", "'x' as event_type", "0D as value", "'' as props").select(*events.columns)
    late.write.mode("append").parquet(source)  # moves the watermark past all bursts
    debounce.run_available(debounce.stream_sessions(spark, source, events.schema, late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = debounce.sessions(events)
    keys = lambda df: sorted((r.path, r.last_at, r.events, r.op) for r in df.filter("path >= 0").collect())
    assert keys(got) == keys(want)
    assert debounce.sessions(events.limit(0)).count() == 0
    assert debounce.sessions(events).agg(F.sum("events")).first()[0] == events.count()


class Tables:
    """An index made of given tables."""

    def __init__(self, spark, **tables):
        self.spark, self.tables = spark, tables

    raw = lambda self, name: self.tables[name]
    codebases = property(lambda self: self.tables["codebases"])
    members = Index.members


def test_imports_resolved_by_siblings(spark):
    """The exact name before the qualified one, the least id, never the importer itself, the last workspace by name."""
    codebases = spark.createDataFrame([(i, f"/srv/code/{w}/c{i}", f"c{i}", 0) for i, w in ((1, "red"), (2, "red"), (3, "red"), (4, "blue"))], "id long, root_path string, name string, indexed_at long")
    names = [(10, 1, "own", "m.own"), (11, 2, "x", "pkg.x"), (12, 3, "pkg.x", "pkg.x"), (13, 3, "y", "q.y"), (14, 2, "y2", "q.y"), (15, 4, "far", "far")]
    symbols = spark.createDataFrame(names, "id long, codebase_id long, name string, qualified_name string")
    kept = "id long, codebase_id long, from_kind string, from_ref string, to_kind string, to_ref string, edge_kind string, line long, resolved int, target_codebase_id long"
    asked = [(1, "pkg.x", 0), (2, "q.y", 0), (3, "own", 0), (4, "far", 0), (5, "pkg.x", 1)]
    edges = spark.createDataFrame([(i, 1, "file", "a", "symbol", ref, "imports", 1, resolved, None) for i, ref, resolved in asked], kept)
    got = graph.cross_repo_resolution(Tables(spark, codebases=codebases, symbols=symbols, edges=edges)).collect()
    assert {r.edge_id: (r.target_codebase_id, r.symbol_id) for r in got} == {1: (3, 12), 2: (3, 13)}

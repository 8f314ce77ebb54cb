import sqlite3

import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import search


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_like(spark):
    for value, pattern, holds in (("FooBar", "%foob%", True), ("É", "é", False), ("a_b", "axb", False), ("axb", "a_b", True), ("100%", "100%", True)):
        assert one(spark, text.sqlite_like(F.lit(value), pattern)) is holds


def test_small_helpers(spark):
    assert one(spark, text.dotted_suffixes(F.lit("a.b.C"))) == ["a.b.C", "b.C", "C"]
    assert one(spark, text.compact(F.lit("  short "), 240)) == "short"
    long = one(spark, text.compact(F.lit("word\n" * 100), 240))
    assert len(long) <= 240 and long.endswith("\n... (truncated)")
    assert one(spark, text.words(F.lit("Café_au-lait 2x"))) == ["cafe", "au", "lait", "2x"]
    assert one(spark, text.path_domain(F.lit("a/b.go"))) == "a/" and one(spark, text.path_domain(F.lit("b.go"))) == "(root)"
    assert text.query_terms("When does the parser, Parser fail?") == ["when", "does", "parser", "fail"]
    assert text.escape_fts('a-b "c*" (d)') == "a b c d"
    assert text.glob_regex("*.md") == r"^[^/]*\.md$"


def test_finite(spark):
    rows = spark.createDataFrame([(1, 1.5), (2, float("nan")), (3, float("inf")), (4, None), (5, float("-inf"))], "i int, v double")
    assert {r.i: r.v for r in text.finite(rows).collect()} == {1: 1.5, 2: None, 3: None, 4: None, 5: None}


ROWS = [(1, "the journal keeps a pending ledger", "a.go:1-50", "a.go"), (2, "ledger ledger parser", "b.go:1-50", "b.go"), (3, "a pending journal, pending again", "c.go:1-50", "pending/c.go"), (4, "validate nothing", "d.go:1-9", "d.go")]


class Small:
    """An index of four chunks."""

    def __init__(self, spark):
        self.spark = spark

    def raw(self, name):
        rows = [(i, 1, p, "code", n, "", s, 1, 50) for i, s, n, p in ROWS]
        return self.spark.createDataFrame(rows, "id long, codebase_id long, file_path string, kind string, name string, signature string, snippet string, start_line long, end_line long")

    def once(self, name, *columns):
        return self.raw(name).select("id", *columns)


@pytest.mark.parametrize("query", ["ledger", "pending journal", "ledger OR validate", "pending NOT ledger", '"pending journal"', "valid*", "name:go pending", "(ledger OR journal) AND pending", "nothing AND validate"])
def test_bm25_against_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(snippet, name, file_path)")
    con.executemany("INSERT INTO t(rowid, snippet, name, file_path) VALUES (?, ?, ?, ?)", ROWS)
    want = {i: round(s, 6) for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,))}
    assert {r.id: round(r.bm25, 6) for r in search.scored(Small(spark), query).collect()} == want


def test_tiers(spark):
    for bad in ("", "a AND", "what's up", "name2:", '"', "nocol:x", "(a OR b) c"):
        with pytest.raises(ValueError):
            search.compile_query(bad)
    assert [r.id for r in search.lexical(Small(spark), "journal, pending").collect()] == [3]  # as a substring
    assert search.lexical(Small(spark), "(pending").count() == 2  # without its marks

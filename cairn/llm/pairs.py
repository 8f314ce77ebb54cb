"""Functions paired with their descriptions (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.sources.tables import delivered_once, extension

#: Tokens that cover a text wholly: comments, strings, brackets, and runs of other code or white space between them.
_STRINGS = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|' + r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_C = r"//[^\n]*|/\*[\s\S]*?\*/|" + _STRINGS + r"|`[^`]*`|[{}()\[\]]|\s+|[^\s\"'`/{}()\[\]][^\"'`/{}()\[\]]*|[\s\S]"
_RUST = r'//[^\n]*|/\*[\s\S]*?\*/|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|' + r"'(?:[^'\\\n]|\\[^\n']{1,10}|\\')'|[{}()\[\]]|\s+|[^\s\"'/{}()\[\]][^\"'/{}()\[\]]*|[\s\S]"
_PYTHON = r'#[^\n]*|[rRuU]?(?:"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + _STRINGS + r")|[{}()\[\]]|\s+|[^\s\"'#{}()\[\]][^\"'#{}()\[\]]*?(?=[rRuU]?[\"'#{}()\[\]]|$)|[\s\S]"


def functions(symbols: DataFrame) -> DataFrame:
    """The func and method rows with a body, each id once, hash-partitioned by id for all that follows."""
    rows = symbols.filter(F.lower("kind").isin("func", "method") & (F.trim(F.regexp_replace("body_snippet", r"\s+", " ")) != "") & F.col("id").isNotNull())
    return delivered_once(rows.select(F.col("id").alias("symbol_id"), "name", "signature", "doc_comment", F.col("body_snippet").alias("body"), extension().alias("ext")), "symbol_id")


def lexed(rows: DataFrame) -> DataFrame:
    """One row per token: (symbol_id, pos, kind, size, delta, text ...); text only of comments and strings.

    A doc_comment that isn't blank is the first token of its function, a comment that stands apart from those in
    the body and takes no room in it.
    """

    def cut(pattern: str) -> Column:
        return F.regexp_extract_all("body", F.lit(pattern), F.lit(0))

    own = F.when(F.trim(F.regexp_replace("doc_comment", r"\s+", " ")) != "", F.col("doc_comment"))
    tokens = F.when(F.col("ext") == ".py", cut(_PYTHON)).when(F.col("ext") == ".rs", cut(_RUST)).otherwise(cut(_C))
    told = rows.select("symbol_id", "ext", own.isNotNull().alias("told"), F.when(own.isNotNull(), F.concat(F.array(own), tokens)).otherwise(tokens).alias("tokens"))
    exploded = told.select("symbol_id", "ext", "told", F.posexplode("tokens").alias("pos", "token")).withColumn("own", F.col("told") & (F.col("pos") == 0))
    first, python = F.substring("token", 1, 1), F.col("ext") == ".py"
    kind = (
        F.when(F.col("own"), F.lit("comment"))
        .when(F.trim(F.translate("token", "\n\r\t\f", "    ")) == "", F.lit("blank"))
        .when((python & (first == "#")) | (~python & F.substring("token", 1, 2).isin("//", "/*")), F.lit("comment"))
        .when(F.col("token").isin("{", "(", "["), F.lit("open"))
        .when(F.col("token").isin("}", ")", "]"), F.lit("close"))
        .when((F.length("token") > 1) & (first.isin('"', "'", "`") | F.col("token").rlike("^[rRuU][\"']")), F.lit("string"))
        .otherwise(F.lit("code"))
    )
    return exploded.withColumn("kind", kind).select(
        "symbol_id",
        "pos",
        "kind",
        "own",
        F.when(F.col("own"), 0).otherwise(F.length("token")).alias("size"),
        F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0).alias("delta"),
        F.when(F.col("kind").isin("comment", "string") | (F.col("token") == "{"), F.col("token"))
        .when((F.col("kind") == "code") & python & F.col("token").rlike(r":\s*\n"), F.when(F.col("token").rlike(r"^(?:->[^:\n]*)?:\s*$"), F.lit("header:")).otherwise(F.lit(":")))
        .alias("text"),
        ((F.col("told") & (F.col("pos") == 1)) | ((F.col("kind") == "blank") & F.col("token").rlike(r"\n\s*\n"))).alias("gap"),
    )


def delimited(tokens: DataFrame) -> DataFrame:
    """Per function: its leading comments, its doc string, and where its code begins and ends in the body.

    Windows over the tokens of one body: a running sum of brackets gives the depth; comments with nothing but
    line ends between them are of one island, an empty line or code begins another; the islands before the
    first code are attached to it, the function's own doc_comment before all others; lag finds the string right after the colon that closes the header at depth
    0. A body whose brackets never close again ends with its last token.
    """
    w = Window.partitionBy("symbol_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    solid = F.col("kind").isin("code", "open", "close", "string")
    counted = tokens.select(
        "symbol_id",
        "pos",
        "kind",
        "size",
        "text",
        "own",
        F.sum("delta").over(upto).alias("depth"),
        F.sum("size").over(upto).alias("upto"),
        F.sum(solid.cast("int")).over(upto).alias("coded"),
        F.sum(((F.col("text") == "{") & ~F.col("own")).cast("int")).over(upto).alias("opened"),
        F.sum((solid | F.col("gap")).cast("int")).over(upto).alias("island"),
        F.sum((F.col("text").isin(":", "header:") & ~F.col("own")).cast("int")).over(upto).alias("colons"),
        F.lag("text").over(w).alias("after"),
    )
    doc = (F.col("kind") == "string") & (F.col("after") == "header:") & (F.col("depth") == 0) & (F.col("colons") == 1)
    lead = (F.col("kind") == "comment") & (F.col("coded") == 0)
    body_end = (F.col("kind") == "close") & (F.col("depth") == 0) & (F.col("opened") > 0)
    return counted.groupBy("symbol_id").agg(
        F.max("own").alias("told"),
        F.sort_array(F.collect_list(F.when(lead, F.struct("island", "pos", "text")))).alias("leading"),
        F.min_by("text", F.when(doc, F.col("pos"))).alias("doc_string"),
        F.min(F.when(solid, F.col("upto") - F.col("size"))).alias("code_start"),
        F.min(F.when(body_end, F.col("upto"))).alias("code_end"),
        F.max("upto").alias("last"),
    )


@F.pandas_udf(T.BooleanType())
def _describes(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from cairn.llm.descriptions import describes

    for comments, names, signatures in batches:
        yield pd.Series([describes(c, n, s) for c, n, s in zip(comments, names, signatures, strict=True)], dtype=bool)


@F.pandas_udf(T.StringType())
def _prose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from cairn.llm.descriptions import bare_text, prose

    for comments in batches:
        yield pd.Series([None if c is None else prose(bare_text(c)) for c in comments], dtype=object)


def described(symbols: DataFrame) -> DataFrame:
    """(symbol_id, signature, code, comment) of the functions whose comment says something of its own.

    The comment is doc_comment or, if that is blank or NULL, the comment that begins the body, or the doc
    string that opens the function. Code is the body from its first token of code to the close of its first
    block (to its end in Python and where nothing closes). Rows delivered twice count once; rows without a
    body, or with a NULL id, give none; NULL names and signatures count as empty.
    """
    rows = functions(symbols)
    parts = delimited(lexed(rows))
    told = F.col("told")
    leading = F.when(told, F.get("leading", F.lit(0))["text"]).otherwise(F.array_join(F.transform("leading", lambda c: c["text"]), "\n"))
    found = rows.join(parts, "symbol_id").select(
        "symbol_id",
        "name",
        "signature",
        F.expr("substring(body, int(coalesce(code_start, 0)) + 1, int(case when ext <> '.py' then coalesce(code_end, last) else last end - coalesce(code_start, 0)))").alias("code"),
        F.coalesce(F.when(leading != "", leading), F.col("doc_string")).alias("comment"),
        F.when(~told & (leading != ""), F.col("doc_string")).alias("second"),
    )
    told = found.filter("comment is not null").withColumn("comment", F.when(_describes("comment", "name", "signature"), F.col("comment")).otherwise(F.col("second")))
    return told.filter("comment is not null").filter(F.col("second").isNull() | _describes("comment", "name", "signature")).select("symbol_id", "signature", "code", "comment")


def pairs(symbols: DataFrame) -> DataFrame:
    """(symbol_id, signature, code, description): the pairs, descriptions reduced to their prose."""
    return described(symbols).withColumn("description", _prose("comment")).drop("comment")

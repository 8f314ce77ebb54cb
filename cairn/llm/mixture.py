"""Mixing documents of several sources to target shares of tokens (problem 8)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of vocabulary files of public tokenizers, and the one used; a parameter, as on another cluster it differs.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The public pattern that goes with that vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The tree's first level: domain -> sources in it, a parameter; sources not named are of domain REST.
DOMAINS, REST = {"talk": ("issue_tracker", "chat_export", "forum", "commit_log")}, "documentation"
#: Ranges of the seeded order of an epoch, so that no leaf, however large, is ordered in one task.
RANGES = 4096
#: Up to so many leaves (languages by sources with a target) are broadcast; more are joined by a shuffle.
BROADCAST_LEAVES = 50_000
LEAF = ["domain", "lang", "source"]


@lru_cache(maxsize=4)
def _encoder(folder: str, vocabulary: str):
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(folder: str, vocabulary: str):
    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(folder, vocabulary)
        for batch in batches:
            yield pd.Series([len(encoder.encode_ordinary(text)) for text in batch], dtype="int64")

    return count


def plain_source(source: Column) -> Column:
    """A source's name without letter case, padding and kind of separator."""
    return F.regexp_replace(F.trim(F.lower(source)), r"[\s-]+", "_")


def domain_of(source: Column, domains: dict[str, tuple[str, ...]]) -> Column:
    found = [F.when(source.isin(*members), F.lit(domain)) for domain, members in domains.items() if members]
    return F.coalesce(*found, F.lit(REST))


def plain_targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats) by plain names: shares of rows that name the same source add up, the least
    max_repeats counts, negative or NULL shares and repeats are none, rows without a source are left out."""
    rows = targets.select(plain_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("repeats"))
    return rows.filter("source is not null").groupBy("source").agg(F.sum("share").alias("target_share"), F.min("repeats").cast("int").alias("max_repeats"))


def sized_documents(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, domains: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """(doc_id, domain, lang, source, max_repeats, tokens) of the documents whose source has a target, once each."""
    wanted = plain_targets(targets).select("source", "max_repeats")
    language = F.regexp_extract(F.lower(F.trim("lang")), "^[a-z]{2,3}", 0)
    rows = documents.filter("doc_id is not null and text is not null").select("doc_id", F.when(language != "", language).otherwise("und").alias("lang"), plain_source(F.col("source")).alias("source"), "text")
    sized = rows.join(wanted, "source").select("doc_id", domain_of(F.col("source"), domains).alias("domain"), "lang", "source", "max_repeats", _counter(folder, vocabulary)("text").alias("tokens"))
    return sized.filter("tokens > 0").dropDuplicates(["doc_id"])


def leaves(sized: DataFrame, targets: DataFrame, domains: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """(domain, lang, source, tokens, weight, room): the tree's leaves.

    A source's target is divided among its languages as its tokens are; that of a source without documents, as
    those of its domain are, so its leaves have no room and their amounts go to their siblings first.
    """
    held = sized.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.max("max_repeats").alias("repeats"))
    wanted = plain_targets(targets).select("source", "target_share")
    whole = F.sum("tokens").over(Window.partitionBy("source"))
    full = held.join(wanted, "source").select(*LEAF, "tokens", (F.col("target_share") * F.col("tokens") / whole).alias("weight"), (F.col("tokens") * F.col("repeats")).cast("double").alias("room"))
    languages = held.groupBy("domain", "lang").agg(F.sum("tokens").alias("n")).withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy("domain"))).drop("n")
    without = wanted.join(held.select("source").distinct(), "source", "left_anti").withColumn("domain", domain_of(F.col("source"), domains)).join(languages, "domain", "left")
    empty = without.select("domain", F.coalesce("lang", F.lit("und")).alias("lang"), "source", F.lit(0).cast("long").alias("tokens"), (F.col("target_share") * F.coalesce("part", F.lit(1.0))).alias("weight"), F.lit(0.0).alias("room"))
    return full.unionByName(empty)


def _filled(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """`nodes` with `given`: what each gets of its parent's `amount`, by weight, but no more than its room.

    What a child can't hold goes to its siblings. The children that are filled are those with the least room for
    their weight, so running sums in that order give the level at which the others stop.
    """
    of = Window.partitionBy(*(parent or [F.lit(1)]))
    open_ = (F.col("room") > 0) & (F.col("weight") > 0)
    nodes = nodes.withColumn("w", F.when(open_, F.col("weight")).otherwise(0.0)).withColumn("r", F.when(open_, F.col("room")).otherwise(0.0)).withColumn("ratio", F.when(open_, F.col("room") / F.col("weight")).otherwise(0.0))
    order = of.orderBy("ratio", *[c for c in LEAF if c in nodes.columns])
    before = F.coalesce(F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    summed = nodes.withColumn("before", before).withColumn("after", after).withColumn("most", F.least("amount", F.sum("r").over(of)))
    level = F.when((F.col("w") > 0) & (F.col("before") + F.col("ratio") * F.col("after") >= F.col("most") * (1 - 1e-12)), F.struct("ratio", "before", ((F.col("most") - F.col("before")) / F.col("after")).alias("level")))
    given = F.least(F.coalesce(F.min(level).over(of)["level"], F.lit(0.0)) * F.col("w"), F.col("r"))
    return summed.withColumn("given", F.greatest(given, F.lit(0.0))).drop("w", "r", "ratio", "before", "after", "most")


def budgets(tree: DataFrame, total: float | str | None = None) -> DataFrame:
    """(domain, lang, source, tokens, budget) of the leaves, top down: a node's amount goes to its children by
    weight, what a child can't hold to its siblings, and only what they can't hold either to its parent's siblings.

    `total` is the mixture's size in tokens, "all" for the tokens of all documents with a target; None makes it as
    large as it can be with no leaf that has documents short, which keeps all shares on target.
    """
    one = Window.partitionBy(F.lit(1))
    if total is None:
        part = F.lit(1.0)
        parts = tree
        for depth in range(3):
            of = Window.partitionBy(*(LEAF[:depth] or [F.lit(1)]))
            node = Window.partitionBy(*LEAF[: depth + 1])
            parts = parts.withColumn(f"open{depth}", F.when(F.max("room").over(node) > 0, F.col("weight")).otherwise(0.0))
            own = F.sum("weight").over(node)
            parts = parts.withColumn(f"own{depth}", own).withColumn(f"all{depth}", F.sum(f"open{depth}").over(of))
            part = part * F.when(F.col(f"all{depth}") > 0, F.col(f"own{depth}") / F.col(f"all{depth}")).otherwise(0.0)
        most = F.min(F.when((F.col("room") > 0) & (part > 0), F.col("room") / part)).over(one)
        tree = parts.withColumn("amount", F.coalesce(most, F.lit(0.0))).select(*tree.columns, "amount")
    else:
        tree = tree.withColumn("amount", F.sum("tokens").over(one).cast("double") if total == "all" else F.lit(float(total)))
    for depth in range(3):
        keys = LEAF[: depth + 1]
        nodes = tree.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("room").alias("room"), F.max("amount").alias("amount"))
        given = _filled(nodes, LEAF[:depth]).select(*keys, "given")
        tree = tree.join(given, keys).withColumn("amount", F.col("given")).drop("given")
    return tree.select(*LEAF, "tokens", F.col("amount").alias("budget"))


def mixed_documents(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 7, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, domains: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """(doc_id, source, lang, tokens, repeats): how often each document is used; unused ones are left out.

    A leaf's budget is met by whole epochs of its documents and a prefix of one more, ordered by a hash of
    seed, epoch and doc_id. The prefix is found by ranges of that hash: whole ranges up to the one in which the
    budget ends, and only that one is ordered, so a source that holds a third of all rows is no hot group.
    No document is used more than its source's max_repeats times. Sources without documents get nothing,
    documents of sources without a target, with NULL or empty text or NULL doc_id are left out; empty tables
    give an empty mixture.
    """
    from cairn.session import cut_lineage

    sized = cut_lineage(sized_documents(documents, targets, folder, vocabulary, domains))
    epochs = F.floor(F.col("budget") / F.col("tokens"))
    plan = cut_lineage(budgets(leaves(sized, targets, domains), total).filter("tokens > 0").select(*LEAF, epochs.alias("epochs"), (F.col("budget") - epochs * F.col("tokens")).alias("rest")))
    epochs = F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan
    leaf = LEAF
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    rows = sized.join(epochs, leaf).withColumn("place", order).withColumn("range", F.pmod(F.shiftright("place", 40), F.lit(RANGES)))
    ranges = rows.groupBy(*leaf, "range").agg(F.sum("tokens").alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begun = ranges.withColumn("before", upto - F.col("held")).join(plan.select(*leaf, "rest"), leaf)
    state = F.when(F.col("before") + F.col("held") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(2)
    placed = rows.join(begun.select(*leaf, "range", "before", state.alias("state")), [*leaf, "range"])
    within = Window.partitionBy(*leaf, "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter("state = 2").withColumn("extra", ((F.col("before") + F.sum("tokens").over(within) - F.col("tokens") / 2) <= F.col("rest")).cast("int"))
    used = placed.filter("state <> 2").withColumn("extra", F.col("state")).unionByName(edge)
    repeats = F.least(F.col("epochs") + F.col("extra"), F.col("max_repeats").cast("long"))
    return used.select("doc_id", "source", "lang", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def mixture_shares(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 7, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, domains: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats) for each source with a target."""
    mixed = mixed_documents(documents, targets, total, seed, folder, vocabulary, domains)
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    wanted = plain_targets(targets).select("source", "target_share")
    shares = wanted.join(by, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per source with a target
    return shares.withColumn("actual_share", F.when(whole > 0, F.round(F.col("tokens") / whole, 6)).otherwise(0.0)).select("source", "target_share", "actual_share", "tokens", "documents", "most_repeats")

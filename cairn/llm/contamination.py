"""Evaluation texts leaking into documents (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of an item that must occur in a row; one word in eight may be changed, so four in runs of under 2 * RUN
#: words, and of a longer run some half has no greater share of changes.
RUN, CHANGES = 20, 4
#: Windows: their size in words, and how many words in a row of a document's window some item must have too: a run
#: with one change in eight keeps six words in a row at least, so five lose nothing.
WINDOW, GRAM = 14, 5
#: CGK walks, samples from each and places in a sample. Recall: see README.
REPEATS, BANDS, SAMPLE = 4, 6, 9
#: Stock instructions: leading words of an item covered by rows of STOCK_GRAM words that STOCK_ITEMS items share.
STOCK_GRAM, STOCK_ITEMS = 8, 5
#: Items are searched for in blocks of about so many words, which every task holds; longer items are cut into pieces
#: that overlap by 2 * RUN words, more than any run that tells (see CHANGES).
BLOCK_WORDS, PIECE = 60_000, 2_000
#: Shifts that are verified together.
STEP = 4


def _embedding():
    from cairn.llm.cgk import Embedding

    return Embedding(WINDOW, REPEATS, BANDS, SAMPLE)


def item_pieces(items: DataFrame) -> DataFrame:
    """(item_id, piece, words): ids of each item's words after its stock instruction, long items in pieces.

    Rows of STOCK_GRAM words are counted over all items, once per item; the stock instruction reaches to the
    first such row that fewer than STOCK_ITEMS items have. Items delivered twice count once.
    """

    @F.pandas_udf("array<long>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from cairn.llm.cgk import WordIds, normal_words

        known = WordIds()
        for texts in batches:
            yield pd.Series([np.array([known[w] for w in normal_words(t)], dtype=np.int64) for t in texts])

    known = items.filter("item_id is not null and text is not null").select("item_id", "text").dropDuplicates(["item_id"]).select("item_id", ids("text").alias("words"))
    places = F.sequence(F.lit(1), F.size("words") - STOCK_GRAM + 1)
    rows = known.filter(F.size("words") >= RUN).select("item_id", "words", F.transform(places, lambda i: F.xxhash64(F.slice("words", i, STOCK_GRAM))).alias("rows"))
    shared = rows.select("item_id", F.explode(F.array_distinct("rows")).alias("row")).groupBy("row").agg(F.count("*").alias("held")).filter(F.col("held") >= STOCK_ITEMS).select("row", F.lit(True).alias("stock"))
    own = rows.select("item_id", F.posexplode("rows").alias("place", "row")).join(shared, "row", "left").groupBy("item_id").agg(F.coalesce(F.min(F.when(F.col("stock").isNull(), F.col("place"))), F.count("*")).alias("stock"))
    begin = F.when(F.col("stock") > 0, F.col("stock") + STOCK_GRAM).otherwise(F.lit(1)).cast("int")
    kept = rows.join(own, "item_id").select("item_id", F.slice("words", begin, F.size("words")).alias("words")).filter(F.size("words") >= RUN)
    step = PIECE - 2 * RUN
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 2 * RUN - 1), F.lit(step))
    return kept.select("item_id", "words", F.posexplode(cuts).alias("piece", "at")).select("item_id", "piece", F.slice("words", F.col("at") + 1, F.lit(PIECE)).alias("words"))


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces with the keys of all their windows, as bytes."""
    walks = _embedding()
    for batch in batches:
        words = [np.asarray(w, dtype=np.int64) for w in batch["words"]]
        keys = [walks.keys(w, np.arange(len(w) - WINDOW + 1)) for w in words]
        yield pd.DataFrame({"item_id": batch["item_id"], "block": batch["block"], "words": [w.tobytes() for w in words], "keys": [k.tobytes() for k in keys]})


def _grams(words: np.ndarray) -> np.ndarray:
    """A hash of each GRAM words in a row."""
    held = words.astype(np.uint64)
    out = np.zeros(max(0, len(held) - GRAM + 1), dtype=np.uint64)
    for i in range(GRAM if len(out) else 0):
        out = (out ^ held[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which `values` are in the sorted array `ordered`."""
    if not len(ordered):
        return np.zeros(values.shape, dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _ranges(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers begin[i], begin[i] + 1, ... many[i] of them for each i, one after the other."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


class Block:
    """A block of items: their words, and the keys of their windows, sorted, with the piece and place of each."""

    def __init__(self, ids: list[int], words: list[np.ndarray], keys: list[np.ndarray]):
        none = np.empty(0, dtype=np.int64)
        self.ids, self.words = ids, words
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([none, *words])
        self.grams = np.unique(np.concatenate([none.astype(np.uint64), *map(_grams, words)]))
        each = REPEATS * BANDS
        flat = np.concatenate([none, *keys])
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.after = np.append(self.first[1:], len(flat))
        self.piece = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])[order]
        self.pos = np.concatenate([none, *(np.arange(len(k)) // each for k in keys)])[order].astype(np.int32)

    def hits(self, walks, words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, piece, shift), once each, where windows of the texts in `words` and of a piece share keys."""
        many = np.maximum(sizes - WINDOW + 1, 0)
        starts, owner = _ranges(begins, many), np.repeat(np.arange(len(many)), many)
        total = np.cumsum(np.concatenate([[0], _among(_grams(words), self.grams)]))
        kept = np.flatnonzero(total[starts + WINDOW - GRAM + 1] > total[starts]) if len(starts) else starts
        starts, owner = starts[kept], owner[kept]
        found = [np.empty((3, 0), dtype=np.int64)]
        for at in range(0, len(starts) if len(self.keys) else 0, 50_000):
            part = slice(at, at + 50_000)
            keys = walks.keys(words, starts[part])
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            row, col = np.nonzero(self.keys[place] == keys)
            place, doc = place[row, col], owner[part][row]
            many = self.after[place] - self.first[place]
            held = _ranges(self.first[place], many)
            shift = np.repeat(starts[part][row] - begins[doc], many) - self.pos[held]
            one = np.stack([np.repeat(doc, many), self.piece[held].astype(np.int64), shift])
            found.append(_distinct(one))
        return tuple(_distinct(np.concatenate(found, axis=1)))

    def near(self, words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, doc: np.ndarray, piece: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Which rows may hold a leak: with a word counted where it is at the row's shift or up to STEP + CHANGES
        beside it, some RUN words or more have one word in EACH missing at most. For all rows at once."""
        from cairn.llm.cgk import EACH

        ok = np.zeros(len(doc), dtype=bool)
        size = self.size[piece]
        for rows in np.split(np.arange(len(doc)), np.searchsorted(np.cumsum(size), np.arange(500_000, size.sum(), 500_000))):
            many = size[rows]
            cell = _ranges(self.begin[piece[rows]], many)
            wanted = self.flat[cell]
            begin = begins[doc[rows]]
            lowest, highest = np.repeat(begin, many), np.repeat(begin + sizes[doc[rows]], many)
            at = _ranges(begin + shift[rows] - CHANGES, many)
            met = np.zeros(len(cell), dtype=bool)
            for _ in range(STEP + 2 * CHANGES):
                met |= (words[np.clip(at, 0, len(words) - 1)] == wanted) & (at >= lowest) & (at < highest)
                at += 1
            # one more boundary than words in each row; rows are set apart so that none sees another's sums
            ends = np.cumsum(many + 1)
            score = np.zeros(ends[-1] if len(ends) else 0, dtype=np.int64)
            score[_ranges(ends - many, many)] = EACH * met - (EACH - 1)
            score = np.cumsum(score) - np.repeat(np.arange(len(rows)), many + 1) * (2 * EACH * (len(score) + 1))
            good = np.flatnonzero(score[RUN:] >= np.minimum.accumulate(score)[:-RUN])
            ok[rows[np.unique(np.searchsorted(ends, good + RUN, side="right"))]] = True
        return ok

    def leaked(self, walks, texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(number of the text, item): what the texts leak."""
        from cairn.llm.cgk import leaks

        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        words = np.concatenate([np.empty(0, dtype=np.int64), *texts])
        doc, piece, shift = self.hits(walks, words, begins, sizes)
        doc, piece, step = _distinct(np.stack([doc, piece, shift // STEP]))
        ok = self.near(words, begins, sizes, doc, piece, step * STEP)
        last = None
        for d, p, s in zip(doc[ok].tolist(), piece[ok].tolist(), step[ok].tolist(), strict=True):
            if (d, p) != last and leaks(texts[d], self.words[p], s * STEP - CHANGES, (s + 1) * STEP + CHANGES - 1, RUN, CHANGES):
                last = (d, p)
                yield d, self.ids[p]


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct columns of three rows of numbers, sorted."""
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    return rows[:, new]


def leaked_items(documents: DataFrame, eval_items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id): the documents that hold RUN words of an item in a row, one in eight of them changed.

    Words are runs of letters or digits in lower case; markup, entities, escapes and line prefixes don't
    count. A change is a word replaced, left out or put in. Candidates come from keys sampled from CGK walks of
    windows; each is verified by exact edit distance on the words around it.

    The items are the stated query set: their words and keys are made in Spark, and they are searched for in
    blocks of about `block_words` words, any number of them, so no more than a block is ever on the driver or
    in a task. A block's documents are read once and never shuffled, so no document, source or item is a hot key.
    NULL texts leak nothing; a document that is repeated is reported once; without items, or with items of
    under RUN words of their own, nothing is reported.
    """
    from cairn.session import cut_lineage

    spark = documents.sparkSession
    pieces = cut_lineage(item_pieces(eval_items))
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = -(-total // block_words)
    held = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "piece"), F.lit(max(1, blocks)))).mapInPandas(_keyed, "item_id long, block long, words binary, keys binary")
    if blocks > 1:
        held = cut_lineage(held)
    read = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    found = spark.createDataFrame([], "doc_id long, item_id long")
    for number in range(blocks):
        rows = held.filter(F.col("block") == number).collect()  # about block_words words, however many items there are
        block = spark.sparkContext.broadcast(Block([r["item_id"] for r in rows], [np.frombuffer(r["words"], dtype=np.int64) for r in rows], [np.frombuffer(r["keys"], dtype=np.int64) for r in rows]))
        found = found.unionByName(read.mapInPandas(_searching(block), "doc_id long, item_id long"))
    return found.distinct()


def _searching(block):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cairn.llm.cgk import WordIds, normal_words

        ids, walks = WordIds(), _embedding()
        for batch in batches:
            texts = [np.array([ids[w] for w in normal_words(text)], dtype=np.int64) for text in batch["text"]]
            docs = batch["doc_id"].to_numpy()
            out = [(docs[text], item) for text, item in block.value.leaked(walks, texts)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    return search


def leak_report(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Leaking documents per item, 0 for items that leak nowhere."""
    found = leaked_items(documents, eval_items).groupBy("item_id").agg(F.count("*").alias("n"))
    ids = eval_items.select("item_id", "task").dropDuplicates(["item_id"])
    return ids.join(found, "item_id", "left").select("item_id", "task", F.coalesce("n", F.lit(0)).alias("documents"))

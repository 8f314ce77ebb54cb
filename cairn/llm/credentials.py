"""Credentials in code and configuration, found through a trigram index and redacted (problem 4)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.secrets import DETECTORS
from cairn.llm.trigrams import required_trigrams
from cairn.session import cut_lineage, shared_folder
from cairn.sources.tables import extension

#: Detector -> sets of trigrams, one of which must be in a text wholly; fixed by the patterns, so small by nature.
REQUIRED = {name: required_trigrams(pattern) for name, pattern in DETECTORS.items()}
#: The index's vocabulary: the trigrams that some detector requires; others can't make a candidate.
VOCABULARY = sorted({t for clauses in REQUIRED.values() for clause in clauses for t in clause})
_NUMBERED = [(name, clause) for name, clauses in REQUIRED.items() for clause in clauses]
#: (trigram, clause, bit): which trigrams each clause asks for; fixed by the patterns.
CLAUSES = [(VOCABULARY.index(t), number, bit) for number, (_, clause) in enumerate(_NUMBERED) for bit, t in enumerate(sorted(clause))]
#: Up to so many candidates (a number and a short name each) are broadcast to the texts; more meet them by a shuffle.
BROADCAST_ROWS = 200_000


def texts(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_table, row_id, ext, text) of the snippets of both tables; rows without text are left out."""
    parts = [
        df.select(F.lit(name).alias("source_table"), F.col("id").alias("row_id"), extension().alias("ext"), F.col(column).alias("text"))
        for name, df, column in (("chunks", chunks, "snippet"), ("symbols", symbols, "body_snippet"))
    ]
    return parts[0].unionByName(parts[1]).filter("text is not null and text <> ''")


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _trigrams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Places in the vocabulary of the trigrams that each text holds, whatever their letter case."""
    place = np.full(1 << 24, -1, dtype=np.int16)
    for i, t in enumerate(VOCABULARY):
        place[_code(t)] = i
    for batch in batches:
        raw = [t.encode("utf-8", "replace").lower() for t in batch]
        if not raw:
            yield pd.Series([], dtype=object)
            continue
        ends = np.cumsum([len(r) + 2 for r in raw])
        data = np.frombuffer(b"\0\0".join(raw) + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
        found = place[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(found >= 0)
        pairs = np.unique(np.searchsorted(ends, at, side="right").astype(np.int64) * len(VOCABULARY) + found[at])
        rows, ids = np.divmod(pairs, len(VOCABULARY))
        bounds = np.searchsorted(rows, np.arange(len(raw) + 1))
        ids = ids.astype(np.int32)
        yield pd.Series([ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], index=batch.index)


def trigram_index(rows: DataFrame) -> DataFrame:
    """Postings (trigram, source_table, row_id): the place in VOCABULARY of each of its trigrams in each text."""
    return rows.select(F.explode(_trigrams("text")).alias("trigram"), "source_table", "row_id")


def write_trigram_index(chunks: DataFrame, symbols: DataFrame, folder: str | None = None) -> DataFrame:
    """The postings of both tables, written once, by trigram within each file, and read back.

    The index can be kept: what is given to `credentials` and `redacted_texts` as `index` isn't made again.
    """
    spark = chunks.sparkSession
    folder = folder or f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"
    trigram_index(texts(chunks, symbols)).sortWithinPartitions("trigram", "source_table", "row_id").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def candidates(postings: DataFrame, detectors: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """(source_table, row_id, detectors): the rows in which, by their postings, each detector can match.

    Only postings of trigrams that the detectors ask for are read. They are joined to the clauses that ask for
    them and grouped by row and clause: a row that has all trigrams of one clause is a candidate of its detector.
    A row has a posting per trigram of the vocabulary at most, so no group is large.
    """
    wanted = [c for c in CLAUSES if _NUMBERED[c[1]][0] in detectors]
    asked = postings.sparkSession.createDataFrame(wanted, "trigram int, clause int, bit int")
    rows = postings.filter(F.col("trigram").isin(*sorted({c[0] for c in wanted}))).join(F.broadcast(asked), "trigram")
    met = rows.groupBy("source_table", "row_id", "clause").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    whole = F.array(*(F.lit((1 << len(clause)) - 1) for _, clause in _NUMBERED))
    name = F.array(*(F.lit(n) for n, _ in _NUMBERED))
    full = met.filter(F.col("bits") == F.get(whole, F.col("clause")))
    return full.groupBy("source_table", "row_id").agg(F.collect_set(F.get(name, F.col("clause"))).alias("detectors"))


_PLACES = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("detector", T.StringType())]))


@F.pandas_udf(_PLACES)
def _verified(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from cairn.llm.secrets import find_secrets

    for contents, exts, names in batches:
        yield pd.Series([[{"line_no": line, "detector": name} for name, line, _ in find_secrets(t, e or "", list(d))] for t, e, d in zip(contents, exts, names, strict=True)])


@F.pandas_udf(T.StringType())
def _redacted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from cairn.llm.secrets import redacted

    for contents, exts in batches:
        yield pd.Series([redacted(t, e or "") for t, e in zip(contents, exts, strict=True)])


def _candidate_texts(chunks: DataFrame, symbols: DataFrame, index: DataFrame | None) -> DataFrame:
    """The texts that are candidates, with their detectors; the others aren't shuffled as long as the candidates are
    few enough to be broadcast."""
    found = cut_lineage(candidates(write_trigram_index(chunks, symbols) if index is None else index))
    few = found.count() <= BROADCAST_ROWS
    held = texts(chunks, symbols).join(F.broadcast(found) if few else found, ["source_table", "row_id"])
    return held.dropDuplicates(["source_table", "row_id"])


def credentials(chunks: DataFrame, symbols: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(source_table, row_id, line_no, detector): one row per credential, where its secret begins.

    Texts NULL or empty hold none. A row delivered twice counts once. Of overlapping matches the first and
    longest counts, so a secret is reported once whatever detectors see it. A secret split over joined string
    literals begins in the first of them; a private key begins with its BEGIN line.
    """
    held = _candidate_texts(chunks, symbols, index)
    found = held.select("source_table", "row_id", F.explode(_verified("text", "ext", "detectors")).alias("f"))
    return found.select("source_table", "row_id", "f.line_no", "f.detector")


_OPEN_KEY = r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----(?![\s\S]*-----END )"
_KEY_LINE = r"""^\s*(?:#|//|\*)?\s*["'`]?[A-Za-z0-9+/=]{16,}(?:\\[nr])*["'`]?[\s+,;\\]*$"""


def inner_windows(chunks: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """(source_table, row_id, text) of the windows that lie wholly inside a private key, which begins in an earlier
    window of their file and ends in a later one or nowhere: no pattern can tell them by themselves.

    Islands of windows that follow each other without a gap, the first with an open key, the others with lines of
    a key only. A file's windows are one group, those of other sorts left out before.
    """
    lines = F.split("snippet", "\r?\n")
    body = F.col("snippet").rlike("[A-Za-z0-9+/=]{40}") & F.forall(lines, lambda line: line.rlike(_KEY_LINE))
    rows = chunks.select("id", "codebase_id", "file_path", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), "snippet", F.col("snippet").rlike(_OPEN_KEY).alias("opens"), body.alias("body"))
    rows = rows.filter("opens or body").dropDuplicates(["id"])
    w = Window.partitionBy("codebase_id", "file_path").orderBy("start_line", "id")
    begins = F.col("opens") | F.coalesce(F.lag("end_line").over(w) + 1 < F.col("start_line"), F.lit(True))
    parted = rows.withColumn("island", F.sum(begins.cast("int")).over(w))
    kept = parted.withColumn("key", F.max("opens").over(Window.partitionBy("codebase_id", "file_path", "island"))).filter("key and not opens")
    return kept.select(F.lit("chunks").alias("source_table"), F.col("id").alias("row_id"), F.concat(F.lit(mark), F.repeat(F.lit("\n"), F.size(lines) - 1)).alias("text"))


def redacted_texts(chunks: DataFrame, symbols: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(source_table, row_id, text) of the rows that hold a credential, secrets replaced, all else unchanged.

    Of a private key that windows cut, each part is replaced in its own window.
    """
    inner = inner_windows(chunks)
    held = _candidate_texts(chunks, symbols, index).join(inner.select("source_table", "row_id"), ["source_table", "row_id"], "left_anti").withColumn("clean", _redacted("text", "ext"))
    return held.filter("clean <> text").select("source_table", "row_id", F.col("clean").alias("text")).unionByName(inner)

"""A store of an index as Parquet tables: appends, upserts, deletes, incremental runs, artifacts, and a stream that feeds it.

Tables of a codebase's rows are partitioned by codebase, so that a run rewrites the partitions of the codebases that
it touches and reads no others; catalogue and metadata are small tables that are written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import ingest, manifest
from cairn.session import cut_lineage

CODEBASE, FILE = "codebase_id", ["codebase_id", "file_path"]
#: Tables that an artifact brings, without the catalogue and metadata.
COPIED = ("chunks", "symbols", "edges", "source_files", "indexed_files")
POLICY_KEYS, VERSIONS = ("closed_source", "source_stripped"), ("1", "2")


class Store:
    """Tables in one folder; `small` ones (codebases, codebase_meta, meta) aren't partitioned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def exists(self, name: str) -> bool:
        system, place = self._files(self.path(name))
        return system.exists(place)

    def read(self, name: str) -> DataFrame | None:
        """The table, or None before its first row."""
        if not self.exists(name):
            return None
        df = self.spark.read.parquet(self.path(name))
        return df.withColumn(CODEBASE, F.col(CODEBASE).cast("long")) if CODEBASE in df.columns else df

    def of(self, name: str, codebases: DataFrame) -> DataFrame | None:
        """The rows of some codebases."""
        df = self.read(name)
        return df if df is None else df.join(codebases.select(CODEBASE).distinct(), CODEBASE, "left_semi")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy(CODEBASE).parquet(self.path(name))

    def write_small(self, name: str, rows: DataFrame) -> None:
        cut_lineage(rows).coalesce(1).write.mode("overwrite").parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame, codebases: DataFrame) -> None:
        """Make `rows` all that these codebases have; partitions left without a row are removed."""
        rows = cut_lineage(rows)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(CODEBASE).parquet(self.path(name))
        for row in codebases.select(CODEBASE).distinct().join(rows.select(CODEBASE).distinct(), CODEBASE, "left_anti").toLocalIterator():
            system, place = self._files(f"{self.path(name)}/{CODEBASE}={row[0]}")
            system.delete(place, True)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], gone: DataFrame | None = None) -> None:
        """Put `rows` in the place of those with equal keys; rows whose keys are in `gone` are deleted."""
        out = rows.select(*keys).distinct() if gone is None else rows.select(*keys).unionByName(gone.select(*keys)).distinct()
        touched = out.select(CODEBASE).distinct()
        base = self.of(name, touched)
        self.replace(name, rows if base is None else base.join(out, keys, "left_anti").unionByName(rows, allowMissingColumns=True), touched)

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        """Delete the rows whose keys are in `gone`: whole codebases with [codebase_id], files with FILE."""
        base = self.of(name, gone)
        if base is not None:
            self.replace(name, base.join(gone.select(*keys).distinct(), keys, "left_anti"), gone)

    def register(self, root_path: str, name: str, now: int) -> int:
        """Add a codebase and return its id; a root path that is there already is an error."""
        known = self.read("codebases")
        if known is not None and known.filter(F.col("root_path") == root_path).limit(1).count():
            raise ValueError(f"already registered: {root_path}")
        return self._catalogued(root_path, name, now)

    def codebase(self, codebase_id: int) -> dict:
        """The codebase with this id; an error if there is none."""
        known = self.read("codebases")
        row = known.filter(F.col("id") == codebase_id).first() if known is not None else None
        if row is None:
            raise ValueError(f"no codebase {codebase_id}")
        return row.asDict()

    def _catalogued(self, root_path: str, name: str, now: int) -> int:
        """Upsert on the root path."""
        known = self.read("codebases")
        at = None if known is None else known.filter(F.col("root_path") == root_path).agg(F.min("id")).first()[0]
        last = 0 if known is None else known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        row = self.spark.createDataFrame([(at or last + 1, root_path, name, now)], "id long, root_path string, name string, indexed_at long")
        self.write_small("codebases", row if known is None else manifest.upsert(known, row, ["root_path"]))
        return at or last + 1

    # incremental runs
    def _delta(self, table: str, files: DataFrame) -> DataFrame:
        stored = self.of(table, files)
        now = files.select(*FILE, "file_hash")
        return cut_lineage(manifest.delta(now, now.limit(0) if stored is None else stored.select(*FILE, "file_hash")))

    def index(self, files: DataFrame, now: int) -> DataFrame:
        """Bring chunks and manifest up to `files` (codebase_id, file_path, text), all files of the codebases in it.

        Files that are unchanged by their hash aren't read again; changed and removed ones lose their chunks.
        Returns run_summary's counters. Files are in any number of codebases, each a partition of its own.
        """
        files = files.filter("codebase_id is not null and file_path is not null").dropDuplicates(FILE).withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        states = self._delta("indexed_files", files)
        new = files.join(states.filter("state in ('added', 'changed')").select(*FILE), FILE, "left_semi")
        gone = states.filter("state in ('removed', 'changed')").select(*FILE)
        chunks = cut_lineage(ingest.file_chunks(new).withColumn("indexed_at", F.lit(now).cast("long")))
        counted = chunks.groupBy(*FILE).agg(F.count("*").alias("chunk_count"))
        noted = new.select(*FILE, "file_hash").join(counted, FILE, "left").select(
            *FILE, "file_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(now).cast("long").alias("indexed_at"), F.lit("complete").alias("index_status"), F.lit("").alias("status_reason")
        )
        self.upsert("chunks", chunks, FILE, gone)
        self.upsert("indexed_files", noted, FILE, gone)
        return manifest.run_summary(states)

    def analyse(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, now: int) -> DataFrame:
        """Bring symbols, edges and source files up to `files`, with the symbols and edges that a parser found in them.

        Only rows of added and changed files are taken; an edge belongs to the file that its from_ref begins with.
        A file without symbols is noted with none.
        """
        files = files.filter("codebase_id is not null and file_path is not null").dropDuplicates(FILE).withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        states = self._delta("source_files", files)
        fresh = states.filter("state in ('added', 'changed')").select(*FILE)
        gone = states.filter("state in ('removed', 'changed')").select(*FILE)
        found = cut_lineage(symbols.join(fresh, FILE, "left_semi"))
        counted = found.groupBy(*FILE).agg(F.count("*").alias("symbol_count"))
        new = files.join(fresh, FILE, "left_semi")
        noted = new.join(counted, FILE, "left").select(
            *FILE, ingest.language_of("file_path").alias("language"), ingest.lines_of("text").alias("loc"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), "file_hash", F.lit(now).cast("long").alias("indexed_at")
        )
        owner = F.substring_index("from_ref", ":", 1)
        own = edges.withColumn("file_path", owner).join(fresh, FILE, "left_semi").drop("file_path")
        held = self.of("edges", states)
        kept = own if held is None else manifest.keep_edges_of_other_files(held, gone).unionByName(own, allowMissingColumns=True)
        self.upsert("symbols", found, FILE, gone)
        self.replace("edges", kept, states)
        self.upsert("source_files", noted, FILE, gone)
        return manifest.run_summary(states)

    def rebuild(self, files: DataFrame, now: int) -> DataFrame:
        """A full run: what the codebases have is deleted first."""
        for name in ("chunks", "indexed_files"):
            self.delete(name, files.select(CODEBASE).distinct(), [CODEBASE])
        return self.index(files, now)

    # artifacts
    def load_artifact(self, folder: str, name: str | None = None) -> int:
        """Import an artifact: its codebase by root path, its rows in the place of what that had, its metadata merged.

        The artifact's version must be 1 or 2. Policies come from its codebase_meta or, in old artifacts without
        one, from its global meta. Returns the codebase's id here.
        """
        read = lambda t: self.spark.read.parquet(f"{folder}/{t}.parquet")
        meta = read("meta")
        version = meta.filter("key = 'schema_version'").select("value").first()
        if version is None or version[0] not in VERSIONS:
            raise ValueError("not an artifact of version 1 or 2")
        row = read("codebases").select("root_path", "name", "indexed_at").first()
        if row is None:
            raise ValueError("an artifact without its codebase")
        here = self._catalogued(row["root_path"], name or row["name"], row["indexed_at"])
        one = self.spark.createDataFrame([(here,)], "codebase_id long")
        for table in COPIED:
            self.replace(table, read(table).withColumn(CODEBASE, F.lit(here).cast("long")), one)
        own = meta.filter((F.col("key") != "schema_version") & ~F.col("key").isin(*POLICY_KEYS)).select("key", "value")
        known = self.read("meta")
        self.write_small("meta", own if known is None else manifest.upsert(known, own, ["key"]))
        system, place = self._files(f"{folder}/codebase_meta.parquet")
        scoped = read("codebase_meta").select("key", "value") if system.exists(place) else meta.filter(F.col("key").isin(*POLICY_KEYS)).select("key", "value")
        scoped = scoped.withColumn(CODEBASE, F.lit(here).cast("long")).select(CODEBASE, "key", "value")
        known = self.read("codebase_meta")
        self.write_small("codebase_meta", scoped if known is None else manifest.upsert(known, scoped, [CODEBASE, "key"]))
        return here


def feed(events: DataFrame, files: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str):
    """A streaming query that indexes, in each batch, the codebases that file events (with codebase_id) name.

    `files` gives all files of the codebases handed to it, since an event only says that something changed; a batch
    that is run again after a failure finds nothing changed, so its effect is the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        fired = batch.select(CODEBASE).dropna().distinct()
        if fired.limit(1).count():
            store.index(files(fired), number)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

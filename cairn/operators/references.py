"""Records that refer to keys which are not there (problem 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Types that can be hashed for spreading rows.
PLAIN_TYPES = ("boolean", "byte", "short", "integer", "long", "float", "double", "decimal", "string", "date", "timestamp", "timestamp_ntz", "binary")


def flag_orphans(refs: DataFrame, parent: DataFrame, keys: dict[str, str], flag: str, match: str = "simple", asked: Column | None = None) -> DataFrame:
    """`refs` with a boolean column `flag`: whether the row's composite key has no partner in `parent`.

    `keys` maps columns of `refs` to columns of `parent`. References are grouped by their null mask, and each mask
    is matched on its non-null columns: the mask is part of the join's key, and `parent` has its keys once per mask
    that occurs, so `refs` is joined once whatever the number of masks. The declared match says:

    * simple: a NULL in any key column means there is no reference, so the row is never an orphan;
    * partial: the non-null columns alone must match some parent row; all NULL is never an orphan;
    * full: all NULL is never an orphan, some NULL always is one.

    Rows for which `asked` doesn't hold are no orphans; they and others without a reference are spread over the
    join's tasks. Defined cases: NULLs in parent keys match nothing; repeated rows of `refs` are all returned;
    columns of `refs` keep their names whatever `parent` calls its own; empty `parent` makes every non-null
    reference an orphan; empty `refs` gives an empty result. A hot key on the side of `refs` is split by AQE, as
    that side is streamed; the parent side is one row per key and mask.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match: {match}")
    if not keys:
        raise ValueError("keys must not be empty")
    kids = list(keys)
    none, every = "0" * len(kids), "1" * len(kids)
    mask = F.when(F.lit(True) if asked is None else F.coalesce(asked, F.lit(False)), F.concat(*(F.when(F.col(k).isNull(), "0").otherwise("1") for k in kids))).otherwise(none)
    masks = [every]
    if match == "partial" and len(kids) > 1:  # which masks occur: two to the number of keys at most
        masks = sorted(r[0] for r in refs.select(mask.alias("m")).distinct().collect() if r[0] != none)
    seen = F.col("__mask").isin(*masks) if masks else F.lit(False)
    # by the row's own content, so that a task that is run again sends its rows to the same places
    plain = [f.name for f in refs.schema.fields if f.dataType.typeName() in PLAIN_TYPES]
    rows = refs.withColumn("__mask", mask)
    rows = rows.withColumn("__key", F.when(seen, F.col("__mask")).otherwise(F.pmod(F.xxhash64(*plain), F.lit(1024)).cast("string")))
    parts = []
    for one in masks:
        there = [i for i, m in enumerate(one) if m == "1"]
        columns = [F.col(keys[kids[i]]) if i in there else F.lit(None).cast(parent.schema[keys[kids[i]]].dataType) for i in range(len(kids))]
        parts.append(parent.filter(reduce(lambda x, y: x & y, (F.col(keys[kids[i]]).isNotNull() for i in there))).select(F.lit(one).alias("__of"), *(c.alias(f"__{i}") for i, c in enumerate(columns))).distinct())
    orphan = F.lit(False)
    if parts:
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(kids)], F.col("__key") == F.col("__of"))
        rows = rows.join(reduce(DataFrame.unionByName, parts), same, "left")
        orphan = seen & F.col("__of").isNull()
    if match == "full":
        orphan = orphan | ~F.col("__mask").isin(none, every)
    return rows.select(*(rows[c] for c in refs.columns), orphan.alias(flag))


def orphan_references(refs: DataFrame, parent: DataFrame, keys: dict[str, str], match: str = "simple") -> DataFrame:
    """The rows of `refs` whose composite key has no partner in `parent`: see flag_orphans."""
    return flag_orphans(refs, parent, keys, "__orphan", match).filter("__orphan").drop("__orphan")


def index_orphans(edges: DataFrame, runs: DataFrame, codebases: DataFrame, symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """Orphans of a code index: (source_table, row_id, reason, period), one row per record and reason.

    `codebase_id` and `target_codebase_id` refer to `codebases.id` (match simple). A resolved edge refers by
    (to_kind, scope, to_ref) to a symbol's name or qualified name or to a file's path, scope being
    target_codebase_id or else codebase_id (match partial: without any scope, the name may be anywhere).
    Parents count whenever they arrived. `period` is the first day of the record's calendar month (UTC),
    NULL where the record has no time. Rows delivered twice count once.
    """
    edge = edges.select(
        F.lit("edges").alias("source_table"),
        F.col("id").alias("row_id"),
        "codebase_id",
        "target_codebase_id",
        "to_kind",
        F.coalesce("target_codebase_id", "codebase_id").alias("scope"),
        "to_ref",
        "resolved",
        F.trunc(F.timestamp_seconds("indexed_at").cast("date"), "month").alias("period"),
    )
    run = runs.select(
        F.lit("metric_index_runs").alias("source_table"),
        F.col("id").alias("row_id"),
        "codebase_id",
        F.trunc(F.timestamp_millis("recorded_at").cast("date"), "month").alias("period"),
    )
    names = (
        symbols.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("ref"), "codebase_id")
        .select(F.lit("symbol").alias("kind"), "codebase_id", "ref")
        .unionByName(source_files.select(F.lit("file").alias("kind"), "codebase_id", F.col("file_path").alias("ref")))
    )

    rows = edge.unionByName(run, allowMissingColumns=True)
    rows = flag_orphans(rows, codebases, {"codebase_id": "id"}, "no_codebase")
    rows = flag_orphans(rows, codebases, {"target_codebase_id": "id"}, "no_target")
    rows = flag_orphans(rows, names, {"to_kind": "kind", "scope": "codebase_id", "to_ref": "ref"}, "no_name", "partial", F.col("resolved") == 1)
    reasons = F.array_compact(F.array(*(F.when(F.col(flag), F.lit(reason)) for flag, reason in (("no_codebase", "codebase_id"), ("no_target", "target_codebase_id"), ("no_name", "to_ref")))))
    return rows.select("source_table", "row_id", F.explode(reasons).alias("reason"), "period").dropDuplicates(["source_table", "row_id", "reason"])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan records per table, calendar month and reason; a record with two reasons counts under both."""
    return orphans.groupBy("source_table", "period", "reason").agg(F.count("*").alias("orphans"))

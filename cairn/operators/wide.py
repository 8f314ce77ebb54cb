"""Entity, attribute, value rows to one typed row per entity (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE = ("true", "t", "yes", "y", "on", "1")
FALSE = ("false", "f", "no", "n", "off", "0")
#: Spellings of "no value", compared in lower case after trimming.
NO_VALUE = ("", "-", "--", "~", "?", "n/a", "na", "#n/a", "nan", "null", "nil", "none", "(none)", "(null)", "unknown", "undefined", "tbd", "tba", "not available", "not applicable", "missing", "empty")
TYPES = {"boolean": T.BooleanType(), "integer": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "string": T.StringType()}
#: Declared attributes become columns of the plan; the table of them is small by nature and checked against this.
MAX_ATTRIBUTES = 2000


def normal_key(key: Column) -> Column:
    """A key without letter case and separators."""
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def _number(value: Column) -> Column:
    """Digits without grouping marks, where the marks group by three; otherwise unchanged."""
    grouped = value.rlike(r"^[+-]?\d{1,3}(([,_ '\x{00A0}\x{202F}])\d{3})(\2\d{3})*(\.\d*)?([eE][+-]?\d+)?$")
    return F.when(grouped, F.regexp_replace(value, r"[,_ '\x{00A0}\x{202F}]", "")).otherwise(value)


def _first(*columns: Column) -> Column:
    return F.coalesce(*columns)


def _date(value: Column) -> Column:
    """A date in any of the common notations; bound once by a lambda, which keeps the generated code small."""
    return F.transform(F.array(value), _any_date)[0]


def _any_date(value: Column) -> Column:
    def at(pattern: str, form: str) -> Column:
        found = F.regexp_extract(value, pattern, 1)
        return F.when(value.rlike(pattern), F.try_to_timestamp(found, F.lit(form)).cast("date"))

    tail = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?)?$"
    day_first = at(r"^(\d{1,2}/\d{1,2}/\d{4})" + tail, "d/M/yyyy")
    month_first = at(r"^(\d{1,2}/\d{1,2}/\d{4})" + tail, "M/d/yyyy")
    month = F.initcap(F.regexp_replace(value, r"[.,]", ""))

    def named(pattern: str, form: str) -> Column:
        return F.when(month.rlike(pattern), F.try_to_timestamp(month, F.lit(form)).cast("date"))

    epoch = F.when(value.rlike(r"^\d{9,10}$"), F.timestamp_seconds(F.try_to_number(value, F.lit("9999999999")).cast("long")).cast("date"))
    millis = F.when(value.rlike(r"^\d{12,13}$"), F.timestamp_millis(F.try_to_number(value, F.lit("9999999999999")).cast("long")).cast("date"))
    return _first(
        at(r"^(\d{4}-\d{1,2}-\d{1,2})" + tail, "yyyy-M-d"),
        at(r"^(\d{4}/\d{1,2}/\d{1,2})" + tail, "yyyy/M/d"),
        at(r"^(\d{4}\.\d{1,2}\.\d{1,2})" + tail, "yyyy.M.d"),
        at(r"^(\d{8})$", "yyyyMMdd"),
        day_first,
        month_first,
        at(r"^(\d{1,2}\.\d{1,2}\.\d{4})" + tail, "d.M.yyyy"),
        at(r"^(\d{1,2}-\d{1,2}-\d{4})" + tail, "d-M-yyyy"),
        named(r"^\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}$", "d[ ][-]MMM[ ][-]yyyy"),
        named(r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
        named(r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
        named(r"^[A-Za-z]{4,9} \d{1,2} \d{4}$", "MMMM d yyyy"),
        epoch,
        millis,
    )


def read_as(value: Column, kind: str) -> Column:
    """`value` as a whole read as `kind`, NULL where it can't be; blanks and words for "no value" never can.

    Both orders of day and month in 1/2/2024 exist; day first is tried first. Numbers may be padded, signed
    and grouped by three with `,`, `_`, a blank or an apostrophe; an integer may end in `.0`. Values beyond
    64 bits can't be read. NaN and infinities are no values.
    """
    bare = _bare(value)
    there = ~F.lower(bare).isin(*NO_VALUE)
    if kind == "boolean":
        read = F.when(F.lower(bare).isin(*TRUE), True).when(F.lower(bare).isin(*FALSE), False)
    elif kind == "integer":
        number = _number(bare)
        read = F.when(number.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(number, r"\.0*$|^\+", "").try_cast("bigint"))
    elif kind == "double":
        number = _number(bare)
        read = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast("double"))
        read = F.when(~F.isnan(read) & (F.abs(read) < float("inf")), read)
    elif kind == "date":
        read = _date(bare)
    elif kind == "string":
        read = bare
    else:
        raise ValueError(f"unknown value_type: {kind}")
    return F.when(there, read)


def declared(attributes: DataFrame) -> list[tuple[str, str]]:
    """(attribute, value_type) of the wide table in the order of their names; at most MAX_ATTRIBUTES."""
    rows = attributes.select("attribute", "value_type").dropna().distinct().orderBy("attribute", "value_type").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes: keep them long")
    names = [r[0] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("an attribute is declared with two types")
    return [(r[0], r[1]) for r in rows]


def readable_cells(values: DataFrame, attributes: list[tuple[str, str]], entity: str = "codebase_id", key: str = "key", value: str = "value") -> DataFrame:
    """(entity, position, cell): one plainly written value per entity and attribute, the least text of those read.

    Pre-aggregated by map-side minimum, so an entity with any number of repeated cells is no hot group. Rows
    with a NULL entity, an undeclared key or an unreadable value give no cell.
    """
    position = F.create_map(*(F.lit(x) for i, (name, _) in enumerate(attributes) for x in ("".join(c for c in name.lower() if c.isalnum()), i)))
    rows = values.select(F.col(entity).alias("entity"), position[normal_key(F.col(key))].alias("position"), F.col(value).alias("cell"))
    kinds = F.array(*(F.lit(kind) for _, kind in attributes)) if attributes else F.array(F.lit(""))
    rows = rows.filter(F.col("entity").isNotNull() & F.col("position").isNotNull())
    plain = F.lit(None).cast("string")
    for kind in dict.fromkeys(kind for _, kind in attributes):
        plain = F.when(F.get(kinds, F.col("position")) == kind, read_as(F.col("cell"), kind).cast("string")).otherwise(plain)
    return rows.withColumn("cell", plain).filter(F.col("cell").isNotNull()).groupBy("entity", "position").agg(F.min("cell").alias("cell"))


def wide_table(values: DataFrame, attributes: DataFrame, entity: str = "codebase_id", key: str = "key", value: str = "value") -> DataFrame:
    """One row per entity with a typed column per declared attribute, NULL where no value can be read.

    The grid of entities and attribute positions is completed, readable cells are left-joined to it, collected
    per entity in the order of their positions and projected by fixed index. Every entity of `values` gets a
    row, also one without any readable cell. Other columns of `values` are ignored.
    """
    names = declared(attributes)
    entities = values.select(F.col(entity).alias("entity")).dropna().distinct()
    if not names:
        return entities.withColumnRenamed("entity", entity)
    grid = entities.select("entity", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("position"))
    filled = grid.join(readable_cells(values, names, entity, key, value), ["entity", "position"], "left")
    cells = filled.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("position", "cell"))).alias("cells"))
    return cells.select(
        F.col("entity").alias(entity),
        *(F.get(F.col("cells"), F.lit(i))["cell"].try_cast(TYPES[kind]).alias(name) for i, (name, kind) in enumerate(names)),
    )


def filled_cells(wide: DataFrame, entity: str = "codebase_id") -> DataFrame:
    """(entity, attribute) of the cells of a wide table that hold a value."""
    names = [c for c in wide.columns if c != entity]
    if not names:
        return wide.select(entity, F.lit("").alias("attribute")).limit(0)
    held = F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in names))
    return wide.select(entity, F.explode(F.array_compact(held)).alias("attribute"))

import datetime

import pytest
from pyspark.sql import functions as F

from cairn.operators import wide

READ = [
    ("boolean", " Yes", True), ("boolean", "off", False), ("boolean", "1", True), ("boolean", "2", None), ("boolean", "tru e", None), ("boolean", "yes/no", None),
    ("integer", " 6127 ", 6127), ("integer", "+10,928", 10928), ("integer", "9_002", 9002), ("integer", "1O1", None), ("integer", "12 or 13", None), ("integer", "1,23", None), ("integer", "99999999999999999999", None),
    ("double", ".565", 0.565), ("double", "4.156e-01", 0.4156), ("double", "39,225.6", 39225.6), ("double", "0.8.2", None), ("double", "1.2.3e", None), ("double", "NaN", None),
    ("date", "20220119", datetime.date(2022, 1, 19)), ("date", "1703040439", datetime.date(2023, 12, 20)), ("date", "2023-08-20T21:27:14Z", datetime.date(2023, 8, 20)), ("date", "19 Aug 2023", datetime.date(2023, 8, 19)),
    ("date", "31/12/2024", datetime.date(2024, 12, 31)), ("date", "12/31/2024", datetime.date(2024, 12, 31)), ("date", "31/31/2024", None), ("date", "2023-02-30", None), ("date", "0000-00-00", None), ("date", "Q3", None),
    ("string", " JOURNAL ", "JOURNAL"), ("string", "n/a", None), ("string", "-", None), ("string", "  ", None), ("string", None, None),
]


def test_values(spark):
    for kind in ("boolean", "integer", "double", "date", "string"):
        rows = [(i, v) for i, (k, v, _) in enumerate(READ) if k == kind]
        got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, value string").select("i", wide.read_as(F.col("value"), kind).alias("v")).collect()}
        assert {i: READ[i][2] for i, _ in rows} == got


def test_grid(spark):
    attributes = spark.createDataFrame([("size_mb", "double"), ("archived", "boolean"), ("owner_team", "string")], "attribute string, value_type string")
    rows = [(1, "SizeMb", "n/a"), (1, "size.mb", "2.5"), (1, "size-mb", "2.5"), (1, "x_more", "9"), (2, "Archived", "Y"), (2, None, "Y"), (3, "owner team", None), (None, "size_mb", "1")]
    values = spark.createDataFrame([(*r, "extra") for r in rows], "codebase_id long, key string, value string, attribute string")
    out = wide.wide_table(values, attributes)
    assert {r.codebase_id: (r.archived, r.owner_team, r.size_mb) for r in out.collect()} == {1: (None, None, 2.5), 2: (True, None, None), 3: (None, None, None)}
    assert dict(out.dtypes) == {"codebase_id": "bigint", "archived": "boolean", "owner_team": "string", "size_mb": "double"}
    assert sorted((r.codebase_id, r.attribute) for r in wide.filled_cells(out).collect()) == [(1, "size_mb"), (2, "archived")]
    assert wide.wide_table(values.limit(0), attributes).count() == 0
    assert wide.wide_table(values, attributes.limit(0)).columns == ["codebase_id"]


def test_a_type_twice_is_refused(spark):
    with pytest.raises(ValueError):
        wide.declared(spark.createDataFrame([("a", "double"), ("a", "date")], "attribute string, value_type string"))

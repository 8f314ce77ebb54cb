import itertools
import random

import pytest

from cairn.operators.references import orphan_references

REFS, PARENT = "id int, a string, b int, note string", "a string, k int, note string"


def brute(refs, parents, match):
    out = []
    for i, a, b, _ in refs:
        nulls = (a is None) + (b is None)
        if nulls == 2 or (nulls and match == "simple"):
            continue
        if nulls and match == "full":
            out.append(i)
        elif not any((a is None or a == x) and (b is None or b == y) and not (a is not None and x is None) for x, y, _ in parents):
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_null_masks_against_brute_force(spark, match):
    random.seed(3)
    values = [None, "x", "y", "z"]
    refs = [(i, random.choice(values), random.choice([None, 1, 2, 3]), "r") for i in range(200)]
    refs += refs[:5]  # repeated rows stay repeated
    parents = [(a, b, "p") for a, b in itertools.product([None, "x", "y"], [None, 1, 2]) if random.random() < 0.6] * 2
    found = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENT), {"a": "a", "b": "k"}, match)
    assert found.columns == ["id", "a", "b", "note"]
    assert sorted(r.id for r in found.collect()) == brute(refs, parents, match)


def test_empty_tables(spark):
    refs, parents = spark.createDataFrame([(1, "x", 1, "")], REFS), spark.createDataFrame([], PARENT)
    assert orphan_references(refs, parents, {"a": "a"}).count() == 1
    assert orphan_references(refs.limit(0), parents, {"a": "a"}).count() == 0
    with pytest.raises(ValueError):
        orphan_references(refs, parents, {"a": "a"}, "some")

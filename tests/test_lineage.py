"""Walks over chains that are longer than the limit of rewinds, on the driver and by joins."""

import pytest

from tablegraft.operators import lineage

N = lineage.LIMIT + 4


def chain(spark):
    rows = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(N)] + [("left", f"c{N - 1}"), ("right", "c1"), ("stray", "c0")]
    return spark.createDataFrame(rows, "id string, parent string").coalesce(1).cache()


def test_common_ancestor_deeper_than_the_limit(spark):
    assert [r.id for r in lineage.common_ancestor(chain(spark), "left", "right").collect()] == ["c1"]


def test_real_ancestors_are_never_prunable(spark):
    assert sorted(r.id for r in lineage.prunable(chain(spark), "left").collect()) == ["right", "stray"]


@pytest.mark.parametrize("head", ["d", "g", "p", "o", "none"])
@pytest.mark.parametrize("limit", [2, 500])
def test_joins_walk_as_the_driver_does(spark, head, limit):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("f", "b"), ("g", "f"), ("p", "q"), ("q", "r"), ("r", "p"), ("o", "missing")]
    commits = spark.createDataFrame(rows, "id string, parent string")
    want = [(x, k) for k, x in enumerate(lineage.walk(dict(rows), head, limit))]
    for most in (0, 1000):
        assert sorted((r.id, r.depth) for r in lineage.ancestors(commits, head, limit, most).collect()) == sorted(want)


def test_a_long_chain_by_joins(spark):
    rows = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(70)]
    got = lineage.ancestors(spark.createDataFrame(rows, "id string, parent string"), "c69", driver_rows=0).collect()
    assert sorted((r.depth, r.id) for r in got) == [(k, f"c{69 - k}") for k in range(70)]

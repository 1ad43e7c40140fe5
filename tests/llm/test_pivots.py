import math
from fractions import Fraction

import numpy as np
import pytest

from tablegraft.llm import pivots


def brute(rows, k, every):
    use = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            use.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    width = max((len(v) for _, v in use), default=0)
    use = [(i, v + [0] * (width - len(v))) for i, v in use]
    out = []
    for q, v in use:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in use if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32)]) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(40)] + [(700, [0.0] * 12), (701, [5.0, 1.0])]
    rows += [(800, None), (801, []), (802, [float("nan")] * 12), (803, [float("inf")] * 12), (804, [None] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, pivots.top_k(df, 10, every=50).collect()))
    assert got == brute(rows, 10, 50)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivots.top_k(df).collect()] == brute(rows, 10, 100)
    assert pivots.top_k(df.where("vec_id > 5")).count() == 0


def exact(rows, k, every):
    """By fractions, whatever the size."""
    width = max(len(v) for _, v in rows)
    use = [(i, [math.floor(Fraction(x) * 1024) for x in v] + [0] * (width - len(v))) for i, v in rows]
    out = []
    for q, v in use:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in use if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_large_components_stay_exact(spark):
    """Components far beyond what doubles tell apart, whose products cancel or stay small."""
    rng = np.random.default_rng(5)
    rows = [(0, [3e30, 1.0, 0.0, 0.25]), (1, [0.0, -1.0, 1e300]), (2, [1e-30, 5.0, -1e300]), (3, [0.0, 1e6]), (50, [0.0, 3e5, 0.0]), (305, [0.0, 0.0, 0.0, 2.0**43 + 0.5])]
    rows += [(100 + i, [0.0, float(rng.normal() * 1e6)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact(rows, 3, 50)
    assert sorted(map(tuple, pivots.top_k(df, 3, every=50).collect())) == want and any(abs(r[3]) > 1 << 53 for r in want)


@pytest.mark.parametrize("vectors", [[(0, [1e12]), (1, [1e12])], [(0, [1e12]), (1, [-1e12])]])
def test_scores_beyond_a_long_are_an_error(spark, vectors):
    with pytest.raises(Exception, match="a score of query 0 doesn't fit a long"):
        pivots.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()


def test_scores_below_a_long_do_no_harm_outside_the_k_highest(spark):
    rows = [(0, [1e12, 0.0]), *[(i, [-1e12, 1.0]) for i in range(1, 5)], (7, [1.0, 1.0]), (8, [2.0, 0.0])]
    got = pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    assert [r.vec_id for r in got] == [8, 7]


def test_groups_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, pivots.top_k(df, 5, every=3, most_bytes=b, least_blocks=n).collect())) for b, n in ((48 << 20, 2), (8 * 6 * 150, 8)))
    assert one == many == exact(rows, 5, 3)


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_search_stops_early_but_misses_nothing(n):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, 3)) * 1000).astype(np.int64)
    x[: n // 2] = x[0]
    table = pivots.PivotTable(np.arange(n), x / 1024, 16)
    for q in range(0, n, max(1, n // 20)):
        scores = x @ x[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert [(-s, i) for s, i in table.search(x[q] / 1024, q, 10)] == want
        if len(want) == 10:
            assert [(-s, i) for s, i in table.search(x[q] / 1024, q, 10, -want[-1][0])] == want

"""Operator 8: exact top-k search by inner product with pivot-table elimination.

With every candidate given one more coordinate that brings it to a common norm, the largest inner product is the smallest
distance, so the triangle inequality applies: a candidate is at least as far from the query as the two's distances to any
pivot differ. Candidates lie in blocks; a block holds a table of distances from its candidates to its pivots (chosen farthest
first), which gives each query the greatest of its lower bounds for each candidate. Candidates are evaluated in the order of
their bounds, in exact integers, until no bound can reach the k-th score found so far, ties included.

Each query first meets one block, which gives it a k-th score; with that as a bound to begin with it meets all others. Blocks and
groups of queries are of bounded size, and every pair of them is a task of its own; the blocks' results of k rows are merged by
query.

Vectors that are null, empty, or hold null or non-finite components take no part, as query or candidate; shorter vectors count
as padded with zeros. Components of any size count exactly: where products could leave the whole numbers that doubles hold, sums
are made in long or unbounded integers. A score among the k highest that a long can't hold is an error that names the query.
Ties go to the smaller id, repeated ids are rows of their own (an id is never a candidate of itself); null ids take no part. An
empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, even_labels, materialise

LONG = 1 << 63
#: Up to here a component times 1024 is a whole number that doubles tell from its neighbours.
PLAIN = float(1 << 42)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): vectors without null or non-finite components, as doubles."""
    x = col(embedding).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(col(vec_id).isNotNull() & col(embedding).isNotNull() & fine & (F.size(x) > 0)).select(col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def whole(x: float) -> int:
    """floor(1024 x), exactly."""
    return int(x) * 1024 if abs(x) >= 1 << 53 else math.floor(x * 1024)


class PivotTable:
    """A block of candidates: vectors times 1024 as whole numbers, and distances (of vectors brought to one norm) to pivots among
    them. Blocks with components beyond PLAIN have no such table: all of their candidates are evaluated."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: int = 32):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.plain = not len(x) or float(np.abs(x).max()) <= PLAIN
        if not self.plain:
            return
        self.f = np.floor(self.x * 1024)
        squares = (self.f**2).sum(1)
        self.top = float(squares.max())
        self.lift = np.sqrt(np.maximum(self.top - squares, 0))
        far, chosen = np.full(len(ids), np.inf), [int(np.argmax(squares))]
        columns = []
        while True:
            columns.append(self._to(self.f[chosen[-1]], self.lift[chosen[-1]]))
            far = np.minimum(far, columns[-1])
            if len(columns) >= min(pivots, len(ids)) or far.max() <= 0:
                break
            chosen.append(int(np.argmax(far)))
        self.pivots, self.table = np.array(chosen), np.stack(columns, axis=1)

    def _to(self, v: np.ndarray, lift: float) -> np.ndarray:
        d = self.f - v
        return np.sqrt((d * d).sum(1) + (self.lift - lift) ** 2)

    def _exact(self, at: np.ndarray, q: np.ndarray, f: np.ndarray | None, size: float) -> list[int]:
        """Inner products; `size` bounds each of their partial sums."""
        if size < 2.0**52:
            return (self.f[at] @ f).astype(np.int64).tolist()
        if size < 2.0**62:
            return (self.f[at].astype(np.int64) @ f.astype(np.int64)).tolist()
        own = [whole(c) for c in q.tolist()]
        return [sum(a * b for a, b in zip(map(whole, row), own, strict=True)) for row in self.x[at].tolist()]

    def search(self, q: np.ndarray, own: int, k: int, cut: int | None = None, step: int = 64) -> list[tuple[int, int]]:
        """The k best (score, vec_id), ties to smaller ids; those below `cut` may be left out."""
        if not self.plain or float(np.abs(q).max()) > PLAIN:
            at = np.flatnonzero(self.ids != own)
            return [(-s, i) for s, i in sorted(zip((-s for s in self._exact(at, q, None, math.inf)), self.ids[at].tolist(), strict=True))[:k]]
        f = np.floor(q * 1024)
        square = float(f @ f)
        d = f - self.f[self.pivots]
        to = np.sqrt((d * d).sum(1) + self.lift[self.pivots] ** 2)
        bound = np.abs(self.table - to).max(axis=1)
        slack = 1e-9 * (square + self.top) + 1
        most = (square + self.top - bound**2) / 2 + slack  # no score of a candidate is above this
        open_ = np.flatnonzero((self.ids != own) & (most >= (-math.inf if cut is None else cut)))
        order = open_[np.argsort(-most[open_], kind="stable")]
        found: list[tuple[int, int]] = []
        at, size = 0, math.sqrt(square * self.top) * (1 + 1e-9)
        while at < len(order):
            if len(found) == k and most[order[at]] < -found[-1][0]:
                break
            part = order[at : at + step]
            found = sorted([*found, *zip((-s for s in self._exact(part, q, f, size)), self.ids[part].tolist(), strict=True)])[:k]
            at, step = at + step, min(2 * step, 4096)
        return [(-s, i) for s, i in found]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    lengths, values = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    out[rows, np.arange(len(values)) - starts[rows]] = values
    return out


def top_k(
    vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, pivots: int = 32, most_bytes: int = 48 << 20, least_blocks: int = 8,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all rows. Blocks of candidates and
    groups of queries hold about `most_bytes` at most."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    asks = F.col("vec_id") % every == 0
    n, width, n_asks = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(asks)).first()
    fit = max(1, most_bytes // (8 * (width or 1) + 64))
    blocks, groups = max(least_blocks, math.isqrt(n) // 16, -(-n // fit)), max(1, -(-n_asks // fit))
    place = F.xxhash64("vec_id", F.monotonically_increasing_id())
    rows = materialise(rows.select("*", F.pmod(place, F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group")), "vectors")
    queries = rows.where(asks).select("vec_id", "v", "group")

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int]] = []
        if own.num_rows and asked.num_rows:
            table = PivotTable(own.column("vec_id").to_numpy(), _matrix(own.column("v"), width), pivots)
            for i, cut, q in zip(asked.column("query").to_pylist(), asked.column("cut").to_pylist(), _matrix(asked.column("q"), width), strict=True):
                for s, v in table.search(q, i, k, cut):
                    if s >= LONG:
                        raise OverflowError(f"a score of query {i} doesn't fit a long")
                    out.append((i, v, s if s >= -LONG else None))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    def search(first: int, to: int, asked: DataFrame) -> DataFrame:
        """Blocks from `first` on against queries with a `cut`; each pair of a block and a group is a task of its own."""
        count = (to - first) * groups
        cells = F.array(*map(F.lit, even_labels(spark, count))) if 1 < count <= 4096 else None
        cell = lambda block, group: (F.element_at(cells, (block - first) * groups + group + 1) if cells is not None else (block - first) * groups + group).cast("int")
        here = rows.where(F.col("block").between(first, to - 1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(cell(F.col("block"), F.col("group")).alias("cell"), "vec_id", "v")
        there = asked.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(to - 1)))).select(cell(F.col("block"), F.col("group")).alias("cell"), F.col("vec_id").alias("query"), F.col("v").alias("q"), "cut")
        parts = min(count, 20_000)
        return here.repartition(parts, "cell").groupBy("cell").cogroup(there.repartition(parts, "cell").groupBy("cell")).applyInArrow(run, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    begun = materialise(search(0, 1, queries.withColumn("cut", F.lit(None).cast("long"))), "begun")
    cuts = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("cut"), F.count_if(F.col("score").isNull()).alias("under")).where((F.col("n") == k) & (F.col("under") == 0))
    cut = queries.join(cuts.select(F.col("query_id").alias("vec_id"), "cut"), "vec_id", "left")
    score = F.when(F.col("score").isNull(), F.raise_error(F.concat(F.lit("a score of query "), F.col("query_id").cast("string"), F.lit(" doesn't fit a long"))).cast("long")).otherwise(F.col("score"))
    return merged(begun.unionByName(search(1, blocks, cut))).select("query_id", "rank", "vec_id", score.alias("score"))

"""Backfill: a table rewritten range by range into a new version, each range an own directory that can be written again.

Without a controller a few ranges of about equally many rows (`quantile_cuts`) are one Spark job each: a table that isn't sorted by
key is scanned no more often than there are ranges, a sorted one once, as parquet statistics prune the rest. With a controller,
which holds a migration back beside other work, ranges are key intervals whose size adapts to how long the last one took."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted

START, LEAST, MOST = 10_000, 100, 500_000
ROWS_A_RANGE, MOST_RANGES = 200_000_000, 16


@dataclass
class Controller:
    """Batch size in key values: halved over slow_ms, half as much again under fast_ms."""

    size: int = START
    least: int = LEAST
    most: int = MOST
    slow_ms: float = 1000
    fast_ms: float = 200

    def after(self, ms: float) -> int:
        if ms > self.slow_ms:
            self.size = max(self.least, self.size // 2)
        elif ms < self.fast_ms:
            self.size = min(self.most, self.size * 3 // 2)
        return self.size


def bounds(rows: DataFrame, key: str) -> tuple[int | None, int | None, int]:
    k = F.col(quoted(key))
    r = rows.agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count("*").alias("n")).first()
    return r.lo, r.hi, r.n


def ranges_for(rows: int, a_range: int = ROWS_A_RANGE, most: int = MOST_RANGES) -> int:
    return max(1, min(most, -(-rows // a_range)))


def quantile_cuts(rows: DataFrame, key: str, batches: int) -> list[int]:
    """Upper bounds of about equally many rows each, whatever gaps the keys have; the last is the greatest key."""
    if batches < 2:
        return [rows.agg(F.max(quoted(key))).first()[0]]
    at = [k / batches for k in range(1, batches + 1)]
    return sorted(set(rows.select(F.percentile_approx(quoted(key), at, 10_000)).first()[0]))


def by_value(lo: int, hi: int, control: Controller, cursor: int | None = None) -> Iterator[tuple[int, int]]:
    """Intervals (after, upto] from lo - 1 or the cursor up to hi; the size is read anew for each."""
    at = lo - 1 if cursor is None else cursor
    while at < hi:
        to = min(at + control.size, hi)
        yield at, to
        at = to


def remaining(rows: DataFrame, key: str, cursor: int) -> DataFrame:
    """Rows that a backfill with this cursor hasn't written."""
    return rows.where(F.col(quoted(key)) > cursor)


def run(
    rows: DataFrame, key: str, column: str, value: Column, path: str, cursor: int | None = None, control: Controller | None = None,
    progress: Callable[[dict], None] = lambda e: None, cuts: list[int] | None = None, limit: tuple[int, int, int] | None = None, a_range: int = ROWS_A_RANGE,
) -> dict:
    """Writes `rows` with `column` = value to path/batch=<upper bound>. Begins after the cursor; progress gets the cursor once a
    range is written. Keys are whole numbers; rows with a null key are written first, as batch=null. Ranges are `cuts`, else the
    controller's, else quantiles of the rows that are left."""
    lo, hi, n = limit or bounds(rows, key)
    if not n:
        return {"rows": 0, "total": 0, "batches": 0, "cursor": cursor}
    k, filled = F.col(quoted(key)), rows.withColumn(column, value)
    if cursor is None:
        rest = filled.where(k.isNull())
        if rest.take(1):
            rest.write.mode("overwrite").parquet(f"{path}/batch=null")
    done = batches = 0
    spent = 0.0
    whole = lo is not None and isinstance(lo, int) and isinstance(hi, int)
    if not whole:  # a key without distances: one range
        filled.where(k.isNotNull()).write.mode("overwrite").parquet(f"{path}/batch=all")
        return {"rows": n, "total": n, "batches": 1, "cursor": None}
    if not cuts and not control:
        left = rows if cursor is None else remaining(rows, key, cursor)
        cuts = [hi] if ranges_for(n, a_range) == 1 else [c for c in quantile_cuts(left, key, ranges_for(n, a_range)) if c is not None]
        cuts = [*[c for c in cuts if c < hi], hi]
    spans = zip([lo - 1 if cursor is None else cursor, *cuts[:-1]], cuts, strict=True) if cuts else by_value(lo, hi, control, cursor)
    for after, upto in spans:
        if cursor is not None and upto <= cursor:
            continue
        began = time.monotonic()
        part = filled.where((k > after) & (k <= upto))
        part.write.mode("overwrite").parquet(f"{path}/batch={upto}")
        ms = 1000 * (time.monotonic() - began)
        spent += ms / 1000
        batches += 1
        if control:
            control.after(ms)
        done = upto - lo + 1
        left_s = (hi - upto) * spent / max(1, done)
        progress({"cursor": upto, "keys_done": done, "keys_total": hi - lo + 1, "rows_total": n, "ms": round(ms), "eta_s": round(left_s, 1), "next": control.size if control else None})
    return {"rows": n, "total": n, "batches": batches, "cursor": hi}

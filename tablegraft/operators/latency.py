"""Latency summaries: nearest-rank percentiles, bucketed sparklines and downsampling.

Rows are counted by value first. Ranks are running sums over ranges of values, whose number follows from how many values there
are, so that no task sorts more than a range, whatever the input, the bucket or the number of equal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

RANGE = 1 << 20


def _nth(p: float, n: Column) -> Column:
    return F.least(n - 1, F.floor(F.lit(p) / 100 * n))


def ranged(df: DataFrame, by: list[str], rows: int, a_range: int = RANGE) -> DataFrame:
    """df, written once, with `_part`: the number of the range in the order of `by` that a row lies in."""
    parts = max(1, -(-rows // a_range))
    dealt = df.repartitionByRange(parts, *by) if parts > 1 else df.coalesce(1)
    return written(dealt.withColumn("_part", F.spark_partition_id()), "ranged")


def running(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Adds `_end`, the sum of `amount` up to and with each row in the order of `by`, to ranged rows; there are few ranges."""
    sums = df.groupBy("_part").agg(F.sum(amount).alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(F.broadcast(before), "_part").withColumn("_end", F.col("_before") + inside).drop("_part", "_before")


def percentiles(df: DataFrame, value: str = "value", ps: tuple[float, ...] = (50, 95, 99), a_range: int = RANGE) -> DataFrame:
    """(n, p50, p95, p99, max): the value at rank min(n - 1, floor(p/100 n)); nulls are left out."""
    counts = written(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")), "counts")
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.max("v").alias("max"))
    ends = running(ranged(counts, ["v"], counts.count(), a_range), ["v"], "c")
    picks = ends.crossJoin(F.broadcast(n)).agg(*[F.min(F.when(F.col("_end") > _nth(p, F.col("n")), F.col("v"))).alias(f"p{p:g}") for p in ps])
    return n.crossJoin(picks).select("n", *[f"p{p:g}" for p in ps], "max")


def by_bucket(df: DataFrame, bucket: Column, value: str, p: float = 99, a_range: int = RANGE) -> DataFrame:
    """(bucket, value): a percentile of each bucket that has a value; the number of buckets doesn't depend on the rows."""
    counts = written(df.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket"), F.col(value).alias("v")).agg(F.count("*").alias("c")), "counts")
    ends = running(ranged(counts, ["bucket", "v"], counts.count(), a_range), ["bucket", "v"], "c")
    sums = counts.groupBy("bucket").agg(F.sum("c").alias("_n"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ends.join(F.broadcast(starts), "bucket")
    return ranked.where(F.col("_end") - F.col("_start") > _nth(p, F.col("_n"))).groupBy("bucket").agg(F.min("v").alias("value"))


def with_arrival(df: DataFrame, value: str, order: list[str], a_range: int = RANGE) -> DataFrame:
    """(value, _i, _total): a row's number in arrival order, and how many there are."""
    n = df.count()
    rows = ranged(df.select(value, *[c for c in order if c != value]), order, n, a_range).withColumn("_one", F.lit(1).cast("long"))
    return running(rows, order, "_one").select(value, (F.col("_end") - 1).alias("_i"), F.lit(n).cast("long").alias("_total"))


def sparkline(df: DataFrame, value: str, order: list[str], width: int = 56, p: float = 99, a_range: int = RANGE) -> DataFrame:
    """(bucket, value) of `width` buckets of equally many rows in arrival order."""
    rows = with_arrival(df, value, order, a_range)
    return by_bucket(rows, F.least(F.lit(width - 1), F.floor(F.col("_i") * width / F.col("_total"))).cast("int"), value, p, a_range)


def downsample(df: DataFrame, value: str, order: list[str], points: int = 120, p: float = 99, a_range: int = RANGE) -> DataFrame:
    """(bucket, value) of chunks of floor(n / points) rows, one row at least."""
    rows = with_arrival(df, value, order, a_range)
    size = F.greatest(F.lit(1), F.floor(F.col("_total") / points))
    return by_bucket(rows, F.floor(F.col("_i") / size).cast("int"), value, p, a_range)

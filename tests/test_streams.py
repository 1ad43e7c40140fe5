"""Telemetry and change sync as streams, and latency summaries against plain Python."""

import math
import random

from pyspark.sql import functions as F

from tablegraft.operators import latency
from tablegraft.streaming import events, sync


def test_events_are_tailed_in_steps(spark, tmp_path):
    log = events.Events(spark, str(tmp_path / "repo"))
    assert log.history().count() == 0
    heard = []
    log.listeners.append(heard.append)
    for k in range(3):
        log.emit(k % 2, {"k": k})
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for want in (3, 4):
        events.tail(log.stream(), out, mark).awaitTermination()
        assert spark.read.schema(events.SCHEMA).parquet(out).count() == want
        log.emit(1, {"late": True}, "warn")
    assert [r.payload for r in log.history(0).collect()] == ['{"k": 0}', '{"k": 2}'] and len(heard) == 5


def test_changes_are_followed_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("changes", "out", "mark"))
    schema, got = "k long, n long, v string", []
    for rows in ([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], [(1, 4, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            sync.follow(spark.readStream.schema(schema).parquet(source), out, mark, ["k"], ["n"], "up", F.upper("v")).awaitTermination()
        got.append(sorted(tuple(r) for r in spark.read.parquet(out).select("k", "n", "up").collect()))
    assert got == [[(1, 3, "C"), (2, 1, "X")], [(1, 3, "C"), (1, 4, "D"), (2, 1, "X")]]


def nearest(values, p):
    values = sorted(values)
    return values[min(len(values) - 1, math.floor(p / 100 * len(values)))]


def test_latency_summaries(spark):
    rng = random.Random(8)
    for n in (1, 7, 1000):
        rows = [(k, round(rng.lognormvariate(1, 1), 1)) for k in range(n)]
        df = spark.createDataFrame(rows, "i long, value double").repartition(5)
        values = [v for _, v in rows]
        assert tuple(latency.percentiles(df).first()) == (n, nearest(values, 50), nearest(values, 95), nearest(values, 99), max(values))
        buckets: dict = {}
        for k, v in rows:
            buckets.setdefault(min(55, math.floor(k / n * 56)), []).append(v)
        assert {r.bucket: r.value for r in latency.sparkline(df, "value", ["i"]).collect()} == {b: nearest(x, 99) for b, x in buckets.items()}
        size, chunks = max(1, n // 120), {}
        for k, v in rows:
            chunks.setdefault(k // size, []).append(v)
        assert {r.bucket: r.value for r in latency.downsample(df, "value", ["i"]).collect()} == {b: nearest(x, 99) for b, x in chunks.items()}
    empty = latency.percentiles(spark.createDataFrame([], "value double")).first()
    assert tuple(empty) == (0, None, None, None, None)


def test_ranges_are_bounded(spark):
    """Summaries don't depend on the size of ranges, and a range holds no more than it should, ties or not."""
    rng = random.Random(3)
    rows = [(k, float(rng.choice([1, 1, 1, rng.random()]))) for k in range(3000)]
    df = spark.createDataFrame(rows, "i long, value double").repartition(7)
    parts = latency.ranged(df, ["i"], 3000, 200).groupBy("_part").count().collect()
    assert len(parts) >= 14 and max(r["count"] for r in parts) <= 600
    for make in (lambda n: latency.percentiles(df, a_range=n), lambda n: latency.sparkline(df, "value", ["i"], a_range=n), lambda n: latency.downsample(df, "value", ["i"], a_range=n)):
        assert sorted(map(tuple, make(100).collect())) == sorted(map(tuple, make(1 << 20).collect()))

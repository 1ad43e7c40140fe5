import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablegraft.llm import linededup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, min_chars=1):
    keys = [[x.strip(" \t\n\v\f\r").translate(LOW) for x in (t or "").split("\n")] for _, t, *_ in rows]
    found = Counter(k for own in keys for k in set(own))
    gone = {k for k, n in found.items() if n >= least and len(k) >= min_chars}
    out = []
    for (i, t, *_), own in zip(rows, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), own, strict=True) if k not in gone]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()), key=str)


@pytest.mark.parametrize("least", [2, 10, 500])
@pytest.mark.parametrize("most_bytes", [64 << 20, -1])
def test_both_ways_match_brute_force(docs, rows, least, most_bytes):
    got = linededup.drop_shared_lines(docs, min_docs=least, most_bytes=most_bytes, block_bytes=5000)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert digest(got) == brute(rows, least)


def test_long_keys_only(docs, rows):
    assert digest(linededup.drop_shared_lines(docs, min_docs=2, min_chars=8)) == brute(rows, 2, 8)


def test_clashing_columns_and_empty(spark, docs, no_docs):
    odd = docs.withColumn("n_lines", F.lit("mine")).withColumn("shard", F.lit(1)).withColumn("block", F.lit(2)).withColumn("lo", F.lit(3))
    for most in (64 << 20, -1):
        got = linededup.drop_shared_lines(odd, most_bytes=most)
        assert got.columns == [*docs.columns, "shard", "block", "lo", "n_lines", "n_dropped"] and got.where("shard = 1 and lo = 3").count() == docs.count()
        assert linededup.drop_shared_lines(no_docs, most_bytes=most).count() == 0


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"same\nown {i}") for i in range(12)]
    df = spark.createDataFrame([(*r, *[r[0]] * 6) for r in rows], "doc_id long, text string, _kept long, _block long, _llm_kept long, `a.b` long, `n_dropped` long, _kept_ long")
    for most in (64 << 20, -1):
        got = linededup.drop_shared_lines(df, most_bytes=most)
        assert got.columns == ["doc_id", "text", "_kept", "_block", "_llm_kept", "a.b", "_kept_", "n_lines", "n_dropped"]
        assert all((r.text, r._kept, r._block, r["a.b"], r["_kept_"]) == (f"own {r.doc_id}", *[r.doc_id] * 4) for r in got.collect())


def test_a_shard_that_is_asked_much_is_probed_in_parts(docs, rows):
    assert digest(linededup.drop_shared_lines(docs, min_docs=2, most_bytes=-1, block_bytes=5000, asked_a_part=40)) == brute(rows, 2)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_perfect_hash(own, others):
    keys = np.array(sorted(own), np.uint64)
    h = linededup.PerfectHash.build(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    shard = linededup.Shard.of(*linededup.Shard.build(keys, keys ^ np.uint64(5), np.arange(len(keys)) + 1).row())
    assert shard.count(keys, keys ^ np.uint64(5)).tolist() == list(range(1, len(keys) + 1))
    rest = np.array(sorted(others - own), np.uint64)
    assert not shard.count(rest, rest).any()


def test_many_shards(spark):
    frequent = spark.range(3000).select(F.xxhash64("id").alias("lo"), F.xxhash64("id", "id").alias("hi"), F.lit(12).cast("long").alias("n"))
    table, shards, n = linededup.build_shards(frequent, 100)
    assert n == 3000 and shards == 30 and table.count() == 30

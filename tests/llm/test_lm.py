import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tablegraft.llm import lm
from tablegraft.llm.common import words


def parts(rows):
    out = []
    for i, t, *_ in rows:
        own = [*words((t or "").encode()), lm.END]
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, own))
    return out


def grammar(n, seed=1):
    """Texts in which a word says much about the one that follows it, and rare words."""
    rng = random.Random(seed)
    after = {w: rng.sample(range(60), 3) for w in range(60)}
    out = []
    for i in range(n):
        w, own = rng.randrange(60), []
        for _ in range(rng.randint(5, 60)):
            own.append(f"w{w}" if rng.random() < 0.95 else f"rare{rng.randrange(4000)}")
            w = rng.choice(after[w]) if rng.random() < 0.9 else rng.randrange(60)
        out.append((i, " ".join(own)))
    return out


def test_query(docs, rows):
    got = sorted(map(tuple, lm.score(docs, block_bytes=4000).collect()), key=str)
    split = parts(rows)
    counts = Counter(w for _, held, own in split if not held for w in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for i, held, own in split), key=str)
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in got)


def test_blocks_do_not_matter(docs):
    one, many = ({tuple(r)[:6] for r in lm.score(docs, block_bytes=b).collect()} for b in (1 << 30, 2000))
    assert {(*r[:5], round(r[5], 6)) for r in one} == {(*r[:5], round(r[5], 6)) for r in many}


def test_scores_against_a_slow_scorer_and_the_base(spark, monkeypatch):
    """A plain sum over all symbols for each token gives the same scores; texts that weren't learned from gain over the base."""
    rows = grammar(1500)
    kept = {}
    monkeypatch.setattr(lm, "_normalised", lambda spark, net, real=lm._normalised: kept.setdefault("net", real(spark, net)))
    monkeypatch.setattr(lm, "frequent", lambda *a, real=lm.frequent: kept.setdefault("symbols", real(*a)))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), words_for=512, block_bytes=30000).collect()}
    net, symbols = kept["net"], kept["symbols"]
    split = parts(rows)
    counts = Counter(w for _, held, own in split if not held for w in own)
    number = {int(k): s for k, s in zip(symbols.heads, symbols.order, strict=True)}
    symbol = {w: number.get(int(lm.keys_of([w])[0]), symbols.rare) for _, _, own in split for w in own}
    assert len(symbols.heads) == 64 and all(counts[w] == symbols.counts[s] for w, s in symbol.items() if s != symbols.rare)
    rare = sum(n for w, n in counts.items() if symbol[w] == symbols.rare)
    kinds = sum(symbol[w] == symbols.rare for w in counts)
    for i, _, own in split[:40]:
        before, total = (symbols.start, symbols.start), 0.0
        for w in own:
            group = lm.GROUPS - 1 if before[0] == symbols.start else min(before[0], lm.GROUPS - 2)
            s = net.target.astype(float) @ (net.last[before[1]].astype(float) + net.group[group]) + net.bias
            p = np.exp(s - s.max())
            p /= p.sum()
            total += math.log10(p[symbol[w]])
            if symbol[w] == symbols.rare:
                total += math.log10((counts[w] + 0.5) / (rare + 0.5 * (kinds + 1)))
            before = (before[1], symbol[w])
        assert math.isclose(got[i].score, total, rel_tol=1e-4)
    held = [r for r in got.values() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / tokens > 0.4
    assert sum(r.score > r.base_score for r in held) > 0.95 * len(held)


def test_network_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    prev = rng.integers(0, 4, 30000)
    follow = np.where(rng.random(30000) < 0.9, (prev + 1) % 4, rng.integers(0, 4, 30000))
    unigram = np.bincount(follow, minlength=6) + 0.5
    net = lm.train((np.full(30000, 31), prev, follow), unigram / unigram.sum(), epochs=6, batch=256)
    net.log_z = net.normalisers(np.arange(7))
    for w in range(7):
        assert math.isclose(sum(10 ** net.log10(np.full(6, 3), np.full(6, w), np.arange(6))), 1, rel_tol=1e-4)
    own = net.log10(np.full(30000, 31), prev, follow).mean()
    assert own > np.log10(unigram / unigram.sum())[follow].mean() + 0.2
    untrained = lm.train((np.zeros(0, int),) * 3, unigram / unigram.sum())
    untrained.log_z = untrained.normalisers(np.arange(7))
    assert np.allclose(untrained.log10(np.zeros(6, int), np.zeros(6, int), np.arange(6)), np.log10(unigram / unigram.sum()), atol=1e-5)


def test_no_training_rows_and_empty(spark, no_docs):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = lm.score(spark.createDataFrame([(i, "a b a") for i in held], "doc_id long, text string")).collect()
    assert len(rows) == len(held) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
    assert lm.score(no_docs).count() == 0


def test_a_failure_leaves_no_table(spark, docs, monkeypatch):
    def fail(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(lm, "_scored", fail)
    with pytest.raises(RuntimeError, match="lost"):
        lm.score(docs)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_symbols_and_contexts():
    of = lm.Symbols(np.array([lm.END_KEY, 5, -9], np.int64), np.array([3, 2, 1]))
    assert of.of(np.array([-9, 7, lm.END_KEY, 5], np.int64)).tolist() == [2, 3, 0, 1]
    groups, last = of.contexts(np.array([1, 3, 0], np.int32))
    assert groups.tolist() == [lm.GROUPS - 1, lm.GROUPS - 1, 1] and last.tolist() == [of.start, 1, 3]
    codes = of.codes(np.array([1, 3, 0], np.int32))
    assert [x.tolist() for x in of.split(codes)] == [groups.tolist(), last.tolist(), [1, 3, 0]]


def test_draws_follow_the_counts(spark):
    rows = spark.createDataFrame([(k, 1 if k else 100_000) for k in range(2000)], "code long, n long")
    codes, k = lm.drawn(rows, 102_000, 10_200)
    assert abs(int(k[codes == 0][0]) - 10_000) <= 1 and 100 < len(codes) < 320 and k.sum() < 10_400
    codes, k = lm.drawn(rows, 102_000, 1 << 22)
    assert len(codes) == 2000 and k.sum() == 101_999


def test_every_text_is_learned_from_whatever_the_draws(spark, monkeypatch):
    """With next to no draws for a start, the passes still learn what follows what, from each training token once."""
    rows, learned = grammar(1500), []

    def passed(blocked, *a, real=lm.passed):
        own = blocked.where("not held_out").groupBy("turn").count().collect()
        learned.extend(r["count"] for r in own if 0 <= r.turn < lm.ROUNDS)
        return real(blocked, *a, batch=128)

    monkeypatch.setattr(lm, "passed", passed)
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), words_for=512, block_bytes=100_000, draws=100).collect()
    assert len(learned) == lm.ROUNDS and min(learned) > 200 and sum(learned) == sum(not h for _, h, _ in parts(rows))
    held = [r for r in got if r.held_out]
    assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held) > 0.3


def test_frequent_words_are_those_of_the_largest_sums(spark):
    """Also where a word is seldom in each block, and others are frequent in one."""
    rows = [(b, 1000, 9) for b in range(100)] + [(k, k, 500) for k in range(1, 4)] + [(b, lm.END_KEY, 1) for b in range(100)]
    symbols = lm.frequent(spark.createDataFrame(rows, "block int, key long, n long"), 4 * 2048 * 200, 4, 2048)
    assert symbols.heads[symbols.order.argsort()].tolist() == [lm.END_KEY, 1000, 1, 2] and symbols.counts.tolist() == [100, 900, 500, 500]


def test_repeated_rows_are_dealt_into_many_blocks(spark):
    from tablegraft.llm import common

    df = spark.createDataFrame([(1, "the same text " * 20)] * 3000, "doc_id long, text string").repartition(3)
    got, n = common.with_block(df, "text", 20_000, "b")
    sizes = [r["count"] for r in got.groupBy("b").count().collect()]
    assert n > 40 and len(sizes) > 0.9 * n and max(sizes) < 4 * 3000 / n

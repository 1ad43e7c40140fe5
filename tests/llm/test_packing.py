import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablegraft.llm import packing
from tablegraft.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH, longest=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab thé's1 \n\t 　\x85\x1c!?"), max_size=40) | st.text(max_size=30), max_size=5))
def test_ids_are_the_librarys(encoder, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_whole_vocabulary_agrees(encoder):
    texts = [t for i in range(50256) if "\ufffd" not in (t := encoder.tokenizer.decode([i], skip_special_tokens=False))]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_plan(counts, capacity, plan):
    filled, placed = defaultdict(list), defaultdict(int)
    for length, first, n, base, offset in plan.places:
        assert first == placed[length]
        placed[length] += n
        for k in range(n):
            filled[base + k].append((offset, length))
    assert dict(placed) == {k: v for k, v in counts.items() if v}
    assert set(filled) == set(range(plan.sequences))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_plans_hold_each_length_once_without_gaps(counts):
    check_plan(counts, 64, packing.Plan(counts, 64, groups=8))


def test_plans_are_close_to_the_least():
    rng = random.Random(1)
    counts = defaultdict(int)
    for _ in range(20000):
        counts[min(1024, max(1, int(rng.lognormvariate(5.8, 0.9))))] += 1
    plan = packing.Plan(counts, 1024)
    check_plan(counts, 1024, plan)
    assert plan.sequences <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 1024)


def test_query(docs, rows, encoder):
    got = packing.pack_documents(docs, PATH).collect()
    want = []
    for i, t, *_ in rows:
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        for k, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            want.append((i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert all(r.length == 1024 for r in got if r.piece > 0)


def test_ids_column_and_empty(spark, docs, no_docs):
    rows = packing.pieces(docs, PATH, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("hot", [512, 341, 256])
def test_a_hot_length_below_a_rare_longer_one_is_not_rounded_up(hot):
    counts = {hot + 1: 1, hot: 1_000_000}
    plan = packing.Plan(counts, 1024)
    assert plan.sequences <= 1 + -(-1_000_000 // (1024 // hot))
    assert sum(n for _, _, n, _, _ in plan.places) == 1_000_001


def test_a_length_is_ranked_in_parts_of_bounded_size(spark):
    """A length with most rows: no part of it is ranked with more rows than it should, and places have no gaps."""
    rng = random.Random(4)
    rows = [(i, 0, 512 if i % 3 else rng.randint(1, 1024)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    for a_part in (100, 1 << 19):
        got = packing.pack(df, rows_a_part=a_part).collect()
        filled = defaultdict(list)
        for r in got:
            filled[r.sequence_id].append((r.offset, r.length))
        assert len(got) == 3000 and sorted((r.doc_id, r.length) for r in got) == sorted((i, n) for i, _, n in rows)
        assert set(filled) == set(range(len(filled))) and len(filled) <= 1.02 * -(-sum(n for _, _, n in rows) // 1024)
        for parts in filled.values():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_hot_lengths_among_many_others():
    rng = random.Random(2)
    counts = defaultdict(int)
    for _ in range(20000):
        counts[min(1024, max(129, int(rng.lognormvariate(5.8, 0.9))))] += 1
    for hot in (512, 341):
        counts[hot] += 10000
        counts[hot + 1] = 1
    plan = packing.Plan(counts, 1024)
    check_plan(counts, 1024, plan)
    assert plan.sequences <= 1.02 * -(-sum(k * v for k, v in counts.items()) // 1024)

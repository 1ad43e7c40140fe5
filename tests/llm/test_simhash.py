import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tablegraft.llm import simhash
from tablegraft.llm.common import words


def slow_print(text, k=4):
    own = words((text or "").encode())
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + k]), 42) for i in range(max(1, len(own) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=4):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def expected(rows, bits=4):
    prints = [slow_print(t) for _, t, *_ in rows]
    root, least = slow_components(prints, bits), {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for (i, *_), p in zip(rows, prints, strict=True)), key=str)


def test_query(docs, rows):
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == expected(rows)


def test_fingerprint_in_parts():
    text = "some words and more words of many kinds here " * 20
    assert simhash.fingerprint(text.encode(), part=7) == slow_print(text)


def near_prints(n, seed=5):
    """Chains and clusters of fingerprints a few bits apart, and random ones."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 30])):
            out.append(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    return out


def joined(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("tile", [2048, 4])
@pytest.mark.parametrize("bits", [4, 5])
def test_links_join_what_brute_force_joins(spark, tile, bits):
    prints = sorted(set(near_prints(500)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits, tile).collect()]
    by = dict(zip(signed, prints, strict=True))
    assert all((by[a] ^ by[b]).bit_count() <= bits for a, b in got)
    root = slow_components(prints, bits)
    groups = {}
    for s, p in zip(signed, prints, strict=True):
        groups.setdefault(root[p], set()).add(s)
    assert joined(got) == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**9), 400)
    edges = list(zip(ids[:300], ids[1:300], strict=False)) + [(ids[k], ids[350]) for k in range(351, 400)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for group in joined([e for e in edges if e[0] != e[1]]):
        for x in group - {min(group)}:
            assert got[x] == min(group)


def test_positions():
    assert simhash._plan(4)[0] == 4 and len(simhash._plan(4)[1]) == 35 and len(simhash._plan(4, 1 << 30)[1]) == 70
    for n in (0, 1 << 30):
        for apart in combinations(range(8), 4):  # bytes that differ
            assert any(not set(apart) & set(p) for p in simhash._plan(4, n)[1])
    with pytest.raises(ValueError):
        simhash._plan(8)


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def shingle_set(text, k=5):
    own = words((text or "").encode())
    return {b" ".join(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def similar_groups(texts, similarity=0.8):
    """Groups of positions by the true similarity of shingle sets, by brute force."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def kept_rows(rows, similarity=0.8):
    """One row of each group, by brute force: the smallest id, rows without ids last; the same text twice counts once."""
    texts = list({r[1]: None for r in rows})
    group = {texts[k]: g for g in similar_groups(texts, similarity) for k in g}
    want = {}
    for r in rows:
        key, g = (r[0] is None, r[0] or 0, str(r[1])), group[r[1]]
        if g not in want or key < want[g][0]:
            want[g] = (key, r)
    return sorted((r for _, r in want.values()), key=str)


def test_one_of_each_group_stays(docs, rows):
    short = [r for r in rows if len(r[1] or "") < 6000]
    got = simhash.keep_verified(docs.where("text is null or length(text) < 6000"))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == kept_rows(short)


def test_rows_without_ids_and_clashing_columns(spark):
    text = "some words that are long enough to be told apart by their shingles"
    rows = [(None, text, 1), (None, text, 2), (None, "quite another text with other words in it, so it stays", 3), (4, text + " x", 4), (4, text + " x", 5)]
    df = spark.createDataFrame([(*r, r[2], r[2]) for r in rows], "doc_id long, text string, _one int, _BODY int, `a.b` int")
    got = simhash.keep_verified(df)
    assert got.columns == df.columns
    got = sorted(map(tuple, got.collect()), key=str)
    assert [r[:2] for r in got] == [(4, text + " x"), (None, "quite another text with other words in it, so it stays")] and all(r[2] == r[3] == r[4] for r in got)


def test_no_documents_have_no_groups(no_docs):
    assert simhash.verified(no_docs).count() == 0 and simhash.keep_verified(no_docs).count() == 0


def found_groups(spark, texts, **kwargs):
    groups = {}
    for r in simhash.verified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **kwargs).collect():
        groups.setdefault(r.root, set()).add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


def test_a_repeated_phrase_does_not_make_texts_alike(spark):
    rng = random.Random(8)
    texts = [" ".join(["the same five words again"] * 30 + [f"w{rng.randrange(10**6)}" for _ in range(300)]) for _ in range(12)]
    assert found_groups(spark, texts) == {frozenset([i]) for i in range(12)}


@pytest.mark.parametrize("tile", [2048, 6])
def test_verified_groups_are_those_of_true_similarity(spark, rows, tile):
    """Ordinary and awkward texts, texts of 5 to 15 words, and many near copies of one text, by brute force."""
    rng = random.Random(9)
    texts = [t for _, t, *_ in rows if len(t or "") < 6000]
    for n in range(5, 16):
        own = [f"s{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(own), " ".join(own + ["x"]), " ".join(own[1:]), " ".join(own[:-1] + ["y"])]
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    for _ in range(40):
        at = rng.randrange(120)
        texts.append(" ".join(base[:at] + [f"c{rng.randrange(10**6)}"] + base[at + 1 :]))
    assert found_groups(spark, texts, tile=tile) == similar_groups(texts)


def test_pairs_of_just_the_similarity_are_found(spark):
    """Pairs at 0.80 to 0.85 with 4 to 1000 shingles each link, pairs at 0.75 to 0.80 don't."""
    rng, texts, want = random.Random(10), [], []
    for n in (4, 5, 6, 8, 12, 40, 200, 1000):
        for _ in range(12):
            own = [f"t{rng.randrange(10**9)}" for _ in range(n + 4)]
            for k, alike in ((n // 4, True), (n // 4 + 1, False)):  # k more shingles: n / (n + k)
                fresh = [f"u{rng.randrange(10**9)}-{w}" for w in own]
                texts += [" ".join(fresh), " ".join(fresh + [f"v{rng.randrange(10**9)}" for _ in range(k)])]
                want += [frozenset([len(texts) - 2, len(texts) - 1])] if alike else [frozenset([len(texts) - 2]), frozenset([len(texts) - 1])]
    assert found_groups(spark, texts) == set(want)


def test_partners_and_hub():
    rng = np.random.default_rng(1)
    hub = rng.integers(0, 256, simhash.SKETCH).astype(np.uint8)
    marks = np.stack([hub] + [np.where(rng.random(simhash.SKETCH) < 0.75, hub, rng.integers(0, 256, simhash.SKETCH)).astype(np.uint8) for _ in range(20)] + [rng.integers(0, 256, simhash.SKETCH).astype(np.uint8)])
    got = simhash._partners(np.arange(22), marks, 30)
    assert {r[0] for r in got if r[3]} == set(range(1, 21)) and {r[1] for r in got if r[3]} == {0}
    assert 21 not in {r[0] for r in got} | {r[1] for r in got}


@pytest.mark.parametrize(("tile", "most_bytes"), [(2048, 1 << 24), (6, 1 << 24), (2048, 400), (4, 100)])
def test_rows_of_different_roots_meet_once(spark, tile, most_bytes):
    """Every two rows of a key with different roots meet in one task; tasks are bounded, but for rows of one hash."""
    rng = random.Random(3)
    rows = [(k, 100 * k + i, 0 if rng.random() < share else rng.randint(1, 4), rng.randint(1, 60)) for k, (n, share) in enumerate([(2, 0.5), (9, 0.5), (60, 0.9), (40, 0.0)]) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, fp long, root long, weight long")
    tasks = {}
    for r in simhash._deal(df, tile, most_bytes).collect():
        tasks.setdefault((r.key, r.i, r.j), []).append((r.side, r.fp, r.root))
    met = {}
    for (key, i, j), own in tasks.items():
        assert key == 0 or len(own) <= 4 * tile
        for (s, a, x), (t, b, y) in combinations(own, 2):
            if x != y and {s, t} == {i, j}:
                met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    want = {(min(a, b), max(a, b)) for (k, a, x, _), (m, b, y, _) in combinations(rows, 2) if k == m and x != y}
    assert met == dict.fromkeys(want, 1)


def test_near_copies_without_a_hub(spark):
    """Many copies of a text that is gone: some link, most don't; brute force decides."""
    rng, texts = random.Random(12), []
    base = [f"g{rng.randrange(10**6)}" for _ in range(300)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(2, 6)):
            own[rng.randrange(300)] = f"h{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    want = similar_groups(texts)
    assert 3 < len(want) < 60 or len(want) == 1
    assert found_groups(spark, texts) == found_groups(spark, texts, tile=8, most_bytes=20000) == want


def test_bloom_keeps_every_wanted_row(spark):
    from tablegraft.llm import common

    rows = spark.range(20000).selectExpr("xxhash64(id) as h", "id")
    wanted = rows.where("id % 40 = 0").select("h")
    got = {r.id for r in common.bloom(rows, wanted, "h").collect()}
    assert set(range(0, 20000, 40)) <= got and len(got) < 4000
    assert len({r.id for r in common.bloom(rows, wanted, "h", 1 << 16).collect()} & set(range(0, 20000, 40))) == 500
    assert common.bloom(rows, wanted.where("false"), "h").count() == 0
    assert common.fresh(["a", "_X", "_x_y"], "_x", "A") == ["_x__", "A_"]


def test_what_simhash_joins_is_found_without_other_postings(spark):
    """The fingerprints of sets alone, by positional bytes and count, find copies that few shingles tell apart."""
    rng, texts, want = random.Random(14), [], []
    for _ in range(30):
        own = [f"p{rng.randrange(10**9)}" for _ in range(400)]
        texts += [" ".join(own), " ".join([*own[:-1], "q"])]
        a, b = (simhash.set_print(simhash.shingles(x.encode())) for x in texts[-2:])
        assert a == slow_set_print(texts[-2]) and b == slow_set_print(texts[-1])
        want += [frozenset([len(texts) - 2, len(texts) - 1])] if (a ^ b).bit_count() <= 4 else [frozenset([len(texts) - 2]), frozenset([len(texts) - 1])]
    assert 15 < sum(len(g) == 2 for g in want) and found_groups(spark, texts, bands=0) == set(want)
    assert {frozenset([2 * k, 2 * k + 1]) for k in range(30)} == found_groups(spark, texts)


def slow_set_print(text, k=5):
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingle_set(text, k)]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_the_pipeline_links_fingerprints_of_simhash(spark, docs, monkeypatch):
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(simhash, "links", lambda df, bits, real=simhash.links: (asked.append((df.count(), bits)), real(df, bits))[1])
    assert corpus_pipeline.drop_copies(spark, docs.where("length(text) < 6000"), "").count() > 0
    assert len(asked) == 1 and asked[0][0] > 10 and asked[0][1] == 4

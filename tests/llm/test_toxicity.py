import random
import zlib

import numpy as np
import pytest

from tablegraft.llm import toxicity

BAD = {"en": ["idiot", "moron"], "fr": ["vequta", "vejuée"], "de": ["loweient"], "es": ["chllach"]}


def corpus(n=1200, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(BAD))
        own = toxicity.FUNCTION_WORDS[lang].split()
        text = [rng.choice(own) if rng.random() < 0.5 else "".join(rng.choices("abcdefghinorst", k=rng.randint(3, 8))) for _ in range(rng.randint(5, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD[lang]))
        docs.append((i, " ".join(text), lang))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (5000, None, None), (5001, "", None), (5002, "idiot " * 300_000, "en")], "doc_id long, text string, lang string")
    out = toxicity.score(d, spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int"))
    return {r.doc_id: r for r in out.collect()}, dict(labels)


def test_held_out_accuracy(scored):
    got, labels = scored
    held = [r for r in got.values() if r.held_out and r.doc_id in labels]
    right = np.mean([r.predicted == labels[r.doc_id] for r in held])
    assert len(held) > 300 and right > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[5000].score == got[5001].score and got[5000].predicted == 0 and got[5002].predicted == 1


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.score(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_one_class_empty_and_clashing_columns(spark, no_docs):
    docs, labels = corpus(30)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' score", "1 held_out", "'y' _text")
    assert {r.score for r in toxicity.score(d, spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int")).collect()} == {0.0}
    assert toxicity.score(no_docs, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def slow_logit(net, words):
    """One text through the net in plain loops."""
    rows = [[float(x) for k, p in enumerate(toxicity.places(w)) for x in net.tables[k][p]] for w in words] or [[0.0] * (toxicity.PART * len(toxicity.SIZES))]
    total, at = float(net.shift), 0
    for f in net.filters:
        for k in range(f.shape[2]):
            top = max(sum(rows[i + j][d] * float(f[j, d, k]) for j in range(f.shape[0]) if i + j < len(rows) for d in range(len(rows[0]))) for i in range(len(rows)))
            total += max(0.0, top + float(net.bias[at])) * float(net.out[at])
            at += 1
    return total


def test_scores_against_a_slow_forward_pass():
    docs, labels = corpus(400)
    import pyarrow as pa

    kept = dict(labels)
    net = toxicity.train(pa.table({"label": [kept[i] for i, *_ in docs], "text": [t for _, t, _ in docs]}))
    scorer, texts = toxicity.Scorer(net), [t.encode() for _, t, _ in docs[:25]] + [b"", b"idiot", b"Idiot, MORON!", b"two words"]
    logits, langs = scorer.logits(texts)
    for got, lang, score, text in zip(logits, langs, net.scores(logits, langs), texts, strict=True):
        want = slow_logit(net, toxicity.tokens(text))
        z = net.slope * (want - net.thresholds[lang]) + np.log(0.7 / 0.3)
        assert abs(got - want) < 1e-3 and abs(score - 1 / (1 + np.exp(-z))) < 1e-3


def test_sample_is_bounded_and_does_not_depend_on_order(spark):
    docs, labels = corpus(200)
    rows = [(i, t) for i, t, _ in docs] + [(docs[0][0], "another text"), (docs[1][0], docs[1][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([*labels, *[(10_000 + i, 1) for i in range(500)]], "doc_id long, toxic int")
    a, b = (toxicity.sample(x, y).to_pylist() for x in (d, d.orderBy("text").repartition(5)))
    assert a == b and len(a) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in labels)
    few = toxicity.sample(d, y, max_rows=30).to_pylist()
    assert few == a[:30]
    small = toxicity.sample(d, y, total_bytes=5000).to_pylist()
    assert 0 < len(small) < len(a) and sum(len(r["text"].encode()) for r in small) <= 5000 and small == a[: len(small)]
    assert max(len(r["text"]) for r in toxicity.sample(d, y, max_bytes=300).to_pylist()) <= 300


def test_long_texts_in_windows():
    net = toxicity.Net()
    rng = np.random.default_rng(1)
    for t in net.tables:
        t[:] = rng.normal(0, 1, t.shape)
    words = ["w%d" % k for k in rng.integers(0, 500, 300_000)]
    scorer = toxicity.Scorer(net)
    long = scorer.logits([" ".join(words).encode()])[0][0]
    ids, _ = toxicity._join([[w.encode() for w in words]], scorer.index)
    whole = net.logits(net.responses(scorer.parts[ids]).max(axis=0)[None])[0]
    assert abs(long - whole) < 1e-3


def test_neighbours_do_not_change_a_score():
    net, rng = toxicity.Net(), np.random.default_rng(2)
    for t in net.tables:
        t[:] = rng.normal(0, 1, t.shape)
    texts = [b"", b"a quiet text", b"one", b"", b"idiot moron idiot", b"two words", b"  ", b"moron", b" ".join(b"w%d" % k for k in rng.integers(0, 900, 300_000)), b"idiot"]
    alone = [toxicity.Scorer(net).logits([t])[0][0] for t in texts]
    assert np.allclose(toxicity.Scorer(net).logits(texts)[0], alone, atol=1e-4)
    assert np.allclose(toxicity.Scorer(net).logits(texts[::-1])[0], alone[::-1], atol=1e-4)

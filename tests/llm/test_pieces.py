import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablegraft.llm import pieces
from tablegraft.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(MODEL, limit=50)


def both(codec, texts):
    rows = codec.encode(texts)
    ends = np.cumsum([0, *(len(x) // 4 for x in rows)]).astype(np.int32)
    return rows, codec.decode(np.frombuffer(b"".join(rows), np.int32), ends).to_pylist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab thé ▁ \n\t 　🙂<s>0x"), max_size=40) | st.text(max_size=30), max_size=5))
def test_ids_and_text_are_the_librarys(codec, texts):
    ids, decoded = both(codec, texts)
    for t, i, d in zip(texts, ids, decoded, strict=True):
        whole = codec.sp.encode(t, add_eos=True)
        assert [int.from_bytes(i[k : k + 4], "little") for k in range(0, len(i), 4)] == whole
        assert d == codec.sp.decode(whole)


def test_every_piece_decodes_as_the_library_decodes_it(codec):
    """Each id alone after a word, but for bytes, which stand alone only where they are ASCII."""
    first = codec.sp.piece_to_id(pieces.MARK)
    for i in range(codec.sp.get_piece_size()):
        if not codec.sp.is_unknown(i) and not (codec.sp.is_byte(i) and len(codec.bytes_of[i].as_py()) == 1 and codec.bytes_of[i].as_py() > b"\x7f"):
            ids = np.array([first, i], np.int32)
            assert codec.decode(ids, np.array([0, 2], np.int32)).to_pylist() == [codec.sp.decode(ids.tolist())]
    assert codec.decode(np.zeros(0, np.int32), np.array([0, 0], np.int32)).to_pylist() == [""]


def test_models_of_which_words_do_not_stand_alone(codec):
    whole = pieces.Codec(MODEL)
    whole.by_word = False
    texts = ["a b  c ", None, "", "\u2581x\U0001f642"]
    assert both(whole, texts) == both(codec, texts)


def test_long_texts_go_in_runs(codec):
    text = "word and more " * 90_000
    ids, decoded = both(codec, [text, "a"])
    assert len(ids[0]) // 4 == len(codec.sp.encode(text, add_eos=True)) and decoded[0] == text


def test_query(spark, docs, rows, codec):
    got = pieces.digests(pieces.encode_decode(docs, MODEL)).collect()
    want = []
    for i, t, *_ in rows:
        ids = codec.sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(no_docs):
    assert pieces.encode_decode(no_docs, MODEL).count() == 0

"""The registered queries on the smallest tables: against SQL where there is some, else against brute force over whole tables."""

import glob
import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import pytest

from tablegraft.llm import queries

from .test_simhash import expected

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def documents(db):
    return db.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, db, name):
    got = sorted(map(tuple, (df := queries.QUERIES[name](spark, FOLDER)).collect()))
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert got == sorted(want)


def test_pieces(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = []
    for i, t in documents:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, queries.op1_pieces(spark, FOLDER).collect())) == sorted(want)


def test_simhash(spark, documents):
    assert sorted(map(tuple, queries.op10_simhash(spark, FOLDER).collect()), key=str) == expected(documents)


def test_sharding(spark, documents):
    rows, places = queries.op4_sharding(spark, FOLDER).collect(), defaultdict(list)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in documents)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and set(places) <= set(range(40))


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    tokenizer, filled = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json")), defaultdict(list)
    rows = queries.op6_packing(spark, FOLDER).collect()
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert lengths == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in documents}
    for parts in filled.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(filled) <= 1.02 * -(-sum(lengths.values()) // 1024) + 1


@pytest.mark.parametrize("name", ["op2_media", "op3_language_model", "op5_toxicity"])
def test_every_document_has_a_row(spark, documents, name):
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, FOLDER).collect()) == sorted(i for i, _ in documents)

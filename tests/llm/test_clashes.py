"""Operators beside columns whose names clash with their own, with dots, other cases and spaces: results are as without them."""

import pytest
from pyspark.sql import functions as F

from tablegraft.llm import chat, lm, media, packing, pieces, pivots, sharding, simhash, toxicity
from tablegraft.llm.queries import tokenizer

NAMES = ["a.b", "fp", "body", "n", "length", "piece", "block", "_block", "key", "shard", "slot", "virtual_slot", "_salt", "_nth", "held_out", "score", "id", "label", "root", "component_id", "c d", "ids", "hash", "size", "v", "group", "cell", "turn_", "tree", "node", "_turn", "media", "Body"]


def beside(df):
    return df.select(*df.columns, *[F.lit(k).alias(c) for k, c in enumerate(NAMES) if c.lower() not in {x.lower() for x in df.columns} and not (c == "Body")])


def labels(df):
    return df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), F.lit(1).alias("text"), F.lit(2).alias("id"))


OPERATORS = {
    "pieces": lambda d: pieces.digests(pieces.encode_decode(d, tokenizer("piece_bpe_32k.model"))),
    "media": media.text_media,
    "lm": lambda d: lm.score(d).drop("score"),
    "sharding": lambda d: sharding.shard(d, 4).select("doc_id", "size", "text_crc32", "virtual_slot", "shard"),
    "toxicity": lambda d: toxicity.score(d, labels(d)).drop("score"),
    "packing": lambda d: packing.pack_documents(d, tokenizer("byte_bpe_50k.json")).drop("sequence_id", "offset"),
    "simhash": simhash.near_duplicates,
    "verified": lambda d: simhash.verified(d).drop("root"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, name):
    few = docs.where("doc_id is null or doc_id < 40 or doc_id between 115 and 125").coalesce(1)
    one, other = (sorted(map(str, OPERATORS[name](d).collect())) for d in (few, beside(few)))
    assert one == other and one


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(300)], "vec_id long, embedding array<float>")
    assert sorted(pivots.top_k(df, 4, every=50).collect()) == sorted(pivots.top_k(beside(df), 4, every=50).collect())


def test_conversations(spark):
    df = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"{c} {t}") for c in range(5) for t in range(4)], "conv_id long, turn long, role string, text string")
    one, other = (sorted(map(str, chat.digests(chat.format_conversations(d)).collect())) for d in (df, beside(df)))
    assert one == other and one

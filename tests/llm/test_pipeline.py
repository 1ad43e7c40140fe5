from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablegraft.llm import queries

from .test_linededup import brute
from .test_simhash import kept_rows
from .test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = corpus(500)
    shared = "a line that many documents share"
    rows = [(i, t + (f"\n{shared}\n tail {i}" if i % 7 == 0 else ""), lang, "s", len(t)) for i, t, lang in docs]
    rows += [(1000 + i, rows[i][1], "en", "s", 1) for i in range(40)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, folder).cache()
    assert kept.columns == columns and 0.6 * docs.count() < kept.count() < 0.95 * docs.count()
    rows = [tuple(r) for r in kept.collect()]
    lines = corpus_pipeline.drop_lines(spark, kept, folder)
    assert lines.columns == columns and lines.schema == kept.schema and lines.count() == len(rows)
    assert {r.n_chars == len(r.text) for r in lines.collect()} == {True}
    got = {(r.doc_id, r.h) for r in lines.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()}
    assert got == {(i, h) for i, _, _, h in brute(rows, 10)}
    after = [tuple(r) for r in lines.collect()]
    single = corpus_pipeline.drop_copies(spark, lines, folder)
    assert single.columns == columns
    assert sorted((tuple(r) for r in single.collect()), key=str) == kept_rows(after)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    filled = defaultdict(int)
    for r in out:
        filled[r.sequence_id] += r.length
    assert out and max(filled.values()) <= 1024 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "packing"]


def test_registered(spark, folder):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_clashing_columns_long_texts_and_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long_ = spark.createDataFrame([(3000, "a long text of many words " * 40_000)], "doc_id long, text string")
    odd = docs.unionByName(long_, allowMissingColumns=True)
    names = ["_score", "_SCORE_", "_kept", "_own", "n_lines", "a.b", "_body", "_one", "body", "fp"]
    odd = odd.select(*docs.columns, *[F.col("doc_id").alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns and got.schema["text"].dataType == odd.schema["text"].dataType, name
        rows = got.collect()
        assert len(rows) > 100 and any(r.doc_id == 3000 for r in rows) and all(r[c] == r.doc_id for r in rows for c in names), name
        assert stage(spark, odd.where("false"), folder).count() == 0, name
    assert corpus_pipeline.pack(spark, odd.where("false"), folder).count() == 0

import pyarrow as pa
from pyspark.sql import functions as F

from tablegraft.llm import common


def test_even_labels(spark):
    for n in (2, 37):
        labels = common.even_labels(spark, n)
        assert len(set(labels)) == n
        df = spark.createDataFrame([(x,) for x in labels], "block int").repartition(n, "block")
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == n


def test_blocks_hold_every_row(spark, docs, no_docs):
    for even in (0, 100):
        got, n = common.with_block(docs, "text", 5000, "b", even)
        assert n > 5 and got.count() == docs.count() and got.select("b").distinct().count() <= n
    assert common.with_block(no_docs, "text", 5000)[1] == 1


def test_slices_hold_every_row_and_bound_their_bytes():
    texts = ["x" * n for n in (5, 0, 900, 50, 3000, 1)] + [None]
    parts = list(common.slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0, 1000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 1000 for p in parts)
    assert common.raw(pa.array(["é", None])) == ["é".encode(), b""] and list(common.runs("abcde", 2)) == [["a", "b"], ["c", "d"], ["e"]]


def test_distinct_table_keeps_its_values():
    seen = []
    table = common.DistinctTable(lambda xs: seen.append(len(xs)) or [x * 2 for x in xs], limit=3)
    for part in (["a", "b"], ["b", "c"], ["d", "a"]):
        table.fill(part)
        assert [table[x] for x in part] == [x * 2 for x in part]
    assert seen == [2, 1, 2] and len(table) == 2


def test_words_split_at_ascii_white_space_only():
    assert common.words("A\tB C d　É\x1cx\x0b\x0cY".encode()) == ["a".encode(), b"b", "c d　É\x1cx".encode(), b"y"]


def test_scratch_tables_go_to_the_shared_folder(spark, docs):
    out = common.materialise(docs, "x")
    assert all(p.removeprefix("file:").lstrip("/").startswith(common.shared_dir(spark).removeprefix("file:").lstrip("/")) for p in out.inputFiles()) and out.count() == docs.count()

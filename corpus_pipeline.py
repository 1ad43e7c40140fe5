"""A corpus pipeline over `documents`: toxicity, line dedup, SimHash near-dedup, best-fit packing. Each stage takes and, but for
the last, returns the columns of documents, whatever further columns there are and whatever their names; it is written as Parquet
and read again as the next one's input. Null texts count as empty, texts may have any length, rows may repeat and ids be null; an
empty table passes all stages as an empty table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraft.llm import linededup, packing, simhash, toxicity
from tablegraft.llm.common import col, fresh, shared_dir
from tablegraft.llm.queries import tokenizer

#: A packing plan can't be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels` of those documents, scores below 0.7. Null and empty texts have a score like
    any other, repeated rows equal ones; without labels of both kinds all documents stay."""
    net = toxicity.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs.columns, "_score")
    return toxicity.with_score(docs, net, name=score).where(F.col(score) < 0.7).select(*map(col, docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them hold; n_chars is counted anew. Each row counts as a document, repeated
    rows too; null texts become empty. Columns n_lines and n_dropped of the input stay as they are."""
    (own,) = fresh([*docs.columns, "n_lines", "n_dropped"], "_own")
    mine = [c for c in docs.columns if c in ("n_lines", "n_dropped")]
    held = docs.withColumn(own, F.struct(*map(col, mine))) if mine else docs
    kept = linededup.drop_shared_lines(held)
    kept = kept.select(*[F.col(own)[c].alias(c) if c in mine else col(c) for c in docs.columns])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest
    id, rows without one last; repeated rows count as a group, as do all texts without words. Candidates are what operator 10 links of
    the sets' SimHash fingerprints, and what shares a min-wise band beyond; whole sets decide."""
    return simhash.keep_verified(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens; a null or empty text is one piece, its end."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

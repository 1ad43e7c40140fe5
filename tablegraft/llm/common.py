"""What the corpus operators share: scratch tables, batches of bounded size, tokens, distinct-value tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; set here only where it is unset and all of Spark runs
    on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later stages neither recompute it nor depend on the
    executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], *stems: str) -> list[str]:
    """Column names like the given ones that none of `taken` is, whatever its case."""
    low, out = {c.lower() for c in taken}, []
    for s in stems:
        while any(x.startswith(s.lower()) for x in low):
            s += "_"
        low.add(s.lower())
        out.append(s)
    return out


def col(name: str):
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def bloom(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = 1 << 28) -> DataFrame:
    """rows whose `key` (a hash) may be one of wanted's. The filter is a bitmap of eight bits for each wanted key, of `most_bits` at
    most, which tasks make and the driver only passes on: beyond that size it lets more rows through, never fewer."""
    spark = rows.sparkSession
    bits = 1 << max(16, min(most_bits.bit_length() - 1, (8 * max(1, wanted.count())).bit_length()))
    place = F.pmod(F.col(key), F.lit(bits))
    words_ = wanted.where(F.col(key).isNotNull()).select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))").alias("bit"))
    got = words_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    map_ = np.zeros(bits >> 6, np.int64)
    map_[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(map_)

    def held(column: pa.Array) -> pa.Array:
        x = column.to_numpy(zero_copy_only=False) % bits
        return pa.array(shared.value[x >> 6] >> (x & 63) & 1 == 1)

    return rows.where(F.arrow_udf(held, "boolean")(F.col(key)))


def crc_mod(column: str, n: int):
    """crc32 of a column's decimal text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words(data: bytes) -> list[bytes]:
    """Lower-cased runs of bytes other than \\x20 and \\x09-\\x0D, which is what bytes.split() cuts at."""
    return data.translate(LOWER).split()


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a part holds about `most` bytes of the given text column, or one row."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(items: Iterable, size: int = 65536) -> Iterator[list]:
    """Lists of at most `size` items, so that a very long text is never held as one list of tokens."""
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


class DistinctTable(dict):
    """Value of each distinct chunk, worked out once by `encode` (a list to a list). It lives as long as the Python worker
    and is emptied at `limit` entries, which costs time but never changes a value."""

    def __init__(self, encode: Callable[[list], list], limit: int = 400_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def fill(self, chunks: Iterable) -> None:
        missing = set(chunks).difference(self)
        if missing:
            if len(self) + len(missing) > self.limit:
                keep = set(chunks)
                self.clear()
                missing = keep
            missing = list(missing)
            self.update(zip(missing, self.encode(missing), strict=True))


def total_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column over all rows; one scan with a partial sum in each task."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(col(text)).cast("long") + 16), F.lit(0))).first()[0])


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """n block numbers that Spark's hash partitioning deals into n partitions, one each; plain numbers collide."""
    most, found = 16 * n + 64, []
    while len(found) < n:
        slot = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        found = spark.range(most).groupBy(slot.alias("slot")).agg(F.min("id").cast("int").alias("label")).collect()
        most *= 4
    return [r.label for r in sorted(found, key=lambda r: r.slot)]


def with_block(df: DataFrame, text: str, block_bytes: int, name: str = "_block", even: int = 0) -> tuple[DataFrame, int]:
    """Deals rows into blocks of about block_bytes of text each, by a hash of their places in the input, repeated rows too; write
    the result before it is read twice. The number of blocks grows with the input, so a block has the same size at every scale.
    Up to `even` blocks get numbers that hash evenly."""
    n = max(1, -(-total_bytes(df, text) // block_bytes))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    if 1 < n <= even:
        block = F.element_at(F.array(*map(F.lit, even_labels(df.sparkSession, n))), block + 1)
    return df.withColumn(name, block), n

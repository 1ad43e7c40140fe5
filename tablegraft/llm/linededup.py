"""Operator 7: lines that many documents share, found through a sharded minimal perfect hash.

Each task counts, for its own documents, how many hold a line's key (128 bits of it: 64 to place it, 64 as fingerprint), and
the counts are summed by key. The keys that enough documents hold are dealt into shards; each shard becomes a minimal perfect
hash by levels of bit arrays (a key takes the place that no other key of its level hashes to), which indexes an array of
fingerprints and one of counts. Documents probe these arrays; lines are never joined.

The arrays go to every worker while they are within `most_bytes`. Beyond, each block of documents sends its distinct keys to the
shards they belong to, where the arrays are probed, and gets back those that must go. Blocks and shards are of bounded size, and a
shard that is asked much is probed in several places, each with `asked_a_part` keys or so; nothing grows but their number.

A key is the line with \\x20 and \\x09-\\x0D stripped at both ends and A-Z lower-cased; keys of under min_chars code points
always stay. A null or empty text is one empty line. Each row counts as a document of its own, repeated rows too. A text whose
lines all go becomes the empty text. An empty table gives an empty result. Further columns stay as they are, whatever their names;
columns named n_lines or n_dropped in the input are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, col, fresh, materialise, raw, slices, with_block

_probes: dict = {}
_STRIP = b" \t\n\v\f\r"
LEVELS = 48


def _mix(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each 64-bit key in a level of `size` bits."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys; index() gives 0 to n - 1 for them, and any place or -1 for others."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before, self.ranks = [0], []
        for b in bits:
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(b), dtype=np.int64)])
            self.ranks.append(ones)
            self.before.append(self.before[-1] + int(ones[-1]))

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 1.5) -> PerfectHash:
        sizes, bits, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(load * len(left)))
            at = _mix(left, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(sizes, bits, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits) in enumerate(zip(self.sizes, self.bits, strict=True)):
            if not len(open_):
                return out
            at = _mix(keys[open_], level, size).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = (self.before[level] + self.ranks[level][byte] + below)[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out


class Shard:
    """Fingerprints and counts in the order of a minimal perfect hash."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.hash, self.prints, self.counts = hash_, prints, counts

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> Shard:
        hash_ = PerfectHash.build(keys)
        at = hash_.index(keys)
        out = cls(hash_, np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint32))
        out.prints[at], out.counts[at] = prints, np.minimum(counts, 0xFFFFFFFF)
        return out

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """How many documents hold each key; 0 for keys that the shard hasn't."""
        out = np.zeros(len(keys), np.int64)
        if len(self.prints):
            at = self.hash.index(keys)
            hit = (at >= 0) & (self.prints[at] == prints)
            out[hit] = self.counts[at[hit]]
        return out

    def row(self) -> tuple:
        h = self.hash
        return (h.sizes, [b.tobytes() for b in h.bits], h.rest.tobytes(), self.prints.tobytes(), self.counts.tobytes())

    @classmethod
    def of(cls, sizes, bits, rest, prints, counts) -> Shard:
        return cls(PerfectHash(list(sizes), [np.frombuffer(b, np.uint8) for b in bits], np.frombuffer(rest, np.uint64)), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32))


def keys_of(data: bytes, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their 128-bit keys; empty for lines that are too short to count."""
    lines = data.split(b"\n")
    out = []
    for line in lines:
        key = line.strip(_STRIP).translate(LOWER)
        long = len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else b"")
    return lines, out


def _pair(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def counted(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(lo, hi, n): in how many documents each key is found."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for data in raw(part.column(0)):
                    counts.update(set(keys_of(data, min_chars)[1]))
                if len(counts) > 400_000:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    def table(counts):
        counts.pop(b"", None)
        lo, hi = _pair(list(counts)) if counts else (np.zeros(0, "u8"),) * 2
        return pa.RecordBatch.from_arrays([pa.array(lo.view("i8")), pa.array(hi.view("i8")), pa.array(list(counts.values()), pa.int64())], names=["lo", "hi", "n"])

    return docs.select(col(text).cast("string").alias("text")).mapInArrow(run, "lo long, hi long, n long").groupBy("lo", "hi").agg(F.sum("n").alias("n"))


def build_shards(frequent: DataFrame, keys_a_shard: int = 65536) -> tuple[DataFrame, int, int]:
    """(shards, number of shards, number of keys); a shard is a row of arrays."""
    n = frequent.count()
    shards = max(1, -(-n // keys_a_shard))

    def build(table: pa.Table) -> pa.Table:
        lo, hi, n = (table.column(c).to_numpy() for c in ("lo", "hi", "n"))
        sizes, bits, rest, prints, counts = Shard.build(lo.view("u8"), hi.view("u8"), n).row()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.list_(pa.binary())), "rest": [rest], "prints": [prints], "counts": [counts]})

    built = frequent.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits array<binary>, rest binary, prints binary, counts binary")
    return materialise(built, "shards"), shards, n


def _shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return hi.view("i8") % shards


def _without(lines: list[bytes], keys: list[bytes], gone) -> tuple[bytes, int, int]:
    kept = [line for line, k in zip(lines, keys, strict=True) if not (k and k in gone)]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drop_shared_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, most_bytes: int = 64 << 20, block_bytes: int = 16 << 20, asked_a_part: int = 1 << 21) -> DataFrame:
    """All columns of docs, `text` without the lines that min_docs or more documents hold, and n_lines and n_dropped."""
    frequent = materialise(counted(docs, text, min_chars).where(F.col("n") >= min_docs), "lines")
    table, shards, n = build_shards(frequent)
    docs = docs.select(*[col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")])
    if 13 * n <= most_bytes:  # 8 bytes of fingerprint, 4 of count, about 4 bits of hash a key
        return _probe_here(docs, text, table, shards, min_docs, min_chars)
    return _probe_there(docs, text, table, shards, min_docs, min_chars, block_bytes, asked_a_part)


def _probe_here(docs: DataFrame, text: str, table: DataFrame, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    rows = {r.shard: (r.sizes, r.bits, r.rest, r.prints, r.counts) for r in table.collect()}
    shared, mark = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def probe(column: pa.Array) -> pa.Array:
        if mark not in _probes:  # once a worker
            _probes.clear()
            _probes[mark] = {k: Shard.of(*v) for k, v in shared.value.items()}
        arrays, out = _probes[mark], []
        for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
            split = [keys_of(data, min_chars) for data in raw(part.column(0))]
            distinct = list({k for _, keys in split for k in keys if k})
            gone: set[bytes] = set()
            if distinct and arrays:
                lo, hi = _pair(distinct)
                of = _shard_of(hi, shards)
                for s in np.unique(of):
                    if int(s) in arrays:
                        at = np.flatnonzero(of == s)
                        gone.update(distinct[i] for i in at[arrays[int(s)].count(lo[at], hi[at]) >= min_docs])
            out += [_without(lines, keys, gone) for lines, keys in split]
        kept, lines, dropped = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])

    probing = F.arrow_udf(probe, "text string, n_lines long, n_dropped long")
    (name,) = fresh(docs.columns, "_kept")
    out = docs.withColumn(name, probing(col(text).cast("string")))
    return out.select(*[F.col(f"{name}.text").alias(c) if c == text else col(c) for c in docs.columns], f"{name}.n_lines", f"{name}.n_dropped")


def _probe_there(docs: DataFrame, text: str, table: DataFrame, shards: int, min_docs: int, min_chars: int, block_bytes: int, asked_a_part: int) -> DataFrame:
    names, own_text = docs.columns, f"c{docs.columns.index(text)}"
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # grouped frames take plain names only
    text, block = own_text, "block"
    blocked = materialise(with_block(docs, text, block_bytes, block)[0], "blocked")

    def send(batches):
        for batch in batches:
            for part in slices(batch, 1):
                own: dict[int, set] = {}
                for block, data in zip(part.column(0).to_pylist(), raw(part.column(1)), strict=True):
                    own.setdefault(block, set()).update(k for k in keys_of(data, min_chars)[1] if k)
                for block, keys in own.items():
                    if keys:
                        lo, hi = _pair(list(keys))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), block, np.int32)), pa.array(_shard_of(hi, shards).astype(np.int32)), pa.array(lo.view("i8")), pa.array(hi.view("i8"))], names=["block", "shard", "lo", "hi"])

    def ask(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        asked = asked.select(["block", "lo", "hi"])
        if not arrays.num_rows or not asked.num_rows:
            return asked.slice(0, 0)
        row = arrays.to_pylist()[0]
        shard = Shard.of(row["sizes"], row["bits"], row["rest"], row["prints"], row["counts"])
        lo, hi = asked.column("lo").to_numpy().view("u8"), asked.column("hi").to_numpy().view("u8")
        return asked.filter(pa.array(shard.count(lo, hi) >= min_docs))

    def apply(own: pa.Table, gone: pa.Table) -> pa.Table:
        lo, hi = gone.column("lo").to_numpy().view("u8"), gone.column("hi").to_numpy().view("u8")
        keys = {a.tobytes() for a in np.stack([lo, hi], axis=1)} if len(lo) else set()
        kept = [_without(*keys_of(x, min_chars), keys) for x in raw(own.column(text).combine_chunks().cast(pa.string()))]
        new, lines, dropped = zip(*kept, strict=True) if kept else ((), (), ())
        own = own.set_column(own.schema.get_field_index(text), text, pa.array(new, pa.binary()).cast(pa.string())).drop_columns([block])
        return own.append_column("n_lines", pa.array(lines, pa.int64())).append_column("n_dropped", pa.array(dropped, pa.int64()))

    asked = blocked.select(F.col(block).alias("block"), col(text).cast("string").alias("text")).mapInArrow(send, "block int, shard int, lo long, hi long").dropDuplicates(["block", "shard", "lo", "hi"])
    asked = materialise(asked, "asked")
    salts = max(1, -(-asked.count() // (shards * asked_a_part)))
    asked = asked.withColumn("salt", F.pmod(F.col("lo"), F.lit(salts)).cast("int"))
    everywhere = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gone = asked.groupBy("shard", "salt").cogroup(everywhere.groupBy("shard", "salt")).applyInArrow(ask, "block int, lo long, hi long")
    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields]
    out = T.StructType(fields).add("n_lines", "long").add("n_dropped", "long")
    return blocked.groupBy(block).cogroup(gone.groupBy("block")).applyInArrow(apply, out).toDF(*names, "n_lines", "n_dropped")

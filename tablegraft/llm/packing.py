"""Operator 6: packing token sequences by linear grouping.

Only lengths decide. Lengths over an eighth of the capacity are large: in falling order they form groups of equal cardinality,
and each length counts as the largest of its group. A length with as many rows as a group should have is a group of its own, so
that no frequent length is rounded up. For these few sizes, configurations that fill a sequence best are found
by dynamic programming, largest size first, and each is used as often as its sizes last. Actual documents then take the
places of their group, which leaves room that is known again from their own lengths; small lengths go, largest first, where
they leave the least room. The plan is made from a table of counts by length, whose size doesn't depend on the data; a row
finds its sequence by its rank among the rows of its length. Ranks are counted within salted parts of a length, as many as its
rows need at `rows_a_part` each, so that a length that a third of all rows share is no task's burden at any scale.

Null text counts as empty: one piece with the end id only. Repeated rows are packed each on its own. An empty table gives an
empty result. Other columns than the two named are not read; long texts are cut into pieces of full capacity but for the
first.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices

#: What the library's pattern and tiktoken's surely tell apart alike; texts with other characters take the library's way.
_ODD = re.compile("[^\n\x20-\x7e\xa1-\u024f]")
_CUT = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
_tables: dict = {}


class Encoder:
    """The library's byte-level tokenizer. Texts of plain characters go through tiktoken with the same vocabulary, which merges in
    the same order and is several times as fast; texts with others, or with an added token's string, through the library."""

    def __init__(self, path: str, longest: int = 1 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.longest = Tokenizer.from_file(path), longest
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Byte-level vocabularies write bytes that are no printable Latin-1 characters as the characters from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.added}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, text: str):
        """A long text cut between a letter and a space before a letter, where every token ends."""
        at = 0
        while len(text) - at > self.longest:
            m = _CUT.search(text, at + self.longest)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers in native order."""
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif _ODD.search(t) or any(x in t for x in self.added):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            elif len(t) <= self.longest:
                out.append(array("I", self.fast.encode_ordinary(t)).tobytes())
            else:
                out.append(b"".join(array("I", self.fast.encode_ordinary(x)).tobytes() for x in self._parts(t)))
        return out


def encoder(path: str) -> Encoder:
    if path not in _tables:
        _tables[path] = Encoder(path)
    return _tables[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for a first one with the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text. `tokenizer` is a path that each executor can open."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        table = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, 1):
                docs_, cols, ids = [], [], []
                for i, data in enumerate(table.encode(part.column(1).to_pylist())):
                    data += tail
                    for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        docs_.append(i)
                        cols.append((k, start, length, zlib.crc32(own)))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                piece, start, length, crc = zip(*cols, strict=True)
                arrays = [part.column(0).take(pa.array(docs_, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    names = schema.names
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _fill(room: int, sizes: np.ndarray, left: np.ndarray) -> list[int]:
    """Groups whose sizes fill `room` as far as can be, none used more often than is left of it; large sizes are preferred."""
    best = np.full(room + 1, -1, np.int32)
    best[0] = len(sizes)
    for g, s in enumerate(sizes):
        for _ in range(min(int(left[g]), room // int(s))):
            new = (best[s:] < 0) & (best[:-s] >= 0)
            if not new.any():
                break
            best[s:][new] = g
        if best[room] >= 0:
            break
    at, out = int(np.max(np.nonzero(best >= 0))), []
    while at:
        out.append(int(best[at]))
        at -= int(sizes[best[at]])
    return out


class Plan:
    """Places by length: of the rows of a length in order of rank, `count` ones from `first` on go to the sequences from `base`
    on, one each, at `offset`."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = 448, small: int | None = None):
        self.capacity, self.sequences = capacity, 0
        self.places: list[tuple[int, int, int, int, int]] = []  # length, first, count, base, offset
        self.used: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (base, count)
        small = capacity // 8 if small is None else small
        self._large({k: v for k, v in counts.items() if k > small and v}, groups)
        for length in sorted((k for k, v in counts.items() if k <= small and v), reverse=True):
            self._small(length, counts[length])

    def _put(self, length: int, count: int, base: int, offset: int) -> None:
        self.places.append((length, self.used[length], count, base, offset))
        self.used[length] += count

    def _large(self, counts: dict[int, int], groups: int) -> None:
        lengths = sorted(counts, reverse=True)
        total, size_of, members, done = sum(counts.values()), [], [], 0
        for length in lengths:  # a length is in one group only
            k = done * groups // max(1, total)
            if not members or k != last or counts[length] * groups >= total:
                size_of.append(length)
                members.append([])
                last = k
            members[-1].append([length, counts[length]])
            done += counts[length]
        sizes, left = np.array(size_of, np.int64), np.array([sum(c for _, c in m) for m in members], np.int64)
        while left.any():
            g = int(np.argmax(left > 0))
            left[g] -= 1
            config = [g, *_fill(self.capacity - int(sizes[g]), sizes, left)]
            left[g] += 1
            need = np.bincount(config, minlength=len(sizes))
            times = int(np.min(left[need > 0] // need[need > 0]))
            left -= times * need
            self._substitute(config, times, members)

    def _substitute(self, config: list[int], times: int, members: list[list[list[int]]]) -> None:
        """Actual lengths, largest first, take the places of their groups."""
        while times:
            slots, taken = [], defaultdict(int)
            for g in config:
                at, skip = 0, taken[g]
                while skip >= members[g][at][1]:
                    skip -= members[g][at][1]
                    at += 1
                slots.append(members[g][at])
                taken[g] += 1
            need: dict[int, int] = defaultdict(int)
            for s in slots:
                need[id(s)] += 1
            n = max(1, min([times, *(s[1] // need[id(s)] for s in slots)]))
            offset = 0
            for s in slots:
                self._put(s[0], n, self.sequences, offset)
                offset += s[0]
                s[1] -= n
            for g in set(config):
                members[g][:] = [m for m in members[g] if m[1]]
            self.room[self.capacity - offset].append((self.sequences, n))
            self.sequences += n
            times -= n

    def _small(self, length: int, count: int) -> None:
        room = length
        while count:
            while room <= self.capacity and not self.room.get(room):
                room += 1
            if room > self.capacity:
                n = -(-count // (self.capacity // length))
                self.room[self.capacity].append((self.sequences, n))
                self.sequences += n
                room = self.capacity
            base, n = self.room[room].pop()
            k = min(n, count)
            self._put(length, k, base, self.capacity - room)
            if k < n:
                self.room[room].append((base + k, n - k))
            self.room[room - length].append((base, k))
            count -= k
            room = length

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        by: dict[int, list] = defaultdict(list)
        for length, first, _, base, offset in self.places:
            by[length].append((first, base, offset))
        return {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for k, v in by.items()}


def pack(lengths: DataFrame, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id", "piece"), rows_a_part: int = 1 << 19, groups: int = 448) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to capacity. `lengths` is read twice: pass a written table."""
    how_many = {r.length: r.n for r in lengths.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = {k: -(-n // rows_a_part) for k, n in how_many.items()}
    split = [F.lit(x).cast("long") for k, s in sorted(salts.items()) if s > 1 for x in (k, s)]
    fan = F.coalesce(F.element_at(F.create_map(*split), F.col("length")), F.lit(1)) if split else F.lit(1)
    salted = lengths.withColumn("_salt", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), fan).cast("int"))
    salted = materialise(salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)).cast("long") - 1), "ranked")
    first = {k: np.zeros(s, np.int64) for k, s in salts.items()}  # ranks before each part
    for r in salted.where(F.col("_salt") + 1 < fan).groupBy("length", "_salt").agg(F.count("*").alias("n")).collect():
        first[r.length][r["_salt"] + 1] = r.n
    first = {k: np.cumsum(n) for k, n in first.items()}
    shared = lengths.sparkSession.sparkContext.broadcast((first, Plan(how_many, capacity, groups).tables()))
    schema = T.StructType([*lengths.schema.fields]).add("sequence_id", "long").add("offset", "long")

    def run(batches):
        first, tables = shared.value
        for batch in batches:
            length, salt, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_salt", "_nth"))
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for k in np.unique(length):
                own = length == k
                starts, bases, offsets = tables[int(k)]
                rank = first[int(k)][salt[own]] + nth[own]
                at = np.searchsorted(starts, rank, side="right") - 1
                sequence[own] = bases[at] + rank - starts[at]
                offset[own] = offsets[at]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("_salt", "_nth")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return salted.select(*lengths.columns, "_salt", "_nth").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(materialise(pieces(docs, tokenizer, capacity, end_id, doc_id, text), "pieces"), capacity)

"""Operator 1: SentencePiece encoding and decoding over a distinct-chunk table.

A marked word is a run of whitespace markers followed by what stands before the next marker. No piece of the model has a
marker after another character, so no merge crosses the start of a marked word: each distinct one is segmented once for a
worker, and a text's ids are its words' ids, joined by position. Ids are decoded by a table of the bytes that each stands for. A
model for which this doesn't hold is applied to whole texts, both ways.

Null text counts as empty: only the end id, decoded to the empty text. Repeated rows give repeated results; an empty table
gives an empty result; other columns than the two named are not read. Texts of any length go through in runs of words.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DistinctTable, runs, slices

MARK = "▁"
_WORD = re.compile(" +[^ ]*")
_tables: dict = {}


class Codec:
    """The library's model with a table of distinct marked words."""

    def __init__(self, model: str, limit: int = 300_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.by_word = self._words_stand_alone(model)
        self.lone = [self.sp.piece_to_id(MARK)]
        self.bytes_of = pa.array([self._bytes(i) for i in range(self.sp.get_piece_size())], pa.binary())
        self.table = DistinctTable(self._segment, limit)

    def _words_stand_alone(self, model: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        plain = proto.normalizer_spec
        return (
            plain.name == "identity" and not plain.precompiled_charsmap and plain.add_dummy_prefix and plain.escape_whitespaces and not plain.remove_extra_whitespaces
            and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == 4 or re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        )

    def _bytes(self, i: int) -> bytes:
        """What an id stands for in a decoded text; control ids stand for nothing."""
        if self.sp.is_control(i):
            return b""
        piece = self.sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace(MARK, " ").encode()

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """A chunk starts with a space, which is the one that the library puts before a text."""
        rows = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        return [array("i", r if len(c) > 1 else self.lone).tobytes() for c, r in zip(chunks, rows, strict=True)]

    def _joined(self, words: list[str]) -> bytes:
        try:
            return b"".join([self.table[w] for w in words])
        except KeyError:  # emptied meanwhile, or a long text's words
            self.table.fill(words)
            return b"".join([self.table[w] for w in words])

    def encode(self, texts: list[str | None], end: bool = True) -> list[bytes]:
        """The ids of each text as 32-bit integers in native order."""
        if not self.by_word:
            return [array("i", self.sp.encode(t or "", add_eos=end)).tobytes() for t in texts]
        tail = array("i", [self.sp.eos_id()] if end else []).tobytes()
        if any(len(t or "") >= 1 << 20 for t in texts):
            parts = (runs(m.group() for m in _WORD.finditer(" " + t.replace(MARK, " "))) if t else () for t in texts)
            return [b"".join(map(self._joined, p)) + tail for p in parts]
        lists = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self.table.fill({w for words in lists for w in words})
        return [self._joined(words) + tail for words in lists]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of rows of ids that `encode` gave; row k ends before ends[k + 1]. Ids stand for bytes that follow each other,
        but for the space that the library put before the text."""
        if not self.by_word:
            return pa.array([self.sp.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        taken = self.bytes_of.take(pa.array(ids))
        _, at, data = taken.buffers()
        cuts = np.frombuffer(at, np.int32)[ends] if len(ids) else np.zeros(len(ends), np.int32)
        some = cuts[1:] > cuts[:-1]
        kept = np.delete(np.frombuffer(data, np.uint8, cuts[-1]), cuts[:-1][some]) if some.any() else b""
        cuts = cuts - np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(kept)]).cast(pa.string())


def codec(model: str) -> Codec:
    if model not in _tables:
        _tables[model] = Codec(model)
    return _tables[model]


def encode_decode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text. `model` is a path that each executor can open."""

    def run(batches):
        table = codec(model)
        for batch in batches:
            for part in slices(batch, 1, 512 << 10):
                rows = table.encode(part.column(1).to_pylist(), end)
                ends = np.cumsum([0, *(len(x) // 4 for x in rows)]).astype(np.int32)
                ids = np.frombuffer(b"".join(rows), np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), table.decode(ids, ends)], names=["doc_id", "ids", "decoded"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns from the operator's ids and texts."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

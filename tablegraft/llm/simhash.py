"""Operator 10: SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight bytes at eight positions. Two that differ in at most b bits share at least 8 - b of them: with
b = 4, at least three of the first seven positions agree. Equal fingerprints are one from the start. The index posts each
distinct fingerprint under the bytes at every three of seven positions (every four of eight beyond 2^27 fingerprints); the
fingerprints of a posting are compared in blocks, the shared positional bytes of each pair are tallied over all eight positions,
pairs that reach the guaranteed count of four are kept, and their bits are compared. Within a block only the links of a spanning forest leave the task, which join the same documents as all links do.
A posting longer than a tile is cut into tiles whose pairs are compared as rows of their own, so no posting is too long for a
task and none is capped.

Components come from alternating large-star and small-star rounds over the links, whose endpoints are fingerprints.

Near copies at a given similarity (`verified` and `keep_verified`) go through the same index first: the SimHash fingerprints of their
sets of distinct shingles are posted by positional bytes, counted and linked, and what they link is one posting. That isn't enough at
0.8, where two texts differ in some nine of 64 bits, so that no byte need be shared. For pairs further apart there are postings of
min-wise hashes of the sets: BANDS x ROWS of them, posted under each band of ROWS, and SKETCH of them as positional bytes whose
agreement is tallied. Pairs in any posting that share fewer bytes than `least_shared` are dropped by count, all others are decided by
the Jaccard similarity of their whole sets. The search is statistical, the verdict isn't: at a similarity of 0.8 a pair has no band in
common with a probability of 5e-5, at any length.

Postings hold ids; sets are made only of texts that share a posting. Each of these is first verified against two partners, the one
it shares most bytes with and the one that all share most with, which joins large groups by few pairs. Pairs that this leaves in
different groups are then verified all, in tasks that hold the sets of a posting's texts: each pair in the first posting it shares,
so that pairs never become rows. A posting too large for a task is cut into tiles, but pairs within its largest group need none.

Null text counts as empty: no words, fingerprint zero, linked like any other. A null id takes part in no minimum, its row has
the component of its fingerprint (null if no other id is reached). Repeated rows get equal rows; an empty table gives an
empty result. Other columns than the two named are not read.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom, col, fresh, materialise, raw, slices, words

SEED, TILE = 42, 2048
BANDS, ROWS, SKETCH = 25, 5, 64
_XOR, _TIMES = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def _hashes(data: bytes, shingle: int, part: int):
    """How many word shingles there are, and their hashes in parts."""
    own = words(data)
    if not own:
        return 0, ()
    text, n = b" ".join(own), max(1, len(own) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[-n:]
    cut = lambda at: map(text.__getitem__, map(slice, starts[at : at + part].tolist(), ends[at : at + part].tolist()))
    return n, (np.fromiter(map(xxhash.xxh64_intdigest, cut(at), repeat(SEED)), ">u8") for at in range(0, n, part))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of big-endian hashes; sums of up to 255 rows fit a byte."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1)
    return sum(np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8).astype(np.int64) for at in range(0, len(bits), 255))


def fingerprint(data: bytes, shingle: int = 4, part: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles, repeats included."""
    n, parts = _hashes(data, shingle, part)
    if not n:
        return 0
    return int.from_bytes(np.packbits(sum(map(_ones, parts)) * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, body, fp): body is a hash of the text as it is, fp the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                got = np.array([fingerprint(x, shingle) for x in raw(part.column(2))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got.view(np.int64))], names=["doc_id", "body", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("body", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("body"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _plan(bits: int, n: int = 0) -> tuple[int, list[tuple[int, ...]]]:
    """How many bytes a linked pair shares at least, and the sets of positions to post under: three bytes each, or four where n
    fingerprints would make postings of three long. Any linked pair shares one of the sets, whichever size they have."""
    shared = 8 - bits
    if shared < 1:
        raise ValueError("at 8 or more bits no byte need be shared")
    own = min(3 if n < 1 << 27 else 4, shared)
    return shared, list(combinations(range(8 - shared + own), own))


def postings(distinct: DataFrame, bits: int = 4, n: int = 0) -> DataFrame:
    """(key, fp): key names the positions and holds their bytes."""
    keys = []
    for k, positions in enumerate(_plan(bits, n)[1]):
        mask = 0
        for p in positions:
            mask |= 0xFF << (8 * p)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(a: np.ndarray, b: np.ndarray | None, bits: int, shared: int) -> list[tuple[int, int]]:
    """Links between the fingerprints of a (or of a and b) that join what all their links join."""
    both = a if b is None else np.concatenate([a, b])
    root = list(range(len(both)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(a)):
        others = a[i + 1 :] if b is None else b
        x = others ^ a[i]
        tally = np.zeros(len(x), np.int8)  # positional bytes in common
        for p in range(8):
            tally += ((x >> np.uint64(8 * p)) & np.uint64(0xFF)) == 0
        near = np.flatnonzero(tally >= shared)
        near = near[np.bitwise_count(x[near]) <= bits]
        for j in near.tolist():
            k = i + 1 + j if b is None else len(a) + j
            s, t = find(i), find(k)
            if s != t:
                root[t] = s
                out.append((int(a[i].view(np.int64)), int(both[k].view(np.int64))))
    return out


def _rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x, y = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints at `bits` or fewer differing bits, enough to connect what all links connect."""
    n = distinct.count()
    shared, _ = _plan(bits, n)
    posted = postings(distinct, bits, n)
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = materialise(sizes, "postings")
    long = sizes.where(F.col("n") > tile)
    kept = posted.join(sizes, "key")

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            out: list[tuple[int, int]] = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if keys[s] != key:
                    out += _forest(np.concatenate(held), None, bits, shared) if held else []
                    key, held = keys[s], []
                held.append(fps[s:e])
            yield _rows(out)
        if held:
            yield _rows(_forest(np.concatenate(held), None, bits, shared))

    short = kept.where(F.col("n") <= tile).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    if not long.take(1):
        return short.distinct()
    # A long posting: tiles by a hash of the fingerprint, and a group for each pair of tiles.
    tiles = F.ceil(F.col("n") / (tile // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = kept.where(F.col("n") > tile).withColumn("tiles", tiles).withColumn("own", own)
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp"
    )

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, fps = table.column("own").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        pairs = _forest(fps, None, bits, shared) if i == j else _forest(fps[own == i], fps[own == j], bits, shared)
        return pa.Table.from_batches([_rows(pairs)])

    return short.unionByName(paired.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): the least node that each node of an edge reaches, by alternating large-star and small-star."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = materialise(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, body, fp, root, component_id) of every document; root names its group of fingerprints."""
    marked = materialise(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(ids, "root").select("fp", "root", "component_id")
    return marked.join(by_print, "fp").select("doc_id", "body", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    out = grouped(docs, doc_id, text, shingle, bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(data: bytes, shingle: int = 5, part: int = 1 << 16) -> np.ndarray:
    """Hashes of the distinct word shingles in order; none for a text without words."""
    _, parts = _hashes(data, shingle, part)
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(x.astype(np.uint64) for x in parts)]))


def set_print(own: np.ndarray, part: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half the hashes of a set; zero for none."""
    if not len(own):
        return 0
    ones = sum(_ones(own[at : at + part].astype(">u8")) for at in range(0, len(own), part))
    return int.from_bytes(np.packbits(ones * 2 > len(own)).tobytes(), "big")


def sketch(own: np.ndarray, part: int = 1 << 11) -> tuple[bytes, bytes]:
    """Band keys of eight bytes each, and positional bytes, from the min-wise hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), part):
        least = np.minimum(least, ((own[at : at + part, None] ^ _XOR) * _TIMES).min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ x) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.tobytes(), least[:SKETCH].astype(np.uint8).tobytes()


def least_shared(similarity: float) -> int:
    """How many of SKETCH bytes sets of this similarity share, less 4.5 standard deviations."""
    return int(SKETCH * similarity - 4.5 * math.sqrt(SKETCH * similarity * (1 - similarity)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted arrays without repeats; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether sets are so similar; sizes alone often tell."""
    few, many = sorted((len(a), len(b)))
    return few >= similarity * many - 1e-9 and jaccard(a, b) >= similarity


def _matrix(column, width: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _partners(fps: np.ndarray, marks: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(fp, partner, shared, hub): of each row the row that it shares most positional bytes with, and the row that all rows share
    most with, where they share `least` of them."""
    n = len(fps)
    order = np.argsort(fps)
    fps, marks = fps[order], marks[order]
    best, top, total = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    for i in range(n):
        tally = (marks == marks[i]).sum(axis=1)
        tally[i] = -1
        best[i], top[i] = (k := int(tally.argmax())), tally[k]
        total[i] = tally[tally >= least].sum()
    hub = int(total.argmax())
    shared = (marks == marks[hub]).sum(axis=1)
    out = [(int(fps[i]), int(fps[best[i]]), int(top[i]), 0) for i in np.flatnonzero(top >= least)]
    return out + [(int(fps[i]), int(fps[hub]), int(shared[i]), 1) for i in np.flatnonzero(shared >= least) if i != hub]


def first_pairs(posted: DataFrame, members: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    """(fp, partner, hub): for each text of a posting (band, key, fp, n) at most one partner and one hub. Postings longer than a tile
    are looked at in parts, so a better partner may be missed; nothing is decided here."""

    def run(table: pa.Table) -> pa.Table:
        rows = _partners(table.column("fp").to_numpy(), _matrix(table.column("mark"), SKETCH), least)
        cols = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("fp", "partner", "shared", "hub"), cols, strict=True)})

    parts = F.ceil(F.col("n") / tile)
    dealt = posted.withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int")).join(members.select("fp", "mark"), "fp").select("key", "part", "fp", "mark")
    found = dealt.groupBy("key", "part").applyInArrow(run, "fp long, partner long, shared long, hub long")
    return found.groupBy("fp", "hub").agg(F.max_by("partner", F.struct("shared", "partner")).alias("partner")).select("fp", "partner", "hub")


def _deal(rows: DataFrame, tile: int, most_bytes: int) -> DataFrame:
    """Adds (i, j, side) to rows (key, fp, root, weight): the tasks that a row goes to, so that every two rows of a key with different
    roots meet in one. A key that one task can hold is one task, (0, 0). A larger one is cut into tiles, first those of rows
    outside its largest root, then those of its largest root, which need not meet each other."""
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    sizes = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max(F.struct("n", "root", "w")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    count = lambda n, w: F.greatest(F.lit(1), F.ceil(n / (tile // 2)), F.ceil(w / (most_bytes // 2))).cast("int")
    sizes = sizes.where(F.col("n") > F.col("most.n")).select(
        "key", "major", ((F.col("n") > tile) | (F.col("w") > most_bytes)).alias("long"),
        count(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("few"), count(F.col("most.n"), F.col("most.w")).alias("many"),
    )
    mixed = rows.join(sizes, "key").withColumn("mine", F.col("root") == F.col("major"))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("mine"), F.col("many")).otherwise(F.col("few"))).cast("int")
    side = F.when(F.col("mine"), F.col("few") + own).otherwise(own)
    others = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    across = others(F.col("few"), lambda o: pair(o, F.col("side")))
    among = others(F.col("few"), lambda o: pair(F.least(o, F.col("side")), F.greatest(o, F.col("side"))))
    outward = others(F.col("many"), lambda o: pair(F.col("side"), F.col("few") + o))
    tasks = F.when(~F.col("long"), F.array(pair(F.lit(0), F.lit(0)))).when(F.col("mine"), across).otherwise(F.concat(among, outward))
    out = mixed.withColumn("side", F.when(F.col("long"), side).otherwise(0)).withColumn("task", F.explode(tasks))
    return out.select(*rows.columns, "side", F.col("task.i").alias("i"), F.col("task.j").alias("j"))


def _untested(table: pa.Table, least: int):
    """Positions of pairs that are to be verified here: in different groups, sharing `least` positional bytes, not yet tested, and
    sharing no posting of an earlier band."""
    fps, roots, side = (table.column(c).to_numpy() for c in ("fp", "root", "side"))
    marks, keys = _matrix(table.column("mark"), SKETCH), _matrix(table.column("keys"), BANDS, np.uint64)
    done, band, i_, j_ = [table.column(c).to_numpy() for c in ("least_tested", "most_tested")], *(table.column(c)[0].as_py() for c in ("band", "i", "j"))
    rows, others = (np.flatnonzero(side == x) for x in (i_, j_))
    for at, i in enumerate(rows):
        near = others if i_ != j_ else others[at + 1 :]
        near = near[roots[near] != roots[i]]
        near = near[(marks[near] == marks[i]).sum(axis=1) >= least]
        near = near[~(keys[near, :band] == keys[i, :band]).any(axis=1)]
        for t in done:
            near = near[(t[near] != fps[i]) & (fps[near] != t[i])]
        if len(near):
            yield int(i), near.tolist()


def apart_pairs(posted: DataFrame, members: DataFrame, sets: DataFrame, least: int, similarity: float, tile: int = TILE, most_bytes: int = 16 << 20) -> DataFrame:
    """(a, b): links between texts of different roots that share a posting, enough to join what all such links join. members are
    (fp, root, mark, keys, least_tested, most_tested)."""
    rooted = posted.join(members.select("fp", "root"), "fp")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    rows = rooted.join(mixed, "key").select("band", "key", "fp", "root").join(members.drop("root"), "fp")

    def ask(table: pa.Table) -> pa.Table:
        asked = {k for i, near in _untested(table, least) for k in (i, *near)}
        return table.select(["band", "key", "fp"]).take(pa.array(sorted(asked), pa.int64()))

    def verify(table: pa.Table) -> pa.Table:
        fps, roots = table.column("fp").to_numpy(), table.column("root").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()]
        root = {r: r for r in roots.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, near in _untested(table, least):
            for k in near:
                s, t = find(int(roots[i])), find(int(roots[k]))
                if s != t and alike(own[i], own[k], similarity):
                    root[t] = s
                    out.append((int(fps[i]), int(fps[k])))
        return pa.Table.from_batches([_rows(out)])

    dealt = _deal(rows.withColumn("weight", F.lit(SKETCH + 8 * BANDS)), tile, 1 << 40)
    asked = materialise(dealt.groupBy("key", "i", "j").applyInArrow(ask, "band int, key long, fp long").distinct(), "asked")
    held = asked.join(members, "fp").join(sets.select("fp", "own", F.octet_length("own").alias("weight")), "fp")
    return _deal(held, tile, most_bytes).groupBy("key", "i", "j").applyInArrow(verify, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets are so similar."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            kept = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one, other = sets.select(F.col("fp").alias("a"), F.col("own").alias("x")), sets.select(F.col("fp").alias("b"), F.col("own").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def print_postings(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, band, key) of sets (fp, print): one posting, band BANDS, for the fingerprints that links of SimHash join."""
    prints = materialise(distinct.select(F.col("print").alias("fp")).distinct(), "prints")
    found = components(links(prints, bits))
    return distinct.join(found, distinct.print == found.node, "left").select("fp", F.lit(BANDS).alias("band"), F.xxhash64(F.lit(BANDS), F.coalesce("root", "print")).alias("key"))


def verified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, tile: int = TILE, most_bytes: int = 16 << 20, bits: int = 4, bands: int = BANDS) -> DataFrame:
    """(doc_id, body, fp, root): groups that links between texts of this Jaccard similarity of their shingle sets join; fp names a
    set, root a group. With `bands` of 0 only texts whose fingerprints SimHash joins at `bits` are compared."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                fps, prints, keys, marks = [], [], [], []
                for x in raw(part.column(2)):
                    own = shingles(x, shingle)
                    k, m = sketch(own)
                    fps.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                    prints.append(set_print(own))
                    keys.append(k)
                    marks.append(m)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, prints)], pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], names=schema.names)

    def set_of(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x, shingle).tobytes() for x in raw(part.column(1))], pa.binary())], names=["fp", "own"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)]).add("body", "long").add("fp", "long").add("print", "long").add("keys", "binary").add("mark", "binary")
    bodies = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("body"), col(text).cast("string").alias("text"))
    marked = materialise(bodies.mapInArrow(run, schema), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("keys").alias("keys"), F.min("mark").alias("mark"), F.min("body").alias("body"), F.min("print").alias("print"))
    distinct = materialise(distinct, "distinct")
    postings_ = materialise(print_postings(distinct.select("fp", "print"), bits), "postings")
    if bands:
        keys_ = F.array(*[F.xxhash64(F.lit(k), F.substring("keys", 8 * k + 1, 8)) for k in range(bands)])
        postings_ = postings_.unionByName(distinct.select("fp", F.posexplode(keys_).alias("band", "key")))
    sizes = postings_.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    posted = materialise(postings_.join(materialise(sizes, "sizes"), "key"), "postings")
    members = materialise(distinct.drop("print").join(posted.select("fp").distinct(), "fp"), "members")
    texts = bloom(bodies.select("body", "text"), members.select("body"), "body").groupBy("body").agg(F.min("text").alias("text"))
    sets = materialise(texts.join(members.select("fp", "body"), "body").select("fp", "text").mapInArrow(set_of, "fp long, own binary"), "sets")
    least = least_shared(similarity)
    first = materialise(first_pairs(posted, members, least, tile), "pairs")
    pairs = first.select(F.least("fp", "partner").alias("a"), F.greatest("fp", "partner").alias("b")).distinct()
    links_ = materialise(_verified(pairs, sets, similarity), "links")
    found = components(links_)
    tested = first.groupBy("fp").agg(F.min("partner").alias("least_tested"), F.max("partner").alias("most_tested"))
    rooted = members.join(found, members.fp == found.node, "left").join(tested, "fp", "left").select("fp", "keys", "mark", *[F.coalesce(c, "fp").alias(c) for c in ("root", "least_tested", "most_tested")])
    more = materialise(apart_pairs(posted, materialise(rooted, "rooted"), sets, least, similarity, tile, most_bytes), "links")
    if more.take(1):
        found = components(links_.unionByName(more))
    return marked.join(found, marked.fp == found.node, "left").select("doc_id", "body", "fp", F.coalesce("root", "fp").alias("root"))


def keep_verified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of `verified` texts: that of the smallest id, of rows without an id only where a group has
    no other; of repeated rows one, whichever further columns they have."""
    rows = verified(docs, doc_id, text, shingle, similarity)
    one, body = fresh(docs.columns, "_one", "_body")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("body").alias("body"))).alias(one)
    chosen = rows.groupBy("root").agg(order).select(F.col(f"{one}.id").alias(one), F.col(f"{one}.body").alias(f"{body}_"))
    own = docs.withColumn(body, F.xxhash64(col(text)))
    kept = own.join(chosen, col(doc_id).eqNullSafe(F.col(one)) & (F.col(body) == F.col(f"{body}_")), "left_semi")
    return kept.dropDuplicates([doc_id, body]).select(*map(col, docs.columns))

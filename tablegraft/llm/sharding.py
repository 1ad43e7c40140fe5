"""Operator 4: sharding by fixed virtual slots, with DataFrame and SQL functions only.

A record's hash decides its virtual slot, one of thousands (more where slots would have over ROWS_A_SLOT rows); bytes are summed
by slot, and a versioned map, stored as a table, says which shard each slot belongs to. Its first version deals the slots evenly
by their numbers of rows; it is then edited by the bytes, slot by slot, and records take their shards from the newest version as
it was stored. Balancing works on the map alone. A slot that holds more than
an eighth of a shard's fair share (a key or repeated row with a great part of all bytes) is split into that many sub-slots
over its rows' ordinal numbers; the map has a row for each sub-slot, at most slots + 8 x shards in all.

Law `bytes`: slots move from the fullest to the emptiest shard while that helps and the two differ by more than `within` of a
fair share. Null text has no bytes, null ids are an ordinary key. Repeated rows each take a place of their own. An
empty table gives an empty result. Other columns than the two named are not read.
"""

from __future__ import annotations

import heapq
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, materialise, shared_dir

SLOTS, MOST_SLOTS, ROWS_A_SLOT = 4096, 1 << 18, 1 << 20
OVERHEAD = 16
MAP = "slot int, sub int, shard int, rows bigint, bytes bigint, first bigint, shards int, version int"


@dataclass
class SlotMap:
    """slots: of (slot, sub): rows and bytes; shard: of (slot, sub). Every edit makes a new version."""

    shards: int
    size: dict[tuple[int, int], tuple[int, int]]
    shard: dict[tuple[int, int], int] = field(default_factory=dict)
    version: int = 0

    @classmethod
    def balanced(cls, shards: int, size: dict[tuple[int, int], tuple[int, int]], by: int = 1) -> SlotMap:
        """The first version: slots, largest first, to the shard with the least, by bytes or (0) by rows."""
        out = cls(shards, size)
        loads = [(0, s) for s in range(shards)]
        for key in sorted(size, key=lambda k: (-size[k][by], k)):
            load, to = heapq.heappop(loads)
            out.shard[key] = to
            heapq.heappush(loads, (load + size[key][by], to))
        out.version = 1
        return out

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for k, s in self.shard.items():
            out[s] += self.size[k][1]
        return out

    def grown(self) -> SlotMap:
        """One more shard, which takes slots from the fullest ones until it has its share; no other slot moves."""
        out = SlotMap(self.shards + 1, self.size, dict(self.shard), self.version + 1)
        loads = out.loads()
        share = sum(loads) / out.shards
        held: dict[int, list] = {}
        for k in sorted(self.shard, key=lambda k: (self.size[k][1], k)):
            held.setdefault(self.shard[k], []).append(k)
        heap = [(-load, s) for s, load in enumerate(loads[:-1])]
        heapq.heapify(heap)
        while heap and loads[-1] < share:
            _, s = heapq.heappop(heap)
            room = share - loads[-1]
            fits = [k for k in held.get(s, []) if self.size[k][1] <= room]
            if not fits or loads[s] <= share:
                continue
            k = fits[-1]
            held[s].remove(k)
            out.shard[k] = self.shards
            loads[s] -= self.size[k][1]
            loads[-1] += self.size[k][1]
            heapq.heappush(heap, (-loads[s], s))
        return out

    def rebalanced(self, size: dict[tuple[int, int], tuple[int, int]], within: float = 0.02) -> SlotMap:
        """New sizes; slots move from the fullest to the emptiest shard while their gap is over `within` of a fair share."""
        out = SlotMap(self.shards, size, {k: self.shard.get(k, -1) for k in size}, self.version + 1)
        loads = [0] * self.shards
        for k, s in out.shard.items():
            if s >= 0:
                loads[s] += size[k][1]
        for k in sorted((k for k, s in out.shard.items() if s < 0), key=lambda k: (-size[k][1], k)):
            s = min(range(self.shards), key=lambda s: (loads[s], s))
            out.shard[k], loads[s] = s, loads[s] + size[k][1]
        share = max(1.0, sum(loads) / self.shards)
        held: dict[int, set] = {s: set() for s in range(self.shards)}
        for k, s in out.shard.items():
            held[s].add(k)
        for _ in range(4 * len(size)):
            full, low = max(range(self.shards), key=lambda s: (loads[s], -s)), min(range(self.shards), key=lambda s: (loads[s], s))
            gap = loads[full] - loads[low]
            able = [k for k in held[full] if 0 < size[k][1] < gap]
            if gap <= within * share or not able:
                break
            k = min(able, key=lambda k: (abs(gap / 2 - size[k][1]), k))
            out.shard[k] = low
            held[full].remove(k)
            held[low].add(k)
            loads[full] -= size[k][1]
            loads[low] += size[k][1]
        return out

    def rows(self) -> list[dict]:
        """With each sub-slot's first place in its shard."""
        out, at = [], [0] * self.shards
        for k in sorted(self.shard):
            s = self.shard[k]
            out.append({"slot": k[0], "sub": k[1], "shard": s, "rows": self.size[k][0], "bytes": self.size[k][1], "first": at[s], "version": self.version})
            at[s] += self.size[k][0]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        kind = "array<struct<slot:int,sub:int,shard:int,rows:bigint,bytes:bigint,first:bigint,version:int>>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(self.rows())), kind)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the map's table; older versions stay readable."""
        self.frame(spark).withColumn("shards", F.lit(self.shards)).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.schema(MAP).parquet(path)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.where(F.col("version") == version).collect()
        return cls(rows[0].shards, {(r.slot, r.sub): (r["rows"], r.bytes) for r in rows}, {(r.slot, r.sub): r.shard for r in rows}, version)


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row for each record, written once: id, size, checksum, the hash that decides its slot, and an ordinal number."""
    body = F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")
    return materialise(
        docs.select(
            col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body).alias("text_crc32"),
            F.xxhash64(col(doc_id).cast("string"), F.lit("slot")).alias("hash"), F.monotonically_increasing_id().alias("ordinal"),
        ),
        "records",
    )


def slots_for(rows: int, least: int = SLOTS, rows_a_slot: int = ROWS_A_SLOT) -> int:
    """Doubled until a slot has no more rows than it should on average."""
    while least < MOST_SLOTS and rows > least * rows_a_slot:
        least *= 2
    return least


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None, within: float = 0.001) -> DataFrame:
    """Law `bytes`: (doc_id, size, text_crc32, virtual_slot, sub, shard, slot, map_version). `slot` is a record's place in its
    shard, gapless from 0. The slot-to-shard map's versions are stored at map_path, a new folder in the shared one by default."""
    spark = docs.sparkSession
    map_path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    base = records(docs, doc_id, text)
    base = base.withColumn("virtual_slot", F.pmod("hash", F.lit(slots_for(base.count(), slots))).cast("int"))
    by_slot = base.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()  # at most `slots` rows
    most = max(1, sum(r.b for r in by_slot) // (8 * shards))
    fans = {r.virtual_slot: min(r.n, -(-r.b // most)) for r in by_slot if r.b > most and r.n > 1}
    if fans:
        hot = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"virtual_slot": k, "fan": v} for k, v in sorted(fans.items())])), "array<struct<virtual_slot:int,fan:int>>")))
        base = base.join(F.broadcast(hot), "virtual_slot", "left").withColumn("sub", F.when(F.col("fan").isNull(), 0).otherwise(F.pmod(F.xxhash64("ordinal"), F.col("fan"))).cast("int")).drop("fan")
        sizes = {(r.virtual_slot, r["sub"]): (r.n, r.b) for r in base.groupBy("virtual_slot", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    else:
        base = base.withColumn("sub", F.lit(0))
        sizes = {(r.virtual_slot, 0): (r.n, r.b) for r in by_slot}
    even = SlotMap.balanced(shards, sizes, by=0)
    even.save(spark, map_path)
    plan = even.rebalanced(sizes, within)
    plan.save(spark, map_path)
    stored = spark.read.schema(MAP).parquet(map_path).where(F.col("version") == plan.version)  # a row for each sub-slot
    places = F.broadcast(stored.select(F.col("slot").alias("virtual_slot"), "sub", "shard", "first", F.col("version").alias("map_version")))
    within = Window.partitionBy("virtual_slot", "sub").orderBy("doc_id", "ordinal")
    return (
        base.withColumn("nth", F.row_number().over(within).cast("long") - 1)
        .join(places, ["virtual_slot", "sub"])
        .select("doc_id", "size", "text_crc32", "virtual_slot", "sub", "shard", (F.col("first") + F.col("nth")).alias("slot"), "map_version")
    )

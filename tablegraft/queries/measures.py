"""Measurements and streams: latency summaries over events, seeds, telemetry, change sync, and whole migrations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..api import Repo
from ..operators import latency
from ..operators.backfill import Controller
from ..plans.runner import MigrationError
from ..sources import seed
from ..sources.scratch import shared_dir
from ..streaming import events, sync
from .branches import read


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/repo-{uuid.uuid4().hex}"


def latency_percentiles(spark, d):
    return latency.percentiles(read(spark, d, "events"), "value")


def latency_sparkline(spark, d):
    return latency.sparkline(read(spark, d, "events"), "value", ["event_id"]).withColumn("bucket", F.col("bucket").cast("long"))


def latency_downsample(spark, d):
    return latency.downsample(read(spark, d, "events"), "value", ["event_id"]).withColumn("bucket", F.col("bucket").cast("long"))


_SIZES = {"merchants": 2000, "accounts": 20000, "cards": 4000, "txns": 10000, "disputes": 5000}


def seed_violations(spark, d):
    """What a small seed plants."""
    t = {n: make(spark, _SIZES[n]) for n, make in seed.MAKERS.items()}
    dup = lambda df, c: df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(F.count("*").alias("n"))
    parts = {
        "merchants.website null": t["merchants"].where("website is null").agg(F.count("*").alias("n")), "accounts.email null": t["accounts"].where("email is null").agg(F.count("*").alias("n")),
        "accounts.email twice": dup(t["accounts"], "email"), "cards.fingerprint twice": dup(t["cards"], "fingerprint"), "txns.memo null": t["txns"].where("memo is null").agg(F.count("*").alias("n")),
        "disputes.reason null": t["disputes"].where("reason is null").agg(F.count("*").alias("n")),
    }
    out = None
    for what, df in parts.items():
        one = df.select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def seed_accounts(spark, d):
    return seed.accounts(spark, 3000).select("id", "name", "email", "country")


def _migrated(spark, d, ddl: str, tables: dict[str, str], control=None) -> Repo:
    repo = Repo(spark, _scratch(spark), control)
    repo.init({n: f"{d}/{n}.parquet" for n in tables}, {n: [k] for n, k in tables.items()})
    repo.create_branch("change")
    repo.ddl("change", ddl)
    repo.commit("change", "change")
    repo.apply_merge(repo.create_merge("change")["id"])
    return repo


def migrate_retype(spark, d):
    """A whole migration: expand, sync, backfill by key ranges, validate, cutover; then main's rows."""
    repo = _migrated(spark, d, "ALTER TABLE orders ALTER COLUMN o_custkey TYPE text; ALTER TABLE orders RENAME COLUMN o_totalprice TO amount", {"orders": "o_orderkey"}, lambda: Controller(size=1 << 20, most=1 << 24))
    return repo.table("orders").select("o_orderkey", "o_custkey", "amount", "o_orderstatus")


def migrate_and_revert(spark, d):
    repo = _migrated(spark, d, "ALTER TABLE part ALTER COLUMN p_size TYPE text; ALTER TABLE part DROP COLUMN p_type; ALTER TABLE part ADD COLUMN note text DEFAULT 'new'", {"part": "p_partkey"}, lambda: Controller(size=1 << 20))
    repo.revert_merge(1)
    return repo.table("part").select("p_partkey", "p_size", "p_type", "p_brand")


def migrate_rewind(spark, d):
    """Two merges undone by one forward plan."""
    repo = _migrated(spark, d, "ALTER TABLE supplier RENAME COLUMN s_name TO name", {"supplier": "s_suppkey"}, lambda: Controller(size=1 << 20))
    repo.ddl("change", "ALTER TABLE supplier ALTER COLUMN s_nationkey TYPE bigint")
    repo.commit("change", "wider")
    repo.apply_merge(repo.create_merge("change")["id"])
    repo.apply_merge(repo.create_rewind(merges_back=2)["id"])
    return repo.table("supplier").select(*[F.col(c) for c in ("s_suppkey", "s_name", "s_nationkey")])


def migrate_with_writes(spark, d):
    """Rows written before a retype, between its expand and its sync, during its backfill, across its cutover, and after it; the two
    that were on their way while the table moved on were made for what it had been."""
    repo = Repo(spark, _scratch(spark), lambda: Controller(size=1 << 20))
    repo.init({"customer": f"{d}/customer.parquet"}, {"customer": ["c_custkey"]})
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    base = read(spark, d, "customer").select(*cols)
    repo.write("customer", base.where("c_custkey = 1").withColumn("c_nationkey", F.lit(77)))
    repo.create_branch("wide")
    repo.ddl("wide", "ALTER TABLE customer ALTER COLUMN c_nationkey TYPE text")
    repo.commit("wide", "text keys")
    n = repo.create_merge("wide")["id"]
    steps = {name: getattr(repo.runner, f"do_{name}") for name in ("expand", "sync", "backfill", "cutover")}

    def set_key(key: int, value: int) -> None:
        repo.write("customer", base.where(F.col("c_custkey") == key).withColumn("c_nationkey", F.lit(value)))

    def overtaken(name: str, key: int, value: int):
        """A write that has read the state before a step and is published after it."""
        def step(m, s):
            change = repo.store.change

            def late(edit, *args):
                repo.store.change = change
                steps[name](m, s)
                return change(edit, *args)

            repo.store.change = late
            set_key(key, value)

        return step

    def then(name: str, key: int, value: int):
        def step(m, s):
            steps[name](m, s)
            set_key(key, value)

        return step

    repo.runner.do_expand, repo.runner.do_backfill = then("expand", 4, 44), then("backfill", 2, 88)
    repo.runner.do_sync, repo.runner.do_cutover = overtaken("sync", 5, 55), overtaken("cutover", 6, 66)
    repo.apply_merge(n)
    repo.write("customer", repo.table("customer").where("c_custkey = 3").withColumn("c_nationkey", F.lit("99")))
    return repo.table("customer").select("c_custkey", "c_nationkey", "c_name")


def migrate_write_revert(spark, d):
    """Rows written after a merge have their former values when it is reverted: converted back, or from the row they replace."""
    repo = _migrated(spark, d, "ALTER TABLE customer ALTER COLUMN c_nationkey TYPE text; ALTER TABLE customer DROP COLUMN c_mktsegment; ALTER TABLE customer ADD COLUMN flag int DEFAULT 1", {"customer": "c_custkey"})
    rows = repo.table("customer")
    repo.write("customer", rows.where("c_custkey = 3").withColumn("c_nationkey", F.lit("9")).withColumn("flag", F.lit(7)))
    flags = repo.table("customer").groupBy("flag").count().collect()
    assert {(r.flag, r["count"]) for r in flags if r.flag == 7} == {(7, 1)}
    repo.revert_merge(1)
    return repo.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


def migrate_refused_revert(spark, d):
    """Rows without an exact former value: the revert is refused, and nothing changes."""
    out = []
    for what, ddl, value in (("text", "TYPE text", "many"), ("using", "TYPE bigint USING c_nationkey * 2", 5), ("exact", "TYPE bigint", 5)):
        repo = _migrated(spark, d, f"ALTER TABLE customer ALTER COLUMN c_nationkey {ddl}", {"customer": "c_custkey"})
        repo.write("customer", repo.table("customer").where("c_custkey = 3").withColumn("c_nationkey", F.lit(value)))
        try:
            repo.revert_merge(1)
        except MigrationError as e:
            out.append((what, str(e), repo.get_merge(1)["state"]))
        else:
            out.append((what, "", repo.get_merge(1)["state"]))
    return spark.createDataFrame(out, "what string, said string, state string")


def events_tail(spark, d):
    """Telemetry of a migration read as a stream into a table."""
    repo = _migrated(spark, d, "ALTER TABLE nation ALTER COLUMN n_regionkey TYPE text", {"nation": "n_nationkey"}, lambda: Controller(size=1 << 20))
    at = _scratch(spark)
    events.tail(repo.events.stream(1), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(events.SCHEMA).parquet(f"{at}/table").select("merge_id", "level", F.get_json_object("payload", "$.kind").alias("kind"), F.get_json_object("payload", "$.state").alias("state"))


def sync_stream(spark, d):
    """Purchases followed as a stream of changes: the last one of each user, with a derived column."""
    at, source = _scratch(spark), f"{_scratch(spark)}/changes"
    read(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "value").repartition(2, "user_id").write.parquet(source)
    stream = spark.readStream.schema("user_id long, event_id long, value double").parquet(source)
    sync.follow(stream, f"{at}/out", f"{at}/checkpoint", ["user_id"], ["event_id"], "large", F.col("value") > 100).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("user_id", "event_id", "value", "large")


_R = "(SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)"
_I = "(SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)"
_P99 = "SELECT b AS bucket, value FROM (SELECT b, value, row_number() OVER (PARTITION BY b ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY b) AS m FROM ({})) WHERE r = least(m - 1, CAST(floor(99 / 100.0 * m) AS BIGINT))"
ORACLES = {
    "latency_percentiles": "SELECT max(n) AS n, " + ", ".join(f"max(value) FILTER (WHERE r = least(n - 1, CAST(floor({p} / 100.0 * n) AS BIGINT))) AS p{p}" for p in (50, 95, 99)) + f", max(value) AS max FROM {_R}",
    "latency_sparkline": _P99.format(f"SELECT value, least(55, i * 56 // n) AS b FROM {_I}"),
    "latency_downsample": _P99.format(f"SELECT value, i // greatest(1, n // 120) AS b FROM {_I}"),
    "seed_violations": """SELECT what, CAST(x AS BIGINT) AS n FROM (VALUES ('merchants.website null', 2000 // 100), ('accounts.email null', 20000 // 97 - 20000 // 48500), ('accounts.email twice', 20000 // 1000 - 1), ('cards.fingerprint twice', 4000 // 400 - 1),
        ('txns.memo null', 10000 // 50), ('disputes.reason null', 5000 // 33)) v(what, x)""",
    "seed_accounts": """SELECT g AS id, 'Account ' || g AS name, CASE WHEN g % 500 = 0 THEN 'dupe_' || (g // 1000) || '@example.com' WHEN g % 97 <> 0 THEN 'user' || g || '@example.com' END AS email,
        ['US', 'GB', 'DE', 'FR', 'IN', 'BR', 'JP', 'CA'][g % 8 + 1] AS country FROM range(1, 3001) r(g)""",
    "migrate_retype": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice AS amount, o_orderstatus FROM orders",
    "migrate_and_revert": "SELECT p_partkey, p_size, p_type, p_brand FROM part",
    "migrate_rewind": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "migrate_with_writes": "SELECT c_custkey, CASE c_custkey WHEN 1 THEN '77' WHEN 2 THEN '88' WHEN 3 THEN '99' WHEN 4 THEN '44' WHEN 5 THEN '55' WHEN 6 THEN '66' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey, c_name FROM customer",
    "migrate_write_revert": "SELECT c_custkey, CASE c_custkey WHEN 3 THEN 9 ELSE c_nationkey END AS c_nationkey, c_mktsegment, c_acctbal FROM customer",
    "migrate_refused_revert": "SELECT * FROM (VALUES ('text', '1 rows of customer written since merge 1 have no exact former value', 'merged'), ('using', '1 rows of customer written since merge 1 have no exact former value', 'merged'), ('exact', '', 'reverted')) v(what, said, state)",
    "events_tail": """SELECT CAST(1 AS BIGINT) AS merge_id, 'info' AS level, kind, state FROM (VALUES ('expand', 'running'), ('expand', 'done'), ('sync', 'running'), ('sync', 'done'), ('backfill', 'running'), ('backfill', NULL), ('backfill', 'done'),
        ('cutover', 'running'), ('cutover', 'done'), (NULL, 'merged')) v(kind, state)""",
    "sync_stream": "SELECT user_id, event_id, value, value > 100 AS large FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
}
QUERIES = {name: globals()[name] for name in ORACLES}

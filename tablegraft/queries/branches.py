"""Queries through branches of the given tables: overlays, pages, sizes, and a migration's stages as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.types import from_spark
from ..ir import Column, SchemaIR, Table
from ..operators import backfill, overlay
from ..operators.diff import Op
from ..plans.ddl import apply_ops, parse_ddl
from ..sources.scratch import shared_dir
from ..streaming import sync


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table_of(name: str, df: DataFrame) -> Table:
    return Table(name, tuple(Column(f.name, from_spark(f.dataType), True, None, k) for k, f in enumerate(df.schema.fields, 1)))


def branch(spark: SparkSession, sf_dir: str, table: str, ddl: str = "") -> DataFrame:
    """A table as a branch sees it after some DDL."""
    rows = read(spark, sf_dir, table)
    parent = table_of(table, rows)
    return overlay.overlay(parse_ddl(ddl, SchemaIR((parent,)))[1].table(table), parent, rows)


def branch_identity(spark, d):
    return branch(spark, d, "customer")


def branch_add_null(spark, d):
    return branch(spark, d, "customer", "ALTER TABLE customer ADD COLUMN memo text")


def branch_add_default(spark, d):
    return branch(spark, d, "customer", "ALTER TABLE customer ADD COLUMN flag int DEFAULT 0, ADD COLUMN note text DEFAULT 'n/a'")


def branch_drop(spark, d):
    return branch(spark, d, "customer", "ALTER TABLE customer DROP COLUMN c_acctbal, DROP COLUMN c_mktsegment")


def branch_rename(spark, d):
    return branch(spark, d, "customer", "ALTER TABLE customer RENAME COLUMN c_name TO full_name; ALTER TABLE customer RENAME c_acctbal TO balance")


def branch_retype(spark, d):
    a = branch(spark, d, "orders", "ALTER TABLE orders ALTER COLUMN o_orderdate TYPE date; ALTER TABLE orders ALTER o_custkey TYPE text; ALTER TABLE orders ALTER o_orderpriority TYPE varchar(3)")
    return a.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority")


def branch_retype_using(spark, d):
    out = branch(spark, d, "part", "ALTER TABLE part ALTER COLUMN p_size TYPE bigint USING p_size * 10")
    return out.select("p_partkey", "p_size")


def branch_mixed_agg(spark, d):
    out = branch(
        spark, d, "orders",
        """ALTER TABLE orders RENAME COLUMN o_totalprice TO amount; ALTER TABLE orders ALTER COLUMN o_orderdate TYPE date;
        ALTER TABLE orders ADD COLUMN region text DEFAULT 'none', DROP COLUMN o_orderpriority""",
    )
    return out.groupBy("o_orderstatus", "region", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"))


def branch_point_lookup(spark, d):
    return branch(spark, d, "orders", "ALTER TABLE orders RENAME COLUMN o_totalprice TO amount; ALTER TABLE orders ALTER COLUMN o_custkey TYPE text").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "amount")


def branch_cross_table(spark, d):
    lines = branch(spark, d, "lineitem", "ALTER TABLE lineitem RENAME COLUMN l_quantity TO quantity, DROP COLUMN l_tax")
    orders = branch(spark, d, "orders", "ALTER TABLE orders RENAME COLUMN o_orderstatus TO status")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("quantity").cast("long")).alias("quantity"))


def branch_views_sql(spark, d):
    """The same through SQL over the branch's views."""
    branch(spark, d, "customer", "ALTER TABLE customer RENAME COLUMN c_mktsegment TO segment").createOrReplaceTempView("br_report__customer")
    read(spark, d, "nation").createOrReplaceTempView("br_report__nation")
    return spark.sql("SELECT n_name, segment, count(*) AS n FROM br_report__customer JOIN br_report__nation ON c_nationkey = n_nationkey GROUP BY n_name, segment")


def branch_own_table(spark, d):
    """A table that only the branch has: empty, with its schema."""
    ir = parse_ddl("CREATE TABLE notes (id bigint PRIMARY KEY, body text NOT NULL, size bigint DEFAULT 0)", SchemaIR())[1]
    return overlay.overlay(ir.table("notes"), Table("notes"), spark.createDataFrame([], "id long")).where("false")


def rows_page(spark, d):
    """A page of main's rows as the repository gives it, with the exact count of all."""
    out = repo_of(spark, d, {"orders": ["o_orderkey"]}).rows("orders")
    rows = [(r["o_orderkey"], r["o_orderstatus"], r["o_totalprice"], out["count"]) for r in out["rows"]]
    return spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, total long")


def table_stats(spark, d):
    out = repo_of(spark, d, dict.fromkeys(("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))).stats()
    return spark.createDataFrame([(t, x["rows"], x["bytes"] > 0, out["rows"]) for t, x in out["tables"].items()], "table_name string, n_rows long, stored boolean, total long")


def stats_after_writes(spark, d):
    """Sizes with rows replaced and added since: none is counted twice; a branch stores nothing."""
    repo = repo_of(spark, d, {"customer": ["c_custkey"]})
    rows = read(spark, d, "customer")
    repo.write("customer", rows.where("c_custkey < 100").withColumn("c_acctbal", F.lit(0.0)))
    repo.write("customer", rows.where("c_custkey >= 50").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    repo.create_branch("b")
    out = [("written", repo.stats()["rows"]), ("branch bytes", repo.stats("b")["bytes"])]
    repo.compact("customer")
    return spark.createDataFrame([*out, ("compacted", repo.stats()["rows"]), ("changes left", len(repo.store.state()["tables"]["customer"]["changes"]))], "what string, n long")


def repo_of(spark, d, keys: dict, control=None):
    """A repository over tables of the folder, as main."""
    from ..api import Repo

    repo = Repo(spark, f"{shared_dir(spark)}/repo-{uuid.uuid4().hex}", control)
    repo.init({n: f"{d}/{n}.parquet" for n in keys}, {n: k for n, k in keys.items() if k})
    return repo


def merged(spark, d, keys: dict, ddl: str, control=None):
    """The same after a branch's change has been merged."""
    repo = repo_of(spark, d, keys, control)
    repo.create_branch("change")
    repo.ddl("change", ddl)
    repo.commit("change", "change")
    repo.apply_merge(repo.create_merge("change")["id"])
    return repo


def table_bounds(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count("*").alias("n"))


def filtered_count(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").cast("long").alias("returned"), F.count_if(F.col("l_discount") > 0.05).cast("long").alias("discounted"))


def backfill_retype(spark, d):
    """A retype's shadow beside its source."""
    value = overlay.convert(F.col("p_retailprice"), "float8", "numeric(12,1)")
    return read(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size__new"), F.floor(F.col("p_retailprice")).cast("long").alias("whole"), (value >= 0).alias("fits"))


def backfill_batches(spark, d):
    """Rows by key range, as the backfill's jobs see them."""
    rows = read(spark, d, "lineitem")
    lo, hi, _ = backfill.bounds(rows, "l_orderkey")
    size = 1000
    return rows.groupBy(F.floor((F.col("l_orderkey") - lo) / size).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


def backfill_resume(spark, d):
    """A backfill that a cursor resumes half way: what it writes, and from where to where."""
    rows, path = read(spark, d, "orders").select("o_orderkey", "o_custkey"), f"{shared_dir(spark)}/resume-{uuid.uuid4().hex}"
    lo, hi, _ = backfill.bounds(rows, "o_orderkey")
    out = backfill.run(rows, "o_orderkey", "o_custkey__new", F.col("o_custkey").cast("string"), path, cursor=(lo + hi) // 2, a_range=10_000)
    done = spark.read.parquet(f"{path}/*").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count_if(F.col("o_custkey__new") == F.col("o_custkey").cast("string")).alias("filled"))
    return done.withColumn("cursor", F.lit(out["cursor"]).cast("long"))


def sync_race(spark, d):
    """Users' balances with a change log applied, last change wins, and the shadow that sync keeps."""
    log = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), "event_id")
    base = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    last = sync.latest(log, ["c_custkey"], ["event_id"]).join(base.select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "c_acctbal")
    return sync.synced(sync.apply(base, last, ["c_custkey"]), "negative", F.col("c_acctbal") < 0)


def expand_volatile_add(spark, d):
    """A volatile add: each row's value is made once and stays, rows written later bring their own."""
    repo = merged(spark, d, {"customer": ["c_custkey"]}, "ALTER TABLE customer ADD COLUMN token text NOT NULL DEFAULT md5(c_name)")
    rows = repo.table("customer").where("c_custkey % 10 = 0")
    repo.write("customer", rows.withColumn("token", F.concat(F.lit("synced-"), F.col("c_custkey"))))
    return repo.table("customer").select("c_custkey", "token")


def _cut_over(spark, d):
    rows = read(spark, d, "part")
    return rows.withColumn("p_size__old_1", F.col("p_size")).withColumn("p_size", F.col("p_size").cast("string"))


_RETYPE = "ALTER TABLE part ALTER COLUMN p_size TYPE text"


def cutover_projection(spark, d):
    """After a cutover both columns are stored: the new one under the name, the old one kept."""
    repo = merged(spark, d, {"part": ["p_partkey"]}, _RETYPE)
    t = repo.store.state()["tables"]["part"]
    stored = {c["name"]: c["physical"] for c in [*t["columns"], *t["kept"]]}
    return repo.store.rows(t).select(*[F.col(stored[c]).alias(c) for c in ("p_partkey", "p_size", "p_size__old_1")])


def contract_projection(spark, d):
    """A contract drops the old column from the files too; what is stored afterwards is read from them."""
    repo = merged(spark, d, {"part": ["p_partkey"]}, _RETYPE)
    before = repo.stats()["bytes"]
    repo.contract_merge(1)
    files = spark.read.parquet(*repo.store.state()["tables"]["part"]["files"])
    return repo.table("part").select("p_partkey", "p_size", F.lit(len(files.columns)).cast("long").alias("columns"), F.lit(0 < repo.stats()["bytes"] < before).alias("smaller"))


def revert_projection(spark, d):
    repo = merged(spark, d, {"part": ["p_partkey"]}, _RETYPE)
    repo.revert_merge(1)
    return repo.table("part").select("p_partkey", "p_size")


def remap_after_retype(spark, d):
    """A branch that keeps reading a column as it was before main retyped it."""
    rows = _cut_over(spark, d)
    old, new = table_of("part", read(spark, d, "part")), table_of("part", rows)
    mine, stale = overlay.remap(old, old, new)
    assert not stale
    return overlay.overlay(mine, new, rows).select("p_partkey", "p_size", "p_brand")


def set_operations(spark, d):
    """Names on either side, on both and on one only: union, intersect and except of two branches' columns."""
    left = parse_ddl("ALTER TABLE customer DROP COLUMN c_acctbal", SchemaIR((table_of("customer", read(spark, d, "customer")),)))[1].table("customer")
    right = apply_ops(SchemaIR((left,)), [Op("drop_column", "customer", "c_name"), Op("add_column", "customer", "memo", Column("memo", "text"))]).table("customer")
    a, b = (spark.createDataFrame([(c.name,) for c in t.columns], "name string") for t in (left, right))
    parts = (a.union(b).distinct(), "either"), (a.intersect(b), "both"), (a.exceptAll(b), "dropped"), (b.exceptAll(a), "added")
    out = None
    for df, what in parts:
        one = df.select(F.lit(what).alias("side"), "name")
        out = one if out is None else out.unionByName(one)
    return out


def latest_per_key(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return read(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_id", "event_type")


def top_segments(spark, d):
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("c_custkey").alias("newest")).orderBy(F.desc("n"), "c_mktsegment").limit(3)


_CUT = "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size"
ORACLES = {
    "branch_identity": "SELECT * FROM customer",
    "branch_add_null": "SELECT *, CAST(NULL AS VARCHAR) AS memo FROM customer",
    "branch_add_default": "SELECT *, 0 AS flag, 'n/a' AS note FROM customer",
    "branch_drop": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "branch_rename": "SELECT c_custkey, c_name AS full_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer",
    "branch_retype": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, left(o_orderpriority, 3) AS o_orderpriority FROM orders",
    "branch_retype_using": "SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS p_size FROM part",
    "branch_mixed_agg": "SELECT o_orderstatus, 'none' AS region, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1, 2, 3",
    "branch_point_lookup": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice AS amount FROM orders WHERE o_orderkey = 7",
    "branch_cross_table": "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "branch_views_sql": "SELECT n_name, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "branch_own_table": "SELECT CAST(0 AS BIGINT) AS id, '' AS body, CAST(0 AS BIGINT) AS size WHERE false",
    "rows_page": "SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 25",
    "table_stats": "SELECT *, true AS stored, CAST(sum(n_rows) OVER () AS BIGINT) AS total FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")) + ")",
    "stats_after_writes": """WITH n AS (SELECT count(*) + count(*) FILTER (WHERE c_custkey >= 50) AS n FROM customer)
        SELECT 'written' AS what, n FROM n UNION ALL SELECT 'branch bytes', 0 UNION ALL SELECT 'compacted', n FROM n UNION ALL SELECT 'changes left', 0""",
    "table_bounds": "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders",
    "filtered_count": "SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem",
    "backfill_retype": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size__new, CAST(floor(p_retailprice) AS BIGINT) AS whole, p_retailprice >= 0 AS fits FROM part",
    "backfill_batches": "SELECT CAST((l_orderkey - m) // 1000 AS BIGINT) AS batch, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem, (SELECT min(l_orderkey) AS m FROM lineitem) GROUP BY 1",
    "backfill_resume": "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS filled, max(o_orderkey) AS cursor FROM orders WHERE o_orderkey > (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 FROM orders)",
    "sync_race": """WITH last AS (SELECT user_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
        b AS (SELECT c_custkey, CASE WHEN user_id IS NULL THEN c_acctbal ELSE value END AS c_acctbal FROM customer LEFT JOIN last ON user_id = c_custkey)
        SELECT c_custkey, c_acctbal, c_acctbal < 0 AS negative FROM b""",
    "expand_volatile_add": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'synced-' || c_custkey ELSE md5(c_name) END AS token FROM customer",
    "cutover_projection": f"{_CUT}, p_size AS p_size__old_1 FROM part",
    "contract_projection": f"{_CUT}, CAST(6 AS BIGINT) AS columns, true AS smaller FROM part",
    "revert_projection": "SELECT p_partkey, p_size FROM part",
    "remap_after_retype": "SELECT p_partkey, p_size, p_brand FROM part",
    "set_operations": """WITH a(name) AS (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_mktsegment')), b(name) AS (VALUES ('c_custkey'), ('c_nationkey'), ('c_mktsegment'), ('memo'))
        SELECT 'either' AS side, name FROM (SELECT name FROM a UNION SELECT name FROM b) UNION ALL SELECT 'both', name FROM (SELECT name FROM a INTERSECT SELECT name FROM b)
        UNION ALL SELECT 'dropped', name FROM (SELECT name FROM a EXCEPT SELECT name FROM b) UNION ALL SELECT 'added', name FROM (SELECT name FROM b EXCEPT SELECT name FROM a)""",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "top_segments": "SELECT c_mktsegment, count(*) AS n, max(c_custkey) AS newest FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3",
}
QUERIES = {name: globals()[name] for name in ORACLES}

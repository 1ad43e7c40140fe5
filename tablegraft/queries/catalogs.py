"""Metadata queries in the shapes that a schema service asks its catalog: ordered aggregates, JSON arrays, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ir import paths
from ..operators import lineage, probes
from ..sources import catalog
from .branches import read, repo_of
from .schemas import BASE, THEIRS_DDL, _state


def constraint_columns(spark, d):
    """main's keys put together again in declared order from one row a column."""
    repo = repo_of(spark, d, {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "nation": ["n_nationkey"], "region": None})
    repo.create_branch("keys")
    repo.ddl("keys", "ALTER TABLE nation ADD CONSTRAINT fk FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey), ADD CONSTRAINT u UNIQUE (n_regionkey, n_name); CREATE INDEX i ON lineitem (l_suppkey, l_orderkey)")
    return catalog.keys(catalog.key_rows(spark, repo.schema("keys")))


def catalog_counts(spark, d):
    """Objects of a state by table and kind."""
    rows = [(p.split(".")[0], kind) for p, (kind, _) in paths(_state(THEIRS_DDL)).items()]
    return spark.createDataFrame(rows, "tbl string, kind string").groupBy("tbl", "kind").agg(F.count("*").alias("n"))


def name_sets(spark, d):
    """Paths of both states, with the side that has them."""
    a, b = (spark.createDataFrame([(p,) for p in paths(x)], "path string") for x in (BASE, _state(THEIRS_DDL)))
    out = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "path", "full_outer")
    return out.select("path", F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))


def json_array_counts(spark, d):
    """Commits by how many seed tables their JSON lists."""
    repo = repo_of(spark, d, {"nation": ["n_nationkey"], "region": ["r_regionkey"]})
    repo.create_branch("b")
    for name, ddl in (("drop", "DROP TABLE region"), ("create", "CREATE TABLE notes (id bigint PRIMARY KEY); CREATE TABLE more (id bigint)")):
        repo.ddl("b", ddl)
        repo.commit("b", name)
    return repo.commits().select("message", F.size("tables").cast("long").alias("n"), lineage.seeded("tables", ["nation", "region"]).cast("long").alias("seeded"))


def json_extract(spark, d):
    return read(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count("*").alias("n"))


def branch_order(spark, d):
    """main first, then by age; ranks stand in for the order."""
    repo = repo_of(spark, d, {"region": None})
    for name in ("zeta", "alpha", "beta"):
        repo.create_branch(name)
    repo.delete_branch("alpha")
    return spark.createDataFrame([(b["name"], k) for k, b in enumerate(repo.branches(), 1)], "name string, nth long")


def like_wildcard(spark, d):
    """A CHECK with LIKE, in which an underscore is any character: the rows that fail it."""
    return read(spark, d, "part").where(probes.fails_check("p_name LIKE '%e_ %' AND NOT p_brand ~ '1$'")).select("p_partkey", "p_name", "p_brand")


def missing_in_list(spark, d):
    """Customers that no order names, and those of given keys."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    none = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("without orders").alias("what"), "n")
    some = c.where(F.col("c_custkey").isin(1, 5, 9, -3)).agg(F.count("*").alias("n")).select(F.lit("of the list").alias("what"), "n")
    with_ = c.join(o, c.c_custkey == o.o_custkey, "left_semi").agg(F.count("*").alias("n")).select(F.lit("with orders").alias("what"), "n")
    return none.unionByName(some).unionByName(with_)


def grouped_max_depth(spark, d):
    """Parts as views that read two others: part k reads k / 2 and k / 3. The greatest depth by which each of the first is reached."""
    k = F.col("p_partkey")
    parts = read(spark, d, "region").select(F.col("r_regionkey").cast("long")).agg(F.max("r_regionkey").alias("most")).select(F.explode(F.sequence(F.lit(1), F.col("most") * 8)).alias("p_partkey"))
    on = F.array_distinct(F.array((k / 2).cast("long").cast("string"), (k / 3).cast("long").cast("string")))
    edges = parts.select(k.cast("string").alias("dependent"), F.explode(on).alias("on"))
    return lineage.dependents(edges, "0").select("name", F.col("depth").cast("long").alias("deepest"))


def distinct_values(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def scalar_functions(spark, d):
    """Text, hash, null, number and date functions that the engine's generated expressions use."""
    df = read(spark, d, "customer")
    return df.select(
        "c_custkey", F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0").alias("last4"), F.sha2(F.col("c_name").cast("binary"), 256).alias("sha"), F.md5(F.col("c_name").cast("binary")).alias("md5"),
        F.greatest(F.col("c_custkey"), F.lit(10)).alias("at_least"), F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("none")).alias("name"), F.levenshtein("c_name", F.lit("Customer")).cast("long").alias("far"),
        F.expr("c_custkey div 7").alias("seventh"), F.replace(F.col("c_name"), F.lit("#"), F.lit("")).alias("plain"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("pick"),
        (~F.col("c_mktsegment").eqNullSafe(F.lit("BUILDING"))).alias("differs"),
    )


ORACLES = {
    "constraint_columns": """SELECT tbl, kind, name, string_agg(col, ',' ORDER BY ord) AS columns, count(*) AS n FROM (VALUES ('lineitem', 'primary', 'lineitem_pkey', 2, 'l_linenumber'), ('lineitem', 'primary', 'lineitem_pkey', 1, 'l_orderkey'),
        ('lineitem', 'primary', 'lineitem_pkey', 3, 'l_partkey'), ('nation', 'primary', 'nation_pkey', 1, 'n_nationkey'), ('nation', 'foreign', 'fk', 1, 'n_regionkey'), ('nation', 'unique', 'u', 2, 'n_name'), ('nation', 'unique', 'u', 1, 'n_regionkey'),
        ('lineitem', 'index', 'i', 1, 'l_suppkey'), ('lineitem', 'index', 'i', 2, 'l_orderkey')) v(tbl, kind, name, ord, col) GROUP BY tbl, kind, name""",
    "catalog_counts": "SELECT tbl, kind, CAST(n AS BIGINT) AS n FROM (VALUES ('accounts', 'table', 1), ('accounts', 'column', 2), ('tags', 'table', 1), ('tags', 'column', 1), ('tags', 'constraint', 1), ('txns', 'table', 1), ('txns', 'column', 3), ('txns', 'constraint', 1)) v(tbl, kind, n)",
    "name_sets": """WITH a(path) AS (VALUES ('accounts'), ('accounts.email'), ('accounts.id'), ('txns'), ('txns.amount_cents'), ('txns.constraint.txns_pkey'), ('txns.id'), ('txns.index.txns_memo_idx'), ('txns.memo')),
        b(path) AS (SELECT path FROM a WHERE path NOT LIKE '%index%' UNION SELECT * FROM (VALUES ('tags'), ('tags.constraint.tags_pkey'), ('tags.id')) t(path))
        SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'right' WHEN b.path IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.path = b.path""",
    "json_array_counts": "SELECT message, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS seeded FROM (VALUES ('seeded catalog', 2, 2), ('drop', 1, 1), ('create', 3, 1)) v(message, n, s)",
    "json_extract": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "branch_order": "SELECT name, CAST(nth AS BIGINT) AS nth FROM (VALUES ('main', 1), ('zeta', 2), ('beta', 3)) v(name, nth)",
    "like_wildcard": "SELECT p_partkey, p_name, p_brand FROM part WHERE NOT (p_name LIKE '%e_ %' AND NOT regexp_matches(p_brand, '1$'))",
    "missing_in_list": """SELECT 'without orders' AS what, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
        UNION ALL SELECT 'of the list', count(*) FROM customer WHERE c_custkey IN (1, 5, 9, -3) UNION ALL SELECT 'with orders', count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "grouped_max_depth": """WITH RECURSIVE k AS (SELECT unnest(range(1, 8 * m + 1)) AS k FROM (SELECT CAST(max(r_regionkey) AS BIGINT) AS m FROM region)), e AS (SELECT DISTINCT k, o FROM (SELECT k, k // 2 AS o FROM k UNION ALL SELECT k, k // 3 FROM k)),
        w(k, depth) AS (SELECT k, 1 FROM e WHERE o = 0 UNION SELECT e.k, w.depth + 1 FROM w JOIN e ON e.o = w.k)
        SELECT CAST(k AS VARCHAR) AS name, CAST(max(depth) AS BIGINT) AS deepest FROM w GROUP BY k""",
    "distinct_values": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "scalar_functions": """SELECT c_custkey, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS last4, sha256(c_name) AS sha, md5(c_name) AS md5, greatest(c_custkey, 10) AS at_least,
        coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'none') AS name, CAST(levenshtein(c_name, 'Customer') AS BIGINT) AS far, c_custkey // 7 AS seventh, replace(c_name, '#', '') AS plain,
        ['a', 'b', 'c'][c_custkey % 3 + 1] AS pick, c_mktsegment IS DISTINCT FROM 'BUILDING' AS differs FROM customer""",
}
QUERIES = {name: globals()[name] for name in ORACLES}

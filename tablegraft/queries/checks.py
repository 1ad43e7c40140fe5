"""Violation probes over the given tables, one query each, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Constraint
from ..operators import probes
from ..operators.diff import Op
from .branches import read


def _orders(spark, d) -> DataFrame:
    """orders with a memo that every 50th row lacks."""
    return read(spark, d, "orders").withColumn("memo", F.when(F.col("o_orderkey") % 50 != 0, F.concat(F.lit("memo "), F.col("o_orderkey"))))


def _count(df: DataFrame, condition) -> DataFrame:
    return probes.fused(df, {"bad": condition})


def probe_not_null(spark, d):
    return _count(_orders(spark, d), probes.not_null("memo"))


def probe_unique_count(spark, d):
    return probes.duplicate_keys(read(spark, d, "part"), ["p_name"]).agg(F.count("*").alias("dup_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("dup_rows"))


def probe_unique_samples(spark, d):
    return probes.duplicate_keys(read(spark, d, "part"), ["p_name"]).orderBy("p_name").limit(10)


def probe_unique_composite(spark, d):
    return probes.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def probe_unique_ignores_null(spark, d):
    df = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.floor(F.col("c_custkey") / 2)).alias("k"))
    return probes.duplicate_keys(df, ["k"]).agg(F.count("*").alias("dup_keys"))


def probe_check(spark, d):
    return _count(read(spark, d, "customer"), probes.fails_check("c_acctbal >= 0"))


def probe_check_null(spark, d):
    return _count(_orders(spark, d), probes.fails_check("memo <> 'memo 7'"))


def probe_varchar_len(spark, d):
    df = read(spark, d, "orders")
    return _count(df, probes.too_long(df, "o_orderpriority", 10))


def probe_cast_int(spark, d):
    df = read(spark, d, "part")
    return _count(df, probes.not_castable(df, "p_brand", "int4"))


def probe_cast_numeric(spark, d):
    df = read(spark, d, "events")
    return _count(df, probes.not_castable(df, "props", "numeric"))


def probe_cast_double_to_int(spark, d):
    """Doubles by their plain decimal text: whole ones pass."""
    df = read(spark, d, "lineitem")
    return _count(df, probes.not_castable(df, "l_quantity", "int8"))


def probe_cast_bool(spark, d):
    df = read(spark, d, "lineitem").withColumn("flag", F.when(F.col("l_linenumber") % 3 == 0, "true").when(F.col("l_linenumber") % 3 == 1, "f").otherwise("maybe"))
    return _count(df, probes.not_castable(df, "flag", "bool"))


def probe_cast_uuid(spark, d):
    h = F.md5(F.col("c_name").cast("binary"))
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    df = read(spark, d, "customer").withColumn("u", F.when(F.col("c_custkey") % 4 == 0, h).otherwise(parts))
    return _count(df, probes.not_castable(df, "u", "uuid"))


def probe_cast_date(spark, d):
    df = read(spark, d, "orders").withColumn("t", F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return _count(df, probes.not_castable(df, "t", "date"))


def probe_overflow(spark, d):
    df = read(spark, d, "orders").withColumn("t", (F.col("o_orderkey") * 1_000_000).cast("string"))
    return _count(df, probes.overflows(df, "t", "int4"))


def probe_fk_orphans(spark, d):
    child = read(spark, d, "lineitem").withColumn("k", F.when(F.col("l_partkey") % 100 == 0, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")))
    return probes.orphans(child, ["k"], read(spark, d, "part"), ["p_partkey"]).agg(F.count("*").alias("bad"))


def probe_fused(spark, d):
    """Six probes of one table in one scan."""
    df = _orders(spark, d)
    return probes.fused(df, {
        "null_memo": probes.not_null("memo"), "long_priority": probes.too_long(df, "o_orderpriority", 10), "bad_check": probes.fails_check("o_totalprice > 1000"),
        "not_int": probes.not_castable(df, "o_orderpriority", "int4"), "not_bool": probes.not_castable(df, "o_orderstatus", "bool"), "not_date": probes.not_castable(df, "memo", "date"),
    })


def probe_samples(spark, d):
    df = read(spark, d, "orders")
    return df.where(probes.too_long(df, "o_orderpriority", 10)).select(F.col("o_orderpriority").alias("value"), "o_orderkey").orderBy("value", "o_orderkey").limit(10)


def backfill_eta(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n")).select("n", probes.eta_column(F.col("n")).alias("message"))


def validate_report(spark, d):
    frames = {"orders": _orders(spark, d), "customer": read(spark, d, "customer"), "part": read(spark, d, "part")}
    ops = [
        Op("set_nullable", "orders", "memo", False), Op("retype_column", "orders", "o_orderpriority", "pg_catalog.varchar(10)", old="pg_catalog.text"),
        Op("add_constraint", "customer", "positive", Constraint("positive", "check", (), "c_acctbal >= 0")), Op("add_constraint", "part", "names", Constraint("names", "unique", ("p_name",))),
        Op("retype_column", "part", "p_size", "pg_catalog.int8", old="pg_catalog.int4"), Op("retype_column", "nowhere", "x", "pg_catalog.int8", old="pg_catalog.int4"),
    ]
    found = probes.validate(ops, frames.get)
    return spark.createDataFrame([(k, f.op.kind, f.op.table, f.op.target, f.blocked, -1 if f.count is None else f.count, f.message) for k, f in enumerate(found)], "seq long, kind string, tbl string, target string, blocked boolean, n long, message string")


_MEMO = "(SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN 'memo ' || o_orderkey END AS memo FROM orders)"
_ETA = "'backfill ≈ ' || (s // 60) || ' m ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' s, lock window ≈ 12 ms'"


def _bad(source: str, condition: str) -> str:
    return f"SELECT count(*) AS rows, count(*) FILTER (WHERE {condition}) AS bad FROM {source}"


_SAYS = "CASE WHEN n > 0 THEN 'blocked: ' || format('{{:,}}', n) || ' {}' ELSE '{}' END"
ORACLES = {
    "probe_not_null": _bad(_MEMO, "memo IS NULL"),
    "probe_unique_count": "SELECT count(*) AS dup_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS dup_rows FROM (SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1)",
    "probe_unique_samples": "SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 10",
    "probe_unique_composite": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "probe_unique_ignores_null": "SELECT count(*) AS dup_keys FROM (SELECT c_custkey // 2 AS k FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1 HAVING count(*) > 1)",
    "probe_check": _bad("customer", "NOT (c_acctbal >= 0)"),
    "probe_check_null": _bad(_MEMO, "NOT (memo <> 'memo 7')"),
    "probe_varchar_len": _bad("orders", "length(o_orderpriority) > 10"),
    "probe_cast_int": _bad("part", "NOT regexp_matches(p_brand, '^-?[0-9]+$')"),
    "probe_cast_numeric": _bad("events", "props IS NOT NULL AND NOT regexp_matches(props, '^-?[0-9]+(\\.[0-9]+)?$')"),
    "probe_cast_double_to_int": _bad("lineitem", "l_quantity <> floor(l_quantity)"),
    "probe_cast_bool": _bad("lineitem", "l_linenumber % 3 = 2"),
    "probe_cast_uuid": _bad("customer", "c_custkey % 4 = 0"),
    "probe_cast_date": _bad("orders", "o_orderkey % 5 = 0"),
    "probe_overflow": _bad("orders", "o_orderkey * 1000000 > 2147483647"),
    "probe_fk_orphans": "SELECT count(*) AS bad FROM (SELECT CASE WHEN l_partkey % 100 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS k FROM lineitem) c WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = k)",
    "probe_fused": f"""SELECT count(*) AS rows, count(*) FILTER (WHERE memo IS NULL) AS null_memo, count(*) FILTER (WHERE length(o_orderpriority) > 10) AS long_priority,
        count(*) FILTER (WHERE NOT (o_totalprice > 1000)) AS bad_check, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^-?[0-9]+$')) AS not_int,
        count(*) FILTER (WHERE NOT regexp_matches(o_orderstatus, '^(t|f|true|false|0|1)$')) AS not_bool, count(*) FILTER (WHERE memo IS NOT NULL) AS not_date FROM {_MEMO}""",
    "probe_samples": "SELECT o_orderpriority AS value, o_orderkey FROM orders WHERE length(o_orderpriority) > 10 ORDER BY 1, 2 LIMIT 10",
    "backfill_eta": f"SELECT n, {_ETA} AS message FROM (SELECT count(*) AS n, CAST(floor(count(*) / 136000.0 + 0.5) AS BIGINT) AS s FROM lineitem)",
    "validate_report": f"""WITH c AS (
        SELECT 0 AS seq, 'set_nullable' AS kind, 'orders' AS tbl, 'memo' AS target, count(*) FILTER (WHERE memo IS NULL) AS n, 'nn' AS how, 0 AS s FROM {_MEMO}
        UNION ALL SELECT 1, 'retype_column', 'orders', 'o_orderpriority', count(*) FILTER (WHERE length(o_orderpriority) > 10), 'len', 0 FROM orders
        UNION ALL SELECT 2, 'retype_column', 'orders', 'o_orderpriority', NULL, 'eta', CAST(floor(count(*) / 136000.0 + 0.5) AS BIGINT) FROM orders
        UNION ALL SELECT 3, 'add_constraint', 'customer', 'positive', count(*) FILTER (WHERE NOT c_acctbal >= 0), 'chk', 0 FROM customer
        UNION ALL SELECT 4, 'add_constraint', 'part', 'names', count(*), 'uni', 0 FROM (SELECT 1 FROM part GROUP BY p_name HAVING count(*) > 1)
        UNION ALL SELECT 5, 'retype_column', 'part', 'p_size', count(*) FILTER (WHERE NOT regexp_matches(CAST(p_size AS VARCHAR), '^-?[0-9]+$')), 'cast', 0 FROM part
        UNION ALL SELECT 6, 'retype_column', 'part', 'p_size', NULL, 'eta', CAST(floor(count(*) / 136000.0 + 0.5) AS BIGINT) FROM part
        UNION ALL SELECT 7, 'retype_column', 'nowhere', 'x', NULL, 'eta', 0)
        SELECT CAST(seq AS BIGINT) AS seq, kind, tbl, target, coalesce(n, 0) > 0 AS blocked, coalesce(n, -1) AS n, CASE how
            WHEN 'nn' THEN {_SAYS.format("rows violate this", "no NULL rows")} WHEN 'len' THEN {_SAYS.format("rows exceed varchar(10)", "all values fit the new type")}
            WHEN 'chk' THEN {_SAYS.format("rows violate this", "check holds for all rows")} WHEN 'uni' THEN {_SAYS.format("duplicate keys", "values are unique")}
            WHEN 'cast' THEN {_SAYS.format("rows are not castable", "all sampled values are castable")} ELSE {_ETA} END AS message FROM c""",
}
QUERIES = {name: globals()[name] for name in ORACLES}

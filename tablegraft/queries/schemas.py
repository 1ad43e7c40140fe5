"""Queries over schema states and histories: diffs, merges, renames, hashes, ancestors, dependents. Their inputs are small
fixtures, given in SQL on the other side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import canonicalize, is_coercible
from ..ir import Column, Constraint, Index, SchemaIR, Table, canonical_json, catalog_rows, hash_ir
from ..operators import lineage
from ..operators.diff import Op, classify, diff, diff_rows, is_volatile, rename_rows, suggest_renames
from ..operators.merge import merge, merge_rows
from ..operators.overlay import select_list
from ..plans.compile import compile_plan
from ..plans.ddl import apply_ops, parse_ddl

INT8, TEXT = "pg_catalog.int8", "pg_catalog.text"
TXNS = Table(
    "txns", (Column("id", INT8, False, None, 1), Column("amount_cents", INT8, False, None, 2), Column("memo", TEXT, True, None, 3)),
    (Constraint("txns_pkey", "primary", ("id",)),), (Index("txns_memo_idx", ("memo",)),),
)
BASE = SchemaIR((TXNS, Table("accounts", (Column("id", INT8, False), Column("email", TEXT, True, None, 2)))))
OURS_DDL = "ALTER TABLE txns ADD COLUMN note text; ALTER TABLE accounts ALTER COLUMN email SET NOT NULL"
THEIRS_DDL = "ALTER TABLE txns ALTER COLUMN amount_cents TYPE numeric(12,2); DROP INDEX txns_memo_idx; ALTER TABLE accounts ALTER COLUMN email SET NOT NULL; CREATE TABLE tags (id bigint PRIMARY KEY)"
CLASH_DDL = "ALTER TABLE txns ALTER COLUMN amount_cents TYPE text; ALTER TABLE accounts ALTER COLUMN email TYPE varchar(80)"


def _state(ddl: str) -> SchemaIR:
    return parse_ddl(ddl, BASE)[1]


def schema_diff(spark, d):
    """(path, kind, change) by a full outer join of catalog rows."""
    return diff_rows(catalog_rows(spark, BASE), catalog_rows(spark, _state(THEIRS_DDL)))


def schema_diff_ops(spark, d):
    """The same as operations in order, with their risk."""
    ops = diff(BASE, _state(THEIRS_DDL + "; ALTER TABLE txns RENAME COLUMN memo TO note, ALTER COLUMN note SET DEFAULT 'x'"))
    return spark.createDataFrame([(k, op.kind, op.table, op.target, classify(op)) for k, op in enumerate(ops)], "seq long, kind string, tbl string, target string, risk string")


def risk_classes(spark, d):
    col = lambda default: Column("c", TEXT, True, default)
    c, i = Constraint("u", "unique", ("c",)), Index("i", ("c",))
    ops = [
        Op("create_table", "t", "t", TXNS), Op("drop_table", "t", "t"), Op("add_column", "t", "c", col("'now()'")), Op("add_column", "t", "c", col("now()")), Op("add_column", "t", "c", col("CURRENT_DATE")),
        Op("drop_column", "t", "c"), Op("rename_column", "t", "c", "x"), Op("retype_column", "t", "c", TEXT, old="pg_catalog.varchar(5)"), Op("retype_column", "t", "c", INT8, old="pg_catalog.int4"),
        Op("set_nullable", "t", "c", True), Op("set_nullable", "t", "c", False), Op("set_default", "t", "c", "1"), Op("add_constraint", "t", "u", c), Op("drop_constraint", "t", "u"), Op("add_index", "t", "i", i), Op("drop_index", "t", "i"),
    ]
    return spark.createDataFrame([(k, op.kind, classify(op)) for k, op in enumerate(ops)], "seq long, kind string, risk string")


def volatile_defaults(spark, d):
    texts = ["0", "'random()'", "now()", "gen_random_uuid()", "CAST(1 AS text)", "CURRENT_TIMESTAMP", "'a'::character varying", "$$now()$$", "nextval('s')", "'it''s now()'", "user_id", "CURRENT_USER"]
    return spark.createDataFrame([(t, is_volatile(t)) for t in texts], "expr string, is_volatile boolean")


def three_way_merge(spark, d):
    a, b, c = (catalog_rows(spark, x) for x in (BASE, _state(OURS_DDL), _state(THEIRS_DDL)))
    return merge_rows(a, b, c).select("path", "kind", "result", F.col("payload").isNotNull().alias("kept"))


def merge_ops(spark, d):
    """What a clean merge adds to ours."""
    out = merge(BASE, _state(OURS_DDL), _state(THEIRS_DDL))
    return spark.createDataFrame([(k, op.kind, op.table, op.target) for k, op in enumerate(out.ops)], "seq long, kind string, tbl string, target string")


def merge_conflicts(spark, d):
    found = merge(BASE, _state(THEIRS_DDL), _state(CLASH_DDL)).conflicts
    rows = [(c.path, (c.base or {}).get("type"), (c.ours or {}).get("type"), (c.theirs or {}).get("type"), c.reason) for c in found]
    return spark.createDataFrame(rows, "path string, base_type string, ours_type string, theirs_type string, reason string")


_DROPPED = [("txns", "amount_cents", INT8, False), ("txns", "email", TEXT, True), ("txns", "memo", TEXT, True), ("txns", "total", INT8, True)]
_ADDED = [("txns", "amount", INT8, False), ("txns", "emails", TEXT, True), ("txns", "notes", TEXT, True), ("txns", "totals", TEXT, True)]


def rename_suggestions(spark, d):
    schema = "table string, name string, type string, nullable boolean"
    return rename_rows(spark.createDataFrame(_DROPPED, schema), spark.createDataFrame(_ADDED, schema)).withColumnRenamed("table", "tbl")


def rename_greedy(spark, d):
    """Candidates with each side used once, best first."""
    def table(rows):
        return SchemaIR((Table("t", tuple(Column(n, TEXT, True, None, k) for k, n in enumerate(rows, 1))),))

    old, new = table(["colour", "color", "status_code"]), table(["colours", "status_text", "kolor"])
    found = suggest_renames([Op("drop_column", "t", c.name) for c in old.tables[0].columns] + [Op("add_column", "t", c.name, c) for c in new.tables[0].columns], old)
    return spark.createDataFrame([(r.old, r.new, r.score, r.reason) for r in found], "old string, new string, score long, reason string")


def canonical_hash(spark, d):
    """Commit ids of some states, in the engine and in SQL over their canonical text."""
    states = {"empty": SchemaIR(), "base": BASE, "theirs": _state(THEIRS_DDL)}
    df = spark.createDataFrame([(k, canonical_json(v), hash_ir(v)) for k, v in states.items()], "name string, canonical string, id string")
    return df.select("name", F.sha2(F.col("canonical").cast("binary"), 256).alias("id"), (F.sha2(F.col("canonical").cast("binary"), 256) == F.col("id")).alias("same"))


_SPELLINGS = ["bigint", "INT", "serial", "double precision", "character varying(20)", "VARCHAR", "char(3)", "decimal(10,2)", "numeric", "timestamp with time zone", "timestamp(3) without time zone", "bool", "text[]", "int4(11)", "MyType", "json"]


def type_canon(spark, d):
    return spark.createDataFrame([(s, canonicalize(s)) for s in _SPELLINGS], "spelling string, canonical string")


_PAIRS = [("varchar(5)", "text"), ("char(5)", "text"), ("varchar(5)", "varchar(9)"), ("varchar(9)", "varchar(5)"), ("varchar(5)", "varchar"), ("varchar", "varchar(5)"), ("numeric(5,2)", "numeric"), ("int", "bigint"), ("int", "int4"), ("text[]", "text"), ("varchar(3)[]", "text[]")]


def coercible(spark, d):
    return spark.createDataFrame([(a, b, is_coercible(a, b)) for a, b in _PAIRS], "old_type string, new_type string, free boolean")


def ddl_round(spark, d):
    """The state after a script, column by column."""
    ir = parse_ddl(
        """CREATE TABLE accounts2 (id bigserial PRIMARY KEY, email varchar(80) UNIQUE, age int CHECK (age >= 0), "Odd Name" text DEFAULT 'x', txn bigint REFERENCES txns (id));
        ALTER TABLE accounts2 RENAME COLUMN age TO years; ALTER TABLE accounts2 ALTER years SET NOT NULL; CREATE UNIQUE INDEX ON accounts2 (email) WHERE years > 3;
        ALTER TABLE txns DROP COLUMN memo""",
        BASE,
    )[1]
    rows = [(t.name, "column", c.name, c.type, str(c.nullable).lower(), c.default) for t in ir.tables for c in t.columns]
    rows += [(t.name, c.kind, c.name, ",".join(c.columns), None, c.expression) for t in ir.tables for c in t.constraints]
    rows += [(t.name, "index", i.name, ",".join(i.columns), str(i.unique).lower(), i.predicate) for t in ir.tables for i in t.indexes]
    return spark.createDataFrame(rows, "tbl string, kind string, name string, detail string, flag string, expr string")


def overlay_list(spark, d):
    """How each column of a branch is made."""
    own = parse_ddl("ALTER TABLE txns RENAME memo TO note; ALTER TABLE txns ALTER amount_cents TYPE text; ALTER TABLE txns ADD COLUMN kind text DEFAULT 'card', ADD COLUMN gone varchar(9)", BASE)[1].table("txns")
    df = spark.createDataFrame([(1, 250, "a"), (2, 300, None)], "id long, amount_cents long, memo string")
    return df.select(*select_list(own, TXNS))


def plan_steps(spark, d):
    """A plan's steps in order."""
    ops = parse_ddl("ALTER TABLE txns ALTER amount_cents TYPE numeric(12,2); ALTER TABLE txns ADD COLUMN token text DEFAULT gen_random_uuid(); ALTER TABLE txns ALTER memo SET NOT NULL; DROP TABLE accounts", BASE)[0]
    rows = [(s.seq, s.kind, s.do, s.table, s.risk, s.manual) for s in compile_plan(ops, BASE, 7)]
    return spark.createDataFrame(rows, "seq long, kind string, action string, tbl string, risk string, manual boolean")


_COMMITS = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("f", "b"), ("g", "f"), ("x", None), ("y", "x"), ("p", "q"), ("q", "p"), ("o", "missing")]
_C = "(VALUES ('a', NULL), ('b', 'a'), ('c', 'b'), ('d', 'c'), ('f', 'b'), ('g', 'f'), ('x', NULL), ('y', 'x'), ('p', 'q'), ('q', 'p'), ('o', 'missing')) AS c(id, parent)"


def _commits(spark):
    return spark.createDataFrame(_COMMITS, "id string, parent string")


def ancestors(spark, d):
    out = None
    for head in ("d", "g", "p", "o"):
        one = lineage.ancestors(_commits(spark), head).select(F.lit(head).alias("head"), "id", F.col("depth").cast("long").alias("depth"))
        out = one if out is None else out.unionByName(one)
    return out


def lca(spark, d):
    out = None
    for a, b in (("d", "g"), ("c", "d"), ("d", "d"), ("d", "y")):
        one = lineage.common_ancestor(_commits(spark), a, b).select(F.lit(a).alias("l"), F.lit(b).alias("r"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def rewind_undone(spark, d):
    target, undone = lineage.rewind_target(dict(_COMMITS), "d", merges_back=2)
    return spark.createDataFrame([(k, c, target) for k, c in enumerate(undone)], "nth long, undone string, target string")


def ancestors_by_order(spark, d):
    """Order keys as commits: each one's parent is half of it; ancestors of the greatest."""
    from .branches import read

    rows = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 2).cast("string")).alias("parent"))
    head = read(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return lineage.ancestors(rows, str(head)).select("id", F.col("depth").cast("long").alias("depth"))


_EDGES = [("v1", "t"), ("v2", "t"), ("v3", "v1"), ("v3", "v2"), ("v4", "v3"), ("v4", "t"), ("w", "u")]


def view_dependents(spark, d):
    return lineage.dependents(spark.createDataFrame(_EDGES, "dependent string, `on` string"), "t").withColumn("depth", F.col("depth").cast("long"))


def prune_history(spark, d):
    return lineage.prunable(_commits(spark), "g")


def leftover_shadows(spark, d):
    """Columns that merges keep in main, but for those that a state names."""
    from .branches import merged

    repo = merged(spark, d, {"nation": ["n_nationkey"], "region": ["r_regionkey"]}, "ALTER TABLE nation ALTER n_regionkey TYPE text; ALTER TABLE nation DROP COLUMN n_name; ALTER TABLE region ALTER r_name TYPE varchar(3)")
    keep = SchemaIR((Table("nation", (Column("n_name__old_1", TEXT),)),))
    return spark.createDataFrame([(t, c) for t, cols in repo.leftovers(keep).items() for c in cols], "tbl string, col string")


def closed_merges(spark, d):
    """Merges whose kept columns are all gone can't be reverted any more; a rewind that drops one's closes it."""
    from .branches import merged

    repo = merged(spark, d, {"nation": ["n_nationkey"], "region": ["r_regionkey"]}, "ALTER TABLE nation ALTER n_regionkey TYPE text")
    repo.ddl("change", "ALTER TABLE region RENAME r_name TO name")
    repo.commit("change", "rename")
    repo.apply_merge(repo.create_merge("change")["id"])
    repo.apply_merge(repo.create_rewind(merges_back=2)["id"])
    return spark.createDataFrame([(m["id"], m["kind"], m["state"]) for m in repo.store.state()["merges"].values()], "id long, kind string, state string")


def seed_commit(spark, d):
    rows = [("c1", "init", 1.0, ["accounts"]), ("c2", "seeded catalog", 2.0, ["accounts", "txns"]), ("c3", "more", 3.0, ["accounts", "txns", "cards"]), ("c4", "seeded catalog", 4.0, ["accounts"])]
    schema = "id string, message string, ts double, tables array<string>"
    named = lineage.seed_commit(spark, spark.createDataFrame(rows, schema), ["accounts", "txns", "cards"])
    other = lineage.seed_commit(spark, spark.createDataFrame([r for r in rows if r[1] != "seeded catalog"], schema), ["accounts", "txns", "cards"])
    return named.select(F.lit("by message").alias("how"), "id").unionByName(other.select(F.lit("by tables").alias("how"), "id"))


def ddl_and_ops_agree(spark, d):
    """Applying a diff's operations to the old state gives the new one."""
    rows = []
    for name, ddl in (("ours", OURS_DDL), ("theirs", THEIRS_DDL), ("clash", CLASH_DDL)):
        after = _state(ddl)
        rows.append((name, hash_ir(apply_ops(BASE, diff(BASE, after))) == hash_ir(after)))
    return spark.createDataFrame(rows, "state string, agrees boolean")


def _values(rows: list[tuple], columns: str, casts: str = "") -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT {casts or '*'} FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns})"


_WALK = f"""WITH RECURSIVE w(head, id, parent, depth, seen) AS (
    SELECT h, id, parent, 0, [id] FROM {_C}, (VALUES {{}}) AS hs(h) WHERE id = h
    UNION ALL SELECT w.head, c.id, c.parent, w.depth + 1, list_append(w.seen, c.id) FROM w JOIN {_C} ON c.id = w.parent WHERE NOT list_contains(w.seen, c.id))"""
_BASE_ROWS = [("accounts", "table"), ("accounts.email", "column"), ("accounts.id", "column"), ("txns", "table"), ("txns.amount_cents", "column"), ("txns.constraint.txns_pkey", "constraint"), ("txns.id", "column"), ("txns.index.txns_memo_idx", "index"), ("txns.memo", "column")]
_TAGS = [("tags", "table"), ("tags.constraint.tags_pkey", "constraint"), ("tags.id", "column")]
_THEIRS_SIDE = {"txns.amount_cents", "txns.index.txns_memo_idx", "tags", "tags.constraint.tags_pkey", "tags.id"}
_A, _B = "pg_catalog.", "CAST(seq AS BIGINT) AS seq"
ORACLES = {
    "schema_diff": _values([("accounts.email", "column", "changed"), ("txns.amount_cents", "column", "changed"), ("txns.index.txns_memo_idx", "index", "dropped"), *[(p, k, "added") for p, k in _TAGS]], "path, kind, change"),
    "schema_diff_ops": _values([
        (0, "set_nullable", "accounts", "email", "LOCKING"), (1, "drop_index", "txns", "txns_memo_idx", "SAFE"), (2, "rename_column", "txns", "memo", "SAFE"), (3, "retype_column", "txns", "amount_cents", "REWRITE"),
        (4, "set_default", "txns", "note", "SAFE"), (5, "create_table", "tags", "tags", "SAFE")], "seq, kind, tbl, target, risk", f"{_B}, kind, tbl, target, risk"),
    "risk_classes": _values([(k, *x) for k, x in enumerate([
        ("create_table", "SAFE"), ("drop_table", "SAFE"), ("add_column", "SAFE"), ("add_column", "REWRITE"), ("add_column", "REWRITE"), ("drop_column", "SAFE"), ("rename_column", "SAFE"), ("retype_column", "SAFE"),
        ("retype_column", "REWRITE"), ("set_nullable", "SAFE"), ("set_nullable", "LOCKING"), ("set_default", "SAFE"), ("add_constraint", "LOCKING"), ("drop_constraint", "SAFE"), ("add_index", "LOCKING"), ("drop_index", "SAFE")])], "seq, kind, risk", f"{_B}, kind, risk"),
    "volatile_defaults": _values([("0", False), ("'random()'", False), ("now()", True), ("gen_random_uuid()", True), ("CAST(1 AS text)", False), ("CURRENT_TIMESTAMP", True), ("'a'::character varying", False), ("$$now()$$", False), ("nextval('s')", True), ("'it''s now()'", False), ("user_id", False), ("CURRENT_USER", True)], "expr, is_volatile"),
    "three_way_merge": _values([*[(p, k, "theirs" if p in _THEIRS_SIDE else "ours", p != "txns.index.txns_memo_idx") for p, k in [*_BASE_ROWS, *_TAGS]], ("txns.note", "column", "ours", True)], "path, kind, result, kept"),
    "merge_ops": _values([(0, "drop_index", "txns", "txns_memo_idx"), (1, "retype_column", "txns", "amount_cents"), (2, "create_table", "tags", "tags")], "seq, kind, tbl, target", f"{_B}, kind, tbl, target"),
    "merge_conflicts": _values([
        ("accounts.email", _A + "text", _A + "text", _A + "varchar(80)", "both sides changed column accounts.email differently"),
        ("txns.amount_cents", _A + "int8", _A + "numeric(12,2)", _A + "text", "both sides changed column txns.amount_cents differently")], "path, base_type, ours_type, theirs_type, reason"),
    "rename_suggestions": f"""WITH d AS ({_values(_DROPPED, "tbl, name, type, nullable")}), a AS ({_values(_ADDED, "tbl, name, type, nullable")})
        SELECT d.tbl, d.name AS old, a.name AS new, CAST(levenshtein(d.name, a.name) AS INTEGER) AS score FROM d JOIN a USING (tbl, type, nullable)
        WHERE levenshtein(d.name, a.name) <= 3 OR (left(d.name, 4) = left(a.name, 4) AND length(d.name) >= 4 AND length(a.name) >= 4)""",
    "rename_greedy": _values([("color", "kolor", 1, "Levenshtein 1"), ("colour", "colours", 1, "Levenshtein 1"), ("status_code", "status_text", 4, "shared prefix 'status_'")], "old, new, score, reason", "old, new, CAST(score AS BIGINT) AS score, reason"),
    "canonical_hash": """SELECT name, sha256(c) AS id, true AS same FROM (VALUES ('empty', '{"tables":[],"version":1}'),
        ('base', '{"tables":[{"columns":[{"default":null,"name":"email","nullable":true,"physicalName":"email","type":"pg_catalog.text"},{"default":null,"name":"id","nullable":false,"physicalName":"id","type":"pg_catalog.int8"}],"constraints":[],"indexes":[],"name":"accounts"},{"columns":[{"default":null,"name":"amount_cents","nullable":false,"physicalName":"amount_cents","type":"pg_catalog.int8"},{"default":null,"name":"id","nullable":false,"physicalName":"id","type":"pg_catalog.int8"},{"default":null,"name":"memo","nullable":true,"physicalName":"memo","type":"pg_catalog.text"}],"constraints":[{"columns":["id"],"expression":null,"kind":"primary","name":"txns_pkey","references":null,"validated":true}],"indexes":[{"columns":["memo"],"method":"btree","name":"txns_memo_idx","predicate":null,"unique":false}],"name":"txns"}],"version":1}'),
        ('theirs', '{"tables":[{"columns":[{"default":null,"name":"email","nullable":false,"physicalName":"email","type":"pg_catalog.text"},{"default":null,"name":"id","nullable":false,"physicalName":"id","type":"pg_catalog.int8"}],"constraints":[],"indexes":[],"name":"accounts"},{"columns":[{"default":null,"name":"id","nullable":false,"physicalName":"id","type":"pg_catalog.int8"}],"constraints":[{"columns":["id"],"expression":null,"kind":"primary","name":"tags_pkey","references":null,"validated":true}],"indexes":[],"name":"tags"},{"columns":[{"default":null,"name":"amount_cents","nullable":false,"physicalName":"amount_cents","type":"pg_catalog.numeric(12,2)"},{"default":null,"name":"id","nullable":false,"physicalName":"id","type":"pg_catalog.int8"},{"default":null,"name":"memo","nullable":true,"physicalName":"memo","type":"pg_catalog.text"}],"constraints":[{"columns":["id"],"expression":null,"kind":"primary","name":"txns_pkey","references":null,"validated":true}],"indexes":[],"name":"txns"}],"version":1}')) AS v(name, c)""",
    "type_canon": _values(list(zip(_SPELLINGS, [_A + x for x in ("int8", "int4", "int4", "float8", "varchar(20)", "varchar", "bpchar(3)", "numeric(10,2)", "numeric", "timestamptz", "timestamp(3)", "bool", "text[]", "int4", "mytype", "json")], strict=True)), "spelling, canonical"),
    "coercible": _values([(*p, x) for p, x in zip(_PAIRS, (True, True, True, False, True, False, True, False, True, False, True), strict=True)], "old_type, new_type, free"),
    "ddl_round": _values([
        ("accounts", "column", "email", _A + "text", "true", None), ("accounts", "column", "id", _A + "int8", "false", None),
        ("accounts2", "column", "Odd Name", _A + "text", "true", "'x'"), ("accounts2", "column", "email", _A + "varchar(80)", "true", None), ("accounts2", "column", "id", _A + "int8", "false", None), ("accounts2", "column", "txn", _A + "int8", "true", None), ("accounts2", "column", "years", _A + "int4", "false", None),
        ("txns", "column", "amount_cents", _A + "int8", "false", None), ("txns", "column", "id", _A + "int8", "false", None),
        ("accounts2", "check", "accounts2_age_check", "", None, "(years >= 0)"), ("accounts2", "unique", "accounts2_email_key", "email", None, None), ("accounts2", "primary", "accounts2_pkey", "id", None, None), ("accounts2", "foreign", "accounts2_txn_fkey", "txn", None, None),
        ("txns", "primary", "txns_pkey", "id", None, None), ("accounts2", "index", "accounts2_email_idx", "email", "true", "(years > 3)")], "tbl, kind, name, detail, flag, expr"),
    "overlay_list": "SELECT CAST(id AS BIGINT) AS id, amount_cents, note, 'card' AS kind, CAST(NULL AS VARCHAR) AS gone FROM (VALUES (1, '250', 'a'), (2, '300', NULL)) v(id, amount_cents, note)",
    "plan_steps": _values([(k, *x) for k, x in enumerate([
        *[(kind, do, "txns", "REWRITE", False) for kind, do in (("expand", "expand"), ("sync", "sync"), ("backfill", "backfill"), ("ddl", "nop"), ("validate", "validate_not_null"), ("ddl", "set_nullable"), ("ddl", "nop"), ("cutover", "cutover"))], ("contract", "drop_kept", "txns", "REWRITE", True),
        *[(kind, do, "txns", "REWRITE", False) for kind, do in (("expand", "expand"), ("sync", "sync"), ("backfill", "backfill"), ("ddl", "shadow_default"), ("cutover", "cutover"))],
        *[(kind, do, "txns", "LOCKING", False) for kind, do in (("ddl", "nop"), ("validate", "validate_not_null"), ("ddl", "set_nullable"), ("ddl", "nop"))], ("contract", "drop_table", "accounts", "SAFE", True)])], "seq, kind, action, tbl, risk, manual", f"{_B}, kind, action, tbl, risk, manual"),
    "ancestors": _WALK.format("('d'), ('g'), ('p'), ('o')") + " SELECT head, id, CAST(depth AS BIGINT) AS depth FROM w",
    "lca": _WALK.format("('d'), ('g'), ('c'), ('y')") + """ SELECT l, r, (SELECT b.id FROM w b WHERE b.head = r AND b.id IN (SELECT a.id FROM w a WHERE a.head = l) ORDER BY b.depth LIMIT 1) AS id
        FROM (VALUES ('d', 'g'), ('c', 'd'), ('d', 'd'), ('d', 'y')) p(l, r) WHERE id IS NOT NULL""",
    "rewind_undone": _WALK.format("('d')") + " SELECT CAST(depth AS BIGINT) AS nth, id AS undone, (SELECT id FROM w WHERE depth = 2) AS target FROM w WHERE depth < 2",
    "ancestors_by_order": """WITH RECURSIVE w(k, depth) AS (SELECT max(o_orderkey), 0 FROM orders UNION ALL SELECT k // 2, depth + 1 FROM w WHERE k > 0)
        SELECT CAST(k AS VARCHAR) AS id, CAST(depth AS BIGINT) AS depth FROM w""",
    "view_dependents": f"""WITH RECURSIVE e AS ({_values(_EDGES, "dependent, dep_on")}), w(name, depth) AS (SELECT dependent, 1 FROM e WHERE dep_on = 't' UNION SELECT e.dependent, w.depth + 1 FROM w JOIN e ON e.dep_on = w.name)
        SELECT name, CAST(max(depth) AS BIGINT) AS depth FROM w GROUP BY name""",
    "prune_history": _WALK.format("('g')") + f" SELECT id FROM {_C} WHERE id NOT IN (SELECT id FROM w)",
    "leftover_shadows": "SELECT * FROM (VALUES ('nation', 'n_regionkey__old_1'), ('region', 'r_name__old_1')) v(tbl, col)",
    "closed_merges": "SELECT CAST(id AS BIGINT) AS id, kind, state FROM (VALUES (1, 'merge', 'reverted'), (2, 'merge', 'merged'), (3, 'rewind', 'merged')) v(id, kind, state)",
    "seed_commit": "SELECT * FROM (VALUES ('by message', 'c4'), ('by tables', 'c3')) v(how, id)",
    "ddl_and_ops_agree": "SELECT * FROM (VALUES ('ours', true), ('theirs', true), ('clash', true)) v(state, agrees)",
}
QUERIES = {name: globals()[name] for name in ORACLES}

"""What a repository does, as rows: catalogs, constraints, branches, claims, guards, housekeeping. Each query drives `Repo` itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..api import Conflict, NotFound
from ..functions import names
from ..ir import hash_ir
from ..operators import overlay, probes
from ..operators.backfill import Controller
from ..operators.diff import Op
from ..plans.ddl import DDLError, checked
from ..plans.runner import MigrationError, lock
from ..sources import seed
from ..sources.scratch import shared_dir
from ..sources.store import TRIES, Busy, Store, pause_before
from .branches import merged, read, repo_of
from .schemas import BASE, _state, _values


def _said(call) -> str:
    """What an attempt was answered: `done`, or the kind of error."""
    try:
        call()
    except (Conflict, NotFound, MigrationError, Busy, DDLError, ValueError) as e:
        return type(e).__name__
    return "done"


def repo_catalog(spark, d):
    """main's columns, as introspected from the given files."""
    repo = repo_of(spark, d, {"nation": ["n_nationkey"], "events": ["event_id"]})
    rows = [(t.name, c.name, c.type, c.nullable, c.ordinal) for t in repo.schema("main").tables for c in t.columns]
    return spark.createDataFrame(rows, "tbl string, name string, type string, nullable boolean, ordinal long")


_KEYS = {"nation": ["n_nationkey"], "region": ["r_regionkey"]}
_ADD = """CREATE TABLE tags (id bigint PRIMARY KEY, word text NOT NULL DEFAULT 'x'); ALTER TABLE nation ALTER n_name SET DEFAULT 'none', ALTER n_regionkey SET NOT NULL;
    ALTER TABLE nation ADD CONSTRAINT low CHECK (n_nationkey < 100), ADD CONSTRAINT home FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey), ADD CONSTRAINT one UNIQUE (n_name); CREATE INDEX by_region ON nation (n_regionkey)"""


def migrate_constraints(spark, d):
    """A created table, a default, NOT NULL, constraints and an index, probed against the rows; then some are dropped again."""
    repo = merged(spark, d, _KEYS, _ADD)
    rows = []

    def note(when: str) -> None:
        ir = repo.schema("main")
        rows.extend((when, t.name, "column", c.name, c.default, not c.nullable) for t in ir.tables for c in t.columns if c.default is not None or not c.nullable)
        rows.extend((when, t.name, c.kind, c.name, c.expression, c.validated) for t in ir.tables for c in t.constraints)
        rows.extend((when, t.name, "index", i.name, None, i.unique) for t in ir.tables for i in t.indexes)

    note("added")
    repo.ddl("change", "ALTER TABLE nation DROP CONSTRAINT low, DROP CONSTRAINT one; DROP INDEX by_region; ALTER TABLE nation ALTER n_name DROP DEFAULT, ALTER n_regionkey DROP NOT NULL")
    repo.commit("change", "dropped")
    repo.apply_merge(repo.create_merge("change")["id"])
    note("dropped")
    return spark.createDataFrame(rows, "moment string, tbl string, kind string, name string, expr string, flag boolean")


def refused_migrations(spark, d):
    """Changes that rows contradict: the step that fails, how often it was tried, and main as it was."""
    out = []
    for ddl in ("ALTER TABLE nation ADD UNIQUE (n_regionkey)", "CREATE UNIQUE INDEX ON nation (n_regionkey)", "ALTER TABLE nation ADD CHECK (n_nationkey < 3)", "ALTER TABLE region ADD FOREIGN KEY (r_regionkey) REFERENCES gone (id)", "ALTER TABLE nation ADD COLUMN x int NOT NULL"):
        repo = repo_of(spark, d, _KEYS)
        head = repo.branches()[0]["head"]
        repo.create_branch("b")
        repo.ddl("b", ddl)
        repo.commit("b", "b")
        n = repo.create_merge("b")["id"]
        said = _said(lambda: repo.apply_merge(n))  # noqa: B023
        failed = next(s for s in repo.get_merge(n)["steps"] if s["state"] == "failed")
        left = repo.schema("main").table("nation").indexes, repo.store.state()["tables"]["nation"].get("building", {})
        out.append((ddl, said, failed["kind"], failed.get("tries", 1), not any(left), repo.branches()[0]["head"] == head))
    return spark.createDataFrame(out, "ddl string, said string, step string, tries long, nothing_left boolean, same_head boolean")


def branch_states(spark, d):
    """Branches from their creation to their end: dirty, committed, integrated, stale, deleted."""
    repo, out = repo_of(spark, d, _KEYS), []
    for b, ddl in (("a", "ALTER TABLE nation ADD COLUMN one int"), ("b", "ALTER TABLE nation ADD COLUMN two int"), ("c", "ALTER TABLE nation RENAME n_name TO label")):
        repo.create_branch(b)
        out.append((f"{b} dirty at first", str(repo.is_dirty(b))))
        repo.ddl(b, ddl)
        out.append((f"{b} dirty after ddl", str(repo.is_dirty(b))))
        repo.commit(b, b)
    out.append(("a dirty after commit", str(repo.is_dirty("a"))))
    out.append(("a against main", ",".join(f"{o.kind} {o.target}" for o in repo.diff("main", "a")["ops"])))
    out.append(("by commit", str(repo.diff("main", repo._branch("a")["head"])["ops"] == repo.diff("main", "a")["ops"])))
    out.append(("preview", ",".join(o.target for o in repo.integrate("b", "a", preview=True).ops)))
    repo.integrate("b", "a")
    out.append(("a integrated", ",".join(repo.table("nation", "a").columns)))
    repo.apply_merge(repo.create_merge("c")["id"])
    out.append(("a stale", str("n_name" in (repo._branch("a")["stale"] or ""))))
    out.append(("a read", _said(lambda: repo.table("nation", "a"))))
    out.append(("again", _said(lambda: repo.create_branch("a"))))
    repo.delete_branch("a")
    out.append(("deleted", ",".join(x["name"] for x in repo.branches())))
    out.append(("gone", _said(lambda: repo.table("nation", "a"))))
    out.append(("main", _said(lambda: repo.delete_branch("main"))))
    return spark.createDataFrame(out, "what string, answer string")


def branch_after_retype(spark, d):
    """A branch that was made before main retyped a column reads it as it was, through the kept one; a contract waits for it."""
    repo = repo_of(spark, d, {"part": ["p_partkey"]})
    repo.create_branch("reader")
    repo.create_branch("change")
    repo.ddl("change", "ALTER TABLE part ALTER p_size TYPE text")
    repo.commit("change", "text")
    repo.apply_merge(repo.create_merge("change")["id"])
    said = _said(lambda: repo.contract_merge(1))
    who = ",".join(repo.dependents("part", "p_size"))
    return repo.table("part", "reader").select("p_partkey", "p_size", F.lit(said).alias("contract"), F.lit(who).alias("readers"))


def validate_branch(spark, d):
    """A branch's changes against main's rows, found by one scan a table."""
    repo = repo_of(spark, d, {"customer": ["c_custkey"], "part": ["p_partkey"]})
    repo.create_branch("b")
    repo.ddl("b", "ALTER TABLE customer ALTER c_mktsegment TYPE varchar(8), ADD CONSTRAINT rich CHECK (c_acctbal >= 0); ALTER TABLE part ADD CONSTRAINT names UNIQUE (p_name); ALTER TABLE customer ALTER c_name SET NOT NULL")
    found = [f for f in repo.validate("b") if f.count is not None]
    return spark.createDataFrame([(f.op.kind, f.op.table, f.blocked, f.count) for f in found], "kind string, tbl string, blocked boolean, n long")


_TEXTS = [
    ("extract(year from d) > 2000", True), ("coalesce(a, 0) >= 0 AND b ~ '^x'", True), ("a IN (1, 2) OR NOT (b LIKE 'x%')", True), ("CAST(a AS varchar(3)) <> 'select'", True), ("\"Odd\" IS DISTINCT FROM 3", True),
    ("reflect('java.lang.System', 'exit', 0) IS NULL", False), ("try_reflect('java.lang.System', 'getenv', 'X') = 'x'", False), ("java_method('java.util.UUID', 'randomUUID') <> ''", False), ("a > (SELECT 1)", False),
    ("EXISTS (SELECT 1)", False), ("a = 1; DROP TABLE t", False), ("raise_error('x')", False), ("from_json(a, 'x') IS NULL", False), ("a >", False), ("`reflect`('x')", False),
]


def expression_guard(spark, d):
    """Which texts pass as an expression over a row: in a CHECK, and as USING and DEFAULT of operations given as such."""
    rows = []
    for text, _ in _TEXTS:
        using, default = Op("retype_column", "t", "c", "pg_catalog.varchar(9)", old="pg_catalog.text", using=text), Op("set_default", "t", "c", text)
        rows.append((text, *(_said(call) == "done" for call in (lambda: probes.check_text(text), lambda: checked(using), lambda: checked(default)))))  # noqa: B023
    return spark.createDataFrame(rows, "expr string, as_check boolean, as_using boolean, as_default boolean")


_NAMES = [("feature-x", True), ("0a", True), ("a" * 39, True), ("a" * 40, False), ("-a", False), ("Aa", False), ("a_b", False), ("", False)]


def identifier_rules(spark, d):
    return spark.createDataFrame([(n, _said(lambda: names.check_branch(n)) == "done") for n, _ in _NAMES], "name string, ok boolean")  # noqa: B023


def adaptive_sizes(spark, d):
    """How a backfill's batch size follows the time that batches took."""
    control, out = Controller(), []
    for k, ms in enumerate([1500, 100, 500, 50, 50, 1001, 1000, 200, 199, *[3000] * 10, *[1] * 25]):
        out.append((k, ms, control.after(ms)))
    return spark.createDataFrame(out, "nth long, ms long, size long")


def guarded_changes(spark, d):
    """Pauses of a change that is always too late, before chance varies them, and what becomes of it."""
    store, waits = Store(spark, f"{shared_dir(spark)}/busy-{uuid.uuid4().hex}"), []
    store.files.create = lambda *a: False
    said = _said(lambda: store.change(lambda s: None, pause=waits.append))
    rows = [(k, round(1000 * pause_before(k)), 0.5 * pause_before(k) <= w < 1.5 * pause_before(k), said) for k, w in enumerate(waits)]
    return spark.createDataFrame(rows, "nth long, ms long, within boolean, said string")


def merge_claims(spark, d):
    """What may be done with a merge in each of its states, and under another's lock."""
    repo, out = merged(spark, d, _KEYS, "ALTER TABLE nation DROP COLUMN n_name"), []
    out.append(("apply merged", _said(lambda: repo.apply_merge(1)), repo.get_merge(1)["state"]))
    with lock(repo.store):
        out.append(("revert under lock", _said(lambda: repo.revert_merge(1)), repo.get_merge(1)["state"]))
    out.append(("revert", _said(lambda: repo.revert_merge(1)), repo.get_merge(1)["state"]))
    out.append(("contract reverted", _said(lambda: repo.contract_merge(1)), repo.get_merge(1)["state"]))
    out.append(("no such merge", _said(lambda: repo.get_merge(9)), ""))
    repo.create_branch("b")
    repo.ddl("b", "ALTER TABLE nation ADD COLUMN x int")
    out.append(("merge uncommitted", _said(lambda: repo.create_merge("b")), ""))
    out.append(("rewind uncommitted", _said(lambda: repo.create_rewind(merges_back=1)), ""))
    repo.delete_branch("b")
    repo.create_branch("again")
    repo.ddl("again", "ALTER TABLE nation DROP COLUMN n_name")
    repo.commit("again", "again")
    n = repo.create_merge("again")["id"]
    repo.runner._set(n, "running")
    out.append(("apply after a crash", _said(lambda: repo.apply_merge(n)), repo.get_merge(n)["state"]))
    out.append(("contract", _said(lambda: repo.contract_merge(n)), repo.get_merge(n)["state"]))
    return spark.createDataFrame(out, "what string, said string, state string")


def unknown_views(spark, d):
    """A view that no branch registered keeps main's column where it is: nothing changes until it is gone."""
    repo = repo_of(spark, d, {"region": ["r_regionkey"]})
    view = f"report_{uuid.uuid4().hex[:8]}"
    repo.register("main")
    spark.sql(f"CREATE TEMPORARY VIEW {view} AS SELECT r_name FROM main__region")
    repo.create_branch("b")
    repo.ddl("b", "ALTER TABLE region RENAME r_name TO label")
    repo.commit("b", "b")
    n = repo.create_merge("b")["id"]
    out = [("with the view", _said(lambda: repo.apply_merge(n)), repo.get_merge(n)["state"], ",".join(repo.table("region").columns))]
    spark.catalog.dropTempView(view)
    out.append(("without", _said(lambda: repo.apply_merge(n)), repo.get_merge(n)["state"], ",".join(repo.table("region").columns)))
    for name in repo.registered:
        spark.catalog.dropTempView(name)
    return spark.createDataFrame(out, "what string, said string, state string, columns string")


def reset_repo(spark, d):
    """After a reset main is what the repository began with, and stores nothing of its own."""
    repo = merged(spark, d, {"part": ["p_partkey"]}, "ALTER TABLE part ALTER p_size TYPE text; ALTER TABLE part DROP COLUMN p_type")
    repo.write("part", repo.table("part").where("p_partkey < 5"))
    head = repo.store.state()["seed"]["commit"]
    repo.reset()
    files = repo.store.files.names("data/part")
    return repo.table("part").select("p_partkey", "p_size", "p_type", F.lit(len(files)).cast("long").alias("left"), F.lit(hash_ir(repo.schema("main")) == head).alias("same"))


def seed_missing(spark, d):
    """Seed tables that are there stay as they are."""
    root, sizes = f"{shared_dir(spark)}/seed-{uuid.uuid4().hex}", {"merchants": 50, "accounts": 60, "cards": 70, "txns": 80, "disputes": 90}
    spark.range(7).write.parquet(f"{root}/cards")
    paths = seed.seed(spark, root, sizes, missing_only=True)
    return spark.createDataFrame([(n, spark.read.parquet(p).count()) for n, p in paths.items()], "tbl string, n long")


def planned_views(spark, d):
    """Which tables a branch reads through main, which are its own, and which it dropped."""
    branch = _state("DROP TABLE accounts; CREATE TABLE own (id bigint); ALTER TABLE txns RENAME memo TO note")
    rows = [(what, t) for what, tables in overlay.plan_views(branch, BASE).items() for t in tables]
    rows += [("column", c) for c in overlay.referenced(branch.table("txns"))]
    return spark.createDataFrame(rows, "what string, name string")


_A = "pg_catalog."
_PAUSES = [min(100 * 2**k, 5000) for k in range(TRIES - 1)]
_KEPT = [("nation", "column", "n_nationkey", None, True), ("region", "column", "r_regionkey", None, True), ("tags", "column", "id", None, True), ("tags", "column", "word", "'x'", True), ("nation", "primary", "nation_pkey", None, True), ("region", "primary", "region_pkey", None, True), ("tags", "primary", "tags_pkey", None, True), ("nation", "foreign", "home", None, True)]
_GONE = [("nation", "column", "n_name", "'none'", False), ("nation", "column", "n_regionkey", None, True), ("nation", "check", "low", "(n_nationkey < 100)", True), ("nation", "unique", "one", None, True), ("nation", "index", "by_region", None, False)]
ORACLES = {
    "repo_catalog": _values([
        ("nation", "n_nationkey", _A + "int4", False, 1), ("nation", "n_name", _A + "text", True, 2), ("nation", "n_regionkey", _A + "int4", True, 3),
        ("events", "event_id", _A + "int8", False, 1), ("events", "ts", _A + "timestamp", True, 2), ("events", "user_id", _A + "int8", True, 3), ("events", "event_type", _A + "text", True, 4), ("events", "value", _A + "float8", True, 5), ("events", "props", _A + "text", True, 6)],
        "tbl, name, type, nullable, ordinal", "tbl, name, type, nullable, CAST(ordinal AS BIGINT) AS ordinal"),
    "migrate_constraints": _values([*[("added", *x) for x in [*_KEPT, *_GONE]], *[("dropped", *x) for x in _KEPT]], "moment, tbl, kind, name, expr, flag"),
    "refused_migrations": _values([
        ("ALTER TABLE nation ADD UNIQUE (n_regionkey)", "MigrationError", "index_concurrent", 3, True, True), ("CREATE UNIQUE INDEX ON nation (n_regionkey)", "MigrationError", "index_concurrent", 3, True, True),
        ("ALTER TABLE nation ADD CHECK (n_nationkey < 3)", "MigrationError", "validate", 1, True, True), ("ALTER TABLE region ADD FOREIGN KEY (r_regionkey) REFERENCES gone (id)", "MigrationError", "validate", 1, True, True),
        ("ALTER TABLE nation ADD COLUMN x int NOT NULL", "MigrationError", "ddl", 1, True, True)], "ddl, said, step, tries, nothing_left, same_head", "ddl, said, step, CAST(tries AS BIGINT) AS tries, nothing_left, same_head"),
    "branch_states": _values([
        *[(f"{b} dirty {when}", x) for b in "abc" for when, x in (("at first", "False"), ("after ddl", "True"))], ("a dirty after commit", "False"), ("a against main", "add_column one"), ("by commit", "True"), ("preview", "two"),
        ("a integrated", "n_nationkey,n_name,n_regionkey,one,two"), ("a stale", "True"), ("a read", "Conflict"), ("again", "Conflict"), ("deleted", "main,b,c"), ("gone", "NotFound"), ("main", "Conflict")], "what, answer"),
    "branch_after_retype": "SELECT p_partkey, p_size, 'MigrationError' AS contract, 'reader' AS readers FROM part",
    "validate_branch": """SELECT kind, tbl, n > 0 AS blocked, n FROM (SELECT 'retype_column' AS kind, 'customer' AS tbl, count(*) FILTER (WHERE length(c_mktsegment) > 8) AS n FROM customer
        UNION ALL SELECT 'add_constraint', 'customer', count(*) FILTER (WHERE NOT c_acctbal >= 0) FROM customer UNION ALL SELECT 'set_nullable', 'customer', count(*) FILTER (WHERE c_name IS NULL) FROM customer
        UNION ALL SELECT 'add_constraint', 'part', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1))""",
    "expression_guard": _values([(t, x, x, x) for t, x in _TEXTS], "expr, as_check, as_using, as_default"),
    "identifier_rules": _values(_NAMES, "name, ok"),
    "adaptive_sizes": """WITH RECURSIVE t AS (SELECT CAST(nth AS BIGINT) AS nth, CAST(ms AS BIGINT) AS ms FROM (SELECT unnest(range(44)) AS nth, unnest([1500, 100, 500, 50, 50, 1001, 1000, 200, 199] || list_transform(range(10), lambda x: 3000) || list_transform(range(25), lambda x: 1)) AS ms)),
        w(nth, ms, size) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(10000 AS BIGINT) UNION ALL
            SELECT t.nth, t.ms, CASE WHEN t.ms > 1000 THEN greatest(100, w.size // 2) WHEN t.ms < 200 THEN least(500000, w.size * 3 // 2) ELSE w.size END FROM w JOIN t ON t.nth = w.nth + 1)
        SELECT nth, ms, size FROM w WHERE nth >= 0""",
    "guarded_changes": _values([(k, ms, True, "Busy") for k, ms in enumerate(_PAUSES)], "nth, ms, within, said", "CAST(nth AS BIGINT) AS nth, CAST(ms AS BIGINT) AS ms, within, said"),
    "merge_claims": _values([
        ("apply merged", "MigrationError", "merged"), ("revert under lock", "Locked", "merged"), ("revert", "done", "reverted"), ("contract reverted", "MigrationError", "reverted"), ("no such merge", "NotFound", ""),
        ("merge uncommitted", "Conflict", ""), ("rewind uncommitted", "Conflict", ""), ("apply after a crash", "done", "merged"), ("contract", "done", "contracted")], "what, said, state"),
    "unknown_views": _values([("with the view", "MigrationError", "planned", "r_regionkey,r_name"), ("without", "done", "merged", "r_regionkey,label")], "what, said, state, columns"),
    "reset_repo": "SELECT p_partkey, p_size, p_type, CAST(0 AS BIGINT) AS left, true AS same FROM part",
    "seed_missing": _values([("merchants", 50), ("accounts", 60), ("cards", 7), ("txns", 80), ("disputes", 90)], "tbl, n", "tbl, CAST(n AS BIGINT) AS n"),
    "planned_views": _values([("views", "txns"), ("own", "own"), ("dropped", "accounts"), ("column", "id"), ("column", "amount_cents"), ("column", "memo")], "what, name"),
}
QUERIES = {name: globals()[name] for name in ORACLES}

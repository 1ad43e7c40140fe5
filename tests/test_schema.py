"""Schema states without data: canonical form, types, diff, classification, renames, merge, ancestors, plans, DDL."""

import random
from dataclasses import replace

import pytest

from tablegraft.functions import names, types
from tablegraft.ir import Column, Constraint, Index, SchemaIR, Table, canonical_json, from_json, hash_ir, to_json
from tablegraft.operators import lineage
from tablegraft.operators.diff import KINDS, Op, classify, diff, is_volatile, suggest_renames
from tablegraft.operators.merge import merge
from tablegraft.operators.overlay import plan_views, referenced, remap
from tablegraft.plans.compile import KINDS as STEPS
from tablegraft.plans.compile import compile_plan, key_of
from tablegraft.plans.ddl import DDLError, apply_ops, parse_ddl
from tablegraft.queries.schemas import BASE, TXNS

INT8, TEXT = "pg_catalog.int8", "pg_catalog.text"


def table(name="t", *columns, constraints=(), indexes=()):
    return Table(name, tuple(c if isinstance(c, Column) else Column(c, TEXT, True, None, k) for k, c in enumerate(columns, 1)), constraints, indexes)


def ir(*tables):
    return SchemaIR(tables)


def kinds(ops):
    return [(o.kind, o.target) for o in ops]


# canonical form


def test_empty_state():
    assert canonical_json(SchemaIR()) == '{"tables":[],"version":1}'
    assert hash_ir(SchemaIR()) == "8e229cab95594fa988a231ac39a2b1480de616e044783810fe71c704fac121e8"


def test_order_and_ordinals_do_not_matter():
    a = ir(table("b", "x", "y"), table("a", "z"))
    b = ir(table("a", "z"), Table("b", tuple(replace(c, ordinal=9 - c.ordinal) for c in reversed(table("b", "x", "y").columns))))
    assert hash_ir(a) == hash_ir(b)


@pytest.mark.parametrize("change", [{"name": "other"}, {"type": INT8}, {"nullable": False}, {"default": "1"}, {"physical": "stored"}])
def test_every_field_of_a_column_matters(change):
    c = Column("c", TEXT)
    assert hash_ir(ir(Table("t", (c,)))) != hash_ir(ir(Table("t", (replace(c, **change),))))


def test_constraints_keep_declared_order_and_validation():
    def one(columns, validated=True):
        return hash_ir(ir(table("t", "a", "b", constraints=(Constraint("u", "unique", columns, validated=validated),))))

    assert one(("a", "b")) != one(("b", "a")) and one(("a", "b")) != one(("a", "b"), False)


def test_json_round_trip():
    ref = Constraint("f", "foreign", ("a",), references=("o", ("id",)))
    state = ir(table("t", Column("a", TEXT, using="a || 'é'"), constraints=(ref,), indexes=(Index("i", ("a",), True, "btree", "a > 'b'"),)))
    assert from_json(to_json(state)) == state


# types


@pytest.mark.parametrize(("text", "want"), [
    ("BIGINT", "int8"), ("character  varying ( 5 )", "varchar(5)"), ("decimal(10, 2)", "numeric(10,2)"), ("timestamp(3) with time zone", "timestamptz(3)"), ("int4(4)", "int4"), ("text[]", "text[]"), ("pg_catalog.int8", "int8"), ("numeric(20,0)", "numeric(20,0)"),
])
def test_canonical_types(text, want):
    assert types.canonicalize(text) == f"pg_catalog.{want}" and types.canonicalize(types.canonicalize(text)) == f"pg_catalog.{want}"


def test_spark_types():
    assert types.spark_type("numeric(10,2)").simpleString() == "decimal(10,2)" and types.spark_type("numeric").simpleString() == "decimal(38,18)"
    assert types.spark_type("text[]").simpleString() == "array<string>" and types.spark_type("timestamp").simpleString() == "timestamp_ntz"
    for bad in ("timetz", "interval", "mytype"):
        with pytest.raises(ValueError, match="no Spark type"):
            types.spark_type(bad)


def test_names():
    for bad in ("", "x" * 64, "a\0b"):
        with pytest.raises(names.InvalidIdentifier):
            names.check(bad)
    for bad in ("", "-a", "A", "a_b", "a" * 40):
        with pytest.raises(names.InvalidIdentifier):
            names.check_branch(bad)
    assert names.database("feature-x") == "br_feature_x" and names.database("main") == "main"
    assert names.shadow("c") == "c__new" and len(names.shadow("c" * 63)) <= 63
    assert names.backup("amount", 12) == "amount__old_12" and len(names.backup("c" * 63, 12)) == 63
    assert names.levenshtein("kitten", "sitting") == 3 and names.shared_prefix("amount_cents", "amount") == 6
    with pytest.raises(ValueError, match="not a type"):
        types.read_type("text(; drop")


# diff


def test_equal_states():
    assert diff(BASE, BASE) == []


def test_order_of_operations():
    old = ir(table("gone", "x"), table("t", "a", "b", "c", constraints=(Constraint("u", "unique", ("a",)),), indexes=(Index("i", ("b",)),)))
    new = ir(table("come", "x"), table("t", Column("a", INT8, False, "1"), Column("cc", TEXT, physical="c"), "d", constraints=(Constraint("v", "unique", ("a",)),), indexes=(Index("j", ("d",)),)))
    assert [(o.kind, o.table, o.target) for o in diff(old, new)] == [
        ("drop_table", "gone", "gone"), ("drop_index", "t", "i"), ("drop_constraint", "t", "u"), ("drop_column", "t", "b"), ("rename_column", "t", "c"), ("retype_column", "t", "a"),
        ("set_nullable", "t", "a"), ("set_default", "t", "a"), ("add_column", "t", "d"), ("add_constraint", "t", "v"), ("add_index", "t", "j"), ("create_table", "come", "come"),
    ]


def test_physical_name_and_validation_alone_are_no_difference():
    a = Constraint("c", "check", (), "a > '1'", validated=False)
    assert diff(ir(table("t", "a", constraints=(a,))), ir(table("t", Column("a", TEXT, physical="other"), constraints=(replace(a, validated=True),)))) == []


def test_ambiguous_rename_is_drop_and_add():
    old, new = ir(table("t", "a")), ir(table("t", Column("b", TEXT, physical="a"), Column("c", TEXT, physical="a")))
    assert kinds(diff(old, new)) == [("drop_column", "a"), ("add_column", "b"), ("add_column", "c")]


def test_changed_definitions_are_replaced():
    old = ir(table("t", "a", constraints=(Constraint("c", "check", (), "a > '1'"),), indexes=(Index("i", ("a",)),)))
    new = ir(table("t", "a", constraints=(Constraint("c", "check", (), "a > '2'"),), indexes=(Index("i", ("a",), True),)))
    assert kinds(diff(old, new)) == [("drop_index", "i"), ("drop_constraint", "c"), ("add_constraint", "c"), ("add_index", "i")]


def test_random_states_reach_each_other():
    rng = random.Random(5)

    def state():
        tables = []
        for t in rng.sample("pqrs", rng.randint(0, 4)):
            cols = [Column(c, rng.choice([TEXT, INT8]), rng.random() < 0.5, rng.choice([None, "1"]), k) for k, c in enumerate(rng.sample("abcdef", rng.randint(1, 6)), 1)]
            cons = [Constraint(f"u{c.name}", "unique", (c.name,)) for c in cols if rng.random() < 0.3]
            tables.append(Table(t, tuple(cols), tuple(cons), tuple(Index(f"i{c.name}", (c.name,)) for c in cols if rng.random() < 0.3)))
        return ir(*tables)

    for _ in range(200):
        a, b = state(), state()
        assert hash_ir(apply_ops(a, diff(a, b))) == hash_ir(b)


def test_every_kind_has_a_risk():
    sample = {"add_column": Column("c", TEXT), "retype_column": TEXT}
    for kind in KINDS:
        assert classify(Op(kind, "t", "c", sample.get(kind), old=INT8)) in ("SAFE", "LOCKING", "REWRITE")
    with pytest.raises(ValueError, match="unknown"):
        classify(Op("vanish", "t"))


@pytest.mark.parametrize(("expr", "want"), [(None, False), ("'now()'", False), ("NOW ()", True), ("cast(1 as text)", False), ("'x'::varchar(3)", False), ("current_timestamp::date", True), ("my_user", False), ("lower('A')", True)])
def test_volatile(expr, want):
    assert is_volatile(expr) is want


def test_rename_needs_type_and_nullability():
    old = ir(table("t", Column("memo", TEXT), Column("amount", INT8, False)))
    new = ir(table("t", Column("memos", INT8), Column("amounts", INT8, True)))
    assert suggest_renames(diff(old, new), old) == []
    new = ir(table("t", Column("memos", TEXT), Column("amount_cents", INT8, False)))
    assert [(r.old, r.new, r.reason) for r in suggest_renames(diff(old, new), old)] == [("amount", "amount_cents", "shared prefix 'amount'"), ("memo", "memos", "Levenshtein 1")]


# merge


def test_converging_and_one_sided_changes():
    ours, theirs = (parse_ddl(x, BASE)[1] for x in ("ALTER TABLE accounts ALTER email SET NOT NULL", "ALTER TABLE accounts ALTER email SET NOT NULL; ALTER TABLE txns DROP COLUMN memo"))
    out = merge(BASE, ours, theirs)
    assert out.conflicts == [] and kinds(out.ops) == [("drop_index", "txns_memo_idx"), ("drop_column", "memo")]
    assert hash_ir(out.ir) == hash_ir(theirs)
    assert merge(BASE, theirs, BASE).ops == []


def test_conflicts_suppress_operations():
    ours, theirs = (parse_ddl(f"ALTER TABLE txns ALTER memo TYPE {t}; ALTER TABLE accounts DROP COLUMN email", BASE)[1] for t in ("varchar(9)", "varchar(8)"))
    out = merge(BASE, ours, theirs)
    assert [c.path for c in out.conflicts] == ["txns.memo"] and out.ops == [] and out.ir is None
    assert out.conflicts[0].reason == "both sides changed column txns.memo differently"


def test_dropped_table_against_added_column():
    ours, theirs = (parse_ddl(x, BASE)[1] for x in ("ALTER TABLE txns ADD COLUMN n int", "DROP TABLE txns"))
    assert [c.path for c in merge(BASE, ours, theirs).conflicts] == ["txns"]


def test_two_renames_of_one_column():
    ours, theirs = (parse_ddl(f"ALTER TABLE txns RENAME memo TO {n}", BASE)[1] for n in ("note", "remark"))
    assert "txns.memo" in [c.path for c in merge(BASE, ours, theirs).conflicts]


def test_ordinals_never_conflict():
    ours, theirs = (SchemaIR((Table("t", (Column("a", TEXT, ordinal=k), Column("b", TEXT, ordinal=5 - k))),)) for k in (1, 2))
    assert merge(SchemaIR((table("t", "a", "b"),)), ours, theirs).conflicts == []


# ancestors

CHAIN = {"a": None, "b": "a", "c": "b", "d": "c", "f": "b", "x": None, "p": "q", "q": "p"}


def test_lca_and_walks():
    assert lineage.lca(CHAIN, "d", "f") == "b" and lineage.lca(CHAIN, "c", "d") == "c" and lineage.lca(CHAIN, "d", "x") is None and lineage.lca(CHAIN, "p", "a") is None
    assert lineage.walk(CHAIN, "d") == ["d", "c", "b", "a"] and lineage.walk(CHAIN, "d", 2) == ["d", "c"] and lineage.walk(CHAIN, "p") == ["p", "q"]


def test_rewind_targets():
    assert lineage.rewind_target(CHAIN, "d", merges_back=2) == ("b", ["d", "c"]) and lineage.rewind_target(CHAIN, "d", commit="a") == ("a", ["d", "c", "b"])
    for args, code in (({"commit": "f"}, "not_ancestor"), ({"merges_back": 0}, "invalid_merges_back"), ({"merges_back": 4}, "past_root"), ({"commit": "d"}, "already_at_head"), ({}, "one_of_commit_or_merges_back")):
        with pytest.raises(lineage.RewindError) as e:
            lineage.rewind_target(CHAIN, "d", **args)
        assert e.value.code == code


# plans


def test_plan_of_a_retype():
    ops, _ = parse_ddl("ALTER TABLE txns ALTER amount_cents TYPE numeric(12,2) USING amount_cents / 100.0", BASE)
    steps = compile_plan(ops, BASE, 4)
    assert [s.kind for s in steps] == ["expand", "sync", "backfill", "ddl", "validate", "ddl", "ddl", "cutover", "contract"]
    assert steps[0].args["backup"] == "amount_cents__old_4" and steps[0].args["shadow"] == "amount_cents__new" and steps[0].args["key"] == "id"
    assert steps[-1].manual and {s.kind for s in steps} <= set(STEPS) and [s.seq for s in steps] == list(range(9))
    assert "100" in steps[0].args["expression"]


@pytest.mark.parametrize(("ddl", "want"), [
    ("ALTER TABLE txns ALTER memo TYPE text", ["ddl"]), ("ALTER TABLE txns ADD COLUMN n int DEFAULT 3", ["ddl"]), ("ALTER TABLE txns DROP COLUMN memo", ["contract"]), ("DROP TABLE txns", ["contract"]),
    ("ALTER TABLE txns RENAME memo TO note", ["ddl"]), ("ALTER TABLE txns ADD CHECK (amount_cents > 0)", ["ddl", "validate"]), ("ALTER TABLE txns ADD UNIQUE (memo)", ["index_concurrent", "ddl"]),
    ("CREATE INDEX ON txns (memo)", ["index_concurrent"]), ("DROP INDEX txns_memo_idx", ["ddl"]), ("ALTER TABLE txns ALTER amount_cents DROP NOT NULL", ["ddl"]), ("ALTER TABLE txns ALTER memo SET NOT NULL", ["ddl", "validate", "ddl", "ddl"]),
    ("CREATE TABLE n (id bigint PRIMARY KEY, x int UNIQUE CHECK (x > 0))", ["ddl", "ddl", "validate", "index_concurrent", "ddl"]),
])
def test_plan_kinds(ddl, want):
    ops = parse_ddl(ddl, BASE)[0]
    if ddl.endswith("TYPE text"):
        ops = [Op("retype_column", "txns", "memo", TEXT, old="pg_catalog.varchar(4)")]
    assert [s.kind for s in compile_plan(ops, BASE, 1)] == want


def test_renamed_and_retyped_nullable_column_stays_nullable():
    ops = diff(BASE, parse_ddl("ALTER TABLE txns RENAME memo TO n; ALTER TABLE txns ALTER n TYPE bigint", BASE)[1])
    assert [o.kind for o in ops] == ["drop_index", "rename_column", "retype_column", "add_index"]
    assert "validate" not in [s.kind for s in compile_plan(ops, BASE, 1)]


def test_key_choice():
    assert key_of(BASE, "txns") == "id" and key_of(ir(table("t", "b", "a")), "t") == "a"
    with pytest.raises(ValueError, match="no column"):
        key_of(BASE, "nowhere")


# DDL


def test_statements_see_what_came_before():
    ops, after = parse_ddl("ALTER TABLE txns ADD COLUMN a int; ALTER TABLE txns RENAME COLUMN a TO b; ALTER TABLE txns ALTER b SET DEFAULT 5 -- done\n;", BASE)
    assert kinds(ops) == [("add_column", "a"), ("rename_column", "a"), ("set_default", "b")] and after.table("txns").column("b").default == "5"


@pytest.mark.parametrize(("sql", "said"), [
    ("SELECT 1", "only schema DDL"), ("INSERT INTO txns VALUES (1)", "only schema DDL"), ("ALTER TABLE s.txns DROP COLUMN memo", "schema-qualified"), ("CREATE INDEX CONCURRENTLY i ON txns (memo)", "CONCURRENTLY"),
    ("DROP INDEX nope", "no index"), ("CREATE INDEX i ON txns (lower(memo))", "list of columns"), ("ALTER TABLE txns ALTER nope TYPE int", "no column"), ("ALTER TABLE txns ADD COLUMN x varchar(n)", "whole numbers"),
    ("ALTER TABLE nope DROP COLUMN x", "no table"), ("CREATE INDEX i ON txns USING hash (memo)", "btree"), ("CREATE TABLE t (id int", "expected"), ("ALTER TABLE txns ADD CHECK (id IN (SELECT 1))", "SELECT"), ("ALTER TABLE txns ADD COLUMN memo text", "exists"),
    ("CREATE TABLE txns (id int)", "exists"), ("ALTER TABLE txns RENAME memo TO id", "exists"), ("ALTER TABLE txns DROP COLUMN memo extra", "can't read"), ("DROP TABLE a.b", "schema-qualified"),
])
def test_rejections(sql, said):
    with pytest.raises(DDLError, match=said):
        parse_ddl(sql, BASE)


@pytest.mark.parametrize(("text", "want"), [
    ("a + b * 2", "(a + (b * 2))"), ("(a + b) * 2", "((a + b) * 2)"), ("NOT (a = 1 OR b <> 2)", "(NOT ((a = 1) OR (b <> 2)))"), ("a ~ '^x' AND b !~ 'y'", "(rlike(a, '^x') AND (NOT rlike(b, 'y')))"),
    ("a::bigint > 3", "(CAST(a AS bigint) > 3)"), ("a IS NOT NULL", "(a IS NOT NULL)"), ("a IN ('x', 'it''s')", "(a IN ('x', 'it''s'))"), ("a NOT LIKE 'b%'", "(a NOT LIKE 'b%')"), ("a BETWEEN 1 AND 2 AND b", "((a BETWEEN 1 AND 2) AND b)"),
    ("coalesce(a, -1) >= 0", "(coalesce(a, (- 1)) >= 0)"), ('"Odd" || \'x\'', "(`Odd` || 'x')"), ("a IS DISTINCT FROM b", "(NOT (a <=> b))"), ("CAST(a AS varchar(3)) = 'x'", "(CAST(a AS string) = 'x')"),
])
def test_expressions(text, want):
    ops, _ = parse_ddl(f"ALTER TABLE txns ADD CONSTRAINT k CHECK ({text})", BASE)
    assert ops[0].to.expression == want


def test_constraints_follow_their_columns():
    _, after = parse_ddl("ALTER TABLE txns ADD CONSTRAINT k CHECK (memo <> 'memo' AND memo_id > 0), RENAME memo TO note", SchemaIR((TXNS.with_column(Column("memo_id", INT8)),)))
    t = after.table("txns")
    assert t.constraints[0].expression == "((note <> 'memo') AND (memo_id > 0))" and t.indexes[0].columns == ("note",)
    _, after = parse_ddl("ALTER TABLE txns DROP COLUMN note", after)
    assert [c.name for c in after.table("txns").constraints] == ["txns_pkey"] and after.table("txns").indexes == ()


def test_create_table_details():
    t = parse_ddl("CREATE TABLE o (a bigint, b varchar(4) NOT NULL DEFAULT 'x', c int REFERENCES txns (id), PRIMARY KEY (a), CONSTRAINT p CHECK (c > 0), FOREIGN KEY (a, b) REFERENCES txns (id, memo) NOT VALID)", BASE)[1].table("o")
    assert [(c.name, c.nullable, c.ordinal) for c in t.in_order()] == [("a", False, 1), ("b", False, 2), ("c", True, 3)]
    assert {c.name: (c.kind, c.validated) for c in t.constraints} == {"o_pkey": ("primary", True), "p": ("check", True), "o_c_fkey": ("foreign", True), "o_a_b_fkey": ("foreign", False)}


# overlays as plans


def test_view_plans_and_remaps():
    branch = parse_ddl("DROP TABLE accounts; CREATE TABLE own (id int)", BASE)[1]
    assert plan_views(branch, BASE) == {"views": ["txns"], "own": ["own"], "dropped": ["accounts"]}
    assert referenced(TXNS) == {"id", "amount_cents", "memo"}
    retyped = TXNS.with_column(Column("amount_cents", TEXT, False, None, 2))
    same, stale = remap(TXNS, TXNS, retyped)
    assert stale and same.column("amount_cents").physical == "amount_cents"
    kept, stale = remap(TXNS, TXNS, retyped.with_column(Column("amount_cents__old_3", INT8)))
    assert not stale and kept.column("amount_cents").physical == "amount_cents__old_3"

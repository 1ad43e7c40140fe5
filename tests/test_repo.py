"""A repository over small tables: branches, probes, migrations, writes, reverts, contracts, rewinds."""

import json

import pytest
from pyspark.sql import functions as F

from tablegraft.api import Conflict, NotFound, Repo
from tablegraft.functions.names import InvalidIdentifier
from tablegraft.ir import hash_ir
from tablegraft.operators import backfill, probes
from tablegraft.plans.runner import Locked, MigrationError, lock
from tablegraft.sources import catalog, seed
from tablegraft.sources.store import Busy, Store


@pytest.fixture
def repo(spark, tmp_path):
    spark.range(1, 41).selectExpr("id", "id * 100 as amount_cents", "if(id % 10 = 0, null, concat('memo ', id)) as memo").write.parquet(str(tmp_path / "txns"))
    spark.createDataFrame([(1, "a@x"), (2, "a@x"), (3, "b@x"), (4, None), (5, None)], "id long, email string").write.parquet(str(tmp_path / "accounts"))
    out = Repo(spark, str(tmp_path / "repo"), lambda: backfill.Controller(size=15))
    out.init({"txns": str(tmp_path / "txns"), "accounts": str(tmp_path / "accounts")}, {"txns": ["id"], "accounts": ["id"]})
    return out


def change(repo, ddl, name="work"):
    repo.create_branch(name)
    repo.ddl(name, ddl)
    repo.commit(name, ddl[:20])
    return repo.create_merge(name)["id"]


def values(repo, table, *columns, branch="main"):
    return sorted((tuple(r) for r in repo.table(table, branch).select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])


def test_init_is_idempotent(repo, tmp_path):
    head = repo.branches()[0]["head"]
    assert repo.init({"txns": str(tmp_path / "txns")}) == head and repo.get_commit(head)["message"] == "seeded catalog"
    assert repo.health()["ok"] and [b["name"] for b in repo.branches()] == ["main"]


def test_branch_reads_without_copying(repo):
    before = set(repo.store.files.names("data"))
    repo.create_branch("feature-x")
    assert set(repo.store.files.names("data")) == before and repo.stats("feature-x")["bytes"] == 0
    repo.ddl("feature-x", "ALTER TABLE txns RENAME memo TO note, ADD COLUMN kind text DEFAULT 'card'; ALTER TABLE txns ALTER amount_cents TYPE text")
    assert repo.rows("txns", "feature-x", 1) == {"columns": ["id", "amount_cents", "note", "kind"], "rows": [{"id": 1, "amount_cents": "100", "note": "memo 1", "kind": "card"}], "count": 40}
    assert repo.spark.sql("SELECT count(*) AS n FROM br_feature_x__txns WHERE note IS NULL").first().n == 4
    assert repo.rows("txns")["columns"] == ["id", "amount_cents", "memo"]
    plan = repo.table("txns", "feature-x").where("id = 7").select("note")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan and "amount_cents" not in plan.split("ReadSchema")[1]


def test_branch_rules(repo):
    repo.create_branch("a")
    for call, error in (
        (lambda: repo.create_branch("a"), Conflict), (lambda: repo.create_branch("b", "a"), Conflict), (lambda: repo.create_branch("Bad"), InvalidIdentifier), (lambda: repo.delete_branch("main"), Conflict),
        (lambda: repo.ddl("main", "DROP TABLE txns"), Conflict), (lambda: repo.table("nope"), NotFound), (lambda: repo.schema("nope"), NotFound), (lambda: repo.rows("txns", "a", 101), ValueError), (lambda: repo.create_merge("a", "b"), Conflict),
    ):
        with pytest.raises(error):
            call()
    repo.delete_branch("a")
    assert [b["name"] for b in repo.branches()] == ["main"]


def test_commits_are_content_addressed(repo):
    head = repo.create_branch("a")["head"]
    assert repo.commit("a", "nothing") == head and not repo.is_dirty("a")
    repo.ddl("a", "ALTER TABLE txns DROP COLUMN memo")
    assert repo.is_dirty("a")
    first = repo.commit("a", "drop")
    assert first == hash_ir(repo.schema("a")) and repo.get_commit(first)["parent"] == head and [c["message"] for c in repo.log("a")] == ["drop"]
    with pytest.raises(NotFound):
        repo.get_commit("0" * 64)


def test_own_tables(repo):
    repo.create_branch("a")
    repo.ddl("a", "CREATE TABLE notes (id bigint PRIMARY KEY, body text)")
    repo.ddl("a", "ALTER TABLE notes ADD COLUMN at date")
    assert repo.table("notes", "a").columns == ["id", "body", "at"] and repo.table("notes", "a").count() == 0
    repo.commit("a", "notes")
    repo.apply_merge(repo.create_merge("a")["id"])
    assert repo.table("notes").columns == ["id", "body", "at"]


def test_diff_and_renames(repo):
    repo.create_branch("a")
    repo.ddl("a", "ALTER TABLE txns DROP COLUMN memo; ALTER TABLE txns ADD COLUMN memos text")
    out = repo.diff("main", "a")
    assert [o.kind for o in out["ops"]] == ["drop_column", "add_column"] and [(r.old, r.new) for r in out["renames"]] == [("memo", "memos")]


def test_validation(repo, spark):
    repo.create_branch("a")
    repo.ddl("a", """ALTER TABLE txns ALTER memo SET NOT NULL; ALTER TABLE txns ALTER memo TYPE int; ALTER TABLE accounts ADD UNIQUE (email);
        ALTER TABLE txns ADD CHECK (amount_cents > 300); ALTER TABLE accounts ALTER email TYPE varchar(2)""")
    found = {(f.op.kind, f.op.table, f.message.startswith("backfill")): f for f in repo.validate("a")}
    assert found["set_nullable", "txns", False].count == 4 and found["add_constraint", "accounts", False].count == 1 and found["add_constraint", "accounts", False].samples == [{"email": "a@x", "n": 2}]
    assert found["retype_column", "txns", False].count == 36 and len(found["retype_column", "txns", False].samples) == 10
    assert found["add_constraint", "txns", False].count == 3 and found["retype_column", "accounts", False].message == "blocked: 3 rows exceed varchar(2)"
    assert found["retype_column", "txns", True].message == "backfill ≈ 0 m 00 s, lock window ≈ 12 ms"
    with pytest.raises(ValueError, match="not a row expression"):
        probes.check_text("x > (select 1)")
    assert [r.x for r in probes.orphans(spark.createDataFrame([(1,), (2,), (None,)], "x int"), ["x"], spark.range(2), ["id"]).collect()] == [2]


def test_retype_keeps_rows_and_reverts(repo):
    before, head = values(repo, "txns", "id", "amount_cents", "memo"), repo.branches()[0]["head"]
    n = change(repo, "ALTER TABLE txns ALTER amount_cents TYPE numeric(12,2) USING amount_cents / 100.0; ALTER TABLE txns RENAME memo TO note")
    out = repo.apply_merge(n)
    assert out["state"] == "merged" and [s["state"] for s in out["steps"]][-1] == "skipped"
    assert [float(a) for _, a in values(repo, "txns", "id", "amount_cents")] == [float(k) for k in range(1, 41)]
    assert repo.table("txns").columns == ["id", "amount_cents", "note"] and not repo.is_dirty("work")
    assert values(repo, "txns", "note", branch="work") == values(repo, "txns", "note")
    kinds = [json.loads(r.payload).get("kind") for r in repo.events.history(n).collect()]
    assert kinds.count("backfill") >= 3 + 2
    repo.revert_merge(n)
    assert values(repo, "txns", "id", "amount_cents", "memo") == before and repo.branches()[0]["head"] == head == hash_ir(repo.schema("main"))
    with pytest.raises(MigrationError, match="reverted"):
        repo.contract_merge(n)


def test_contract_closes_revert(repo):
    n = change(repo, "ALTER TABLE txns ALTER amount_cents TYPE text; ALTER TABLE txns DROP COLUMN memo")
    repo.create_branch("reader")
    repo.commit("reader", "as it was")
    repo.apply_merge(n)
    assert repo._branch("reader")["stale"] is None
    assert values(repo, "txns", "amount_cents", branch="reader")[0] == (100,)
    with pytest.raises(MigrationError, match="reader"):
        repo.contract_merge(n)
    repo.delete_branch("reader")
    assert repo.contract_merge(n)["state"] == "contracted"
    with pytest.raises(MigrationError, match="contracted"):
        repo.revert_merge(n)


def test_stale_branches(repo):
    repo.create_branch("reader")
    n = change(repo, "ALTER TABLE txns RENAME memo TO note")
    repo.apply_merge(n)
    assert "memo" in repo._branch("reader")["stale"]
    with pytest.raises(Conflict, match="stale"):
        repo.table("txns", "reader")


def test_failed_validation_keeps_main(repo):
    n = change(repo, "ALTER TABLE txns ALTER memo SET NOT NULL")
    with pytest.raises(MigrationError, match="4 rows"):
        repo.apply_merge(n)
    m = repo.get_merge(n)
    assert m["state"] == "failed" and [s["state"] for s in m["steps"]] == ["done", "failed", "pending", "pending"]
    assert repo.schema("main").table("txns").column("memo").nullable
    repo.write("txns", repo.table("txns").where("memo is null").withColumn("memo", F.lit("filled")))
    assert repo.apply_merge(n)["state"] == "merged" and not repo.schema("main").table("txns").column("memo").nullable


@pytest.mark.parametrize("ddl", ["ALTER TABLE accounts ADD UNIQUE (email)", "ALTER TABLE txns ADD CHECK (amount_cents < 100)", "ALTER TABLE txns ADD FOREIGN KEY (id) REFERENCES accounts (id)", "CREATE UNIQUE INDEX ON accounts (email)"])
def test_constraints_are_probed(repo, ddl):
    with pytest.raises(MigrationError):
        repo.apply_merge(change(repo, ddl))


def test_constraints_that_hold(repo):
    repo.apply_merge(change(repo, "ALTER TABLE accounts ADD FOREIGN KEY (id) REFERENCES txns (id); ALTER TABLE txns ADD UNIQUE (amount_cents); ALTER TABLE txns ADD CHECK (amount_cents > 0); CREATE INDEX ON txns (memo)"))
    t = repo.schema("main").table("txns")
    assert {c.kind for c in t.constraints} == {"primary", "unique", "check"} and all(c.validated for c in t.constraints) and t.indexes[0].columns == ("memo",)


def racing(repo, sync):
    """A row written between the backfill and the cutover."""
    n = change(repo, "ALTER TABLE txns ALTER amount_cents TYPE text")
    done = repo.runner.do_backfill

    def race(m, step):
        done(m, step)
        repo.write("txns", repo.table("txns").where("id = 7").withColumn("amount_cents", F.lit(5).cast("long")))

    repo.runner.do_backfill = race
    if not sync:
        repo.runner.do_sync = lambda m, step: None
    repo.apply_merge(n)
    return values(repo, "txns", "id", "amount_cents")[6]


def test_sync_keeps_racing_writes(repo):
    assert racing(repo, True) == (7, "5")


def test_without_sync_they_are_lost(repo):
    assert racing(repo, False) == (7, None)


def test_resume_from_the_cursor(repo):
    n = change(repo, "ALTER TABLE txns ALTER amount_cents TYPE text")
    real, ranges = backfill.run, []

    def dying(*args, **kwargs):
        progress = args[7]

        def tell(e):
            ranges.append(e["cursor"])
            progress(e)
            if len(ranges) == 1:
                raise RuntimeError("executor lost")

        return real(*args[:7], tell, *args[8:], **kwargs)

    backfill.run = dying
    try:
        with pytest.raises(RuntimeError, match="lost"):
            repo.apply_merge(n)
        assert repo.get_merge(n)["steps"][2]["cursor"] == ranges[0] and repo.get_merge(n)["state"] == "failed"
        repo.apply_merge(n)
    finally:
        backfill.run = real
    assert ranges == sorted(set(ranges)) and values(repo, "txns", "amount_cents", "id")[0] == ("100", 1) and repo.table("txns").where("amount_cents is null").count() == 0


def test_volatile_add_and_defaults(repo):
    repo.apply_merge(change(repo, "ALTER TABLE txns ADD COLUMN token text NOT NULL DEFAULT uuid(), ADD COLUMN flag int DEFAULT 3"))
    rows = repo.table("txns").select("token", "flag").collect()
    assert len({r.token for r in rows}) == 40 and {r.flag for r in rows} == {3}
    assert {r.token for r in rows} == {r.token for r in repo.table("txns").collect()}


def test_writes_and_reads(repo):
    extra = repo.spark.createDataFrame([(7, 1, "x"), (99, 2, None)], "id long, amount_cents long, memo string")
    repo.write("txns", extra)
    repo.write("txns", extra.where("id = 7").withColumn("memo", F.lit("last")))
    assert repo.table("txns").count() == 41 and values(repo, "txns", "id", "memo")[6] == (7, "last")


def test_lock_and_busy(repo):
    n = change(repo, "ALTER TABLE txns DROP COLUMN memo")
    with lock(repo.store), pytest.raises(Locked):
        repo.apply_merge(n)
    store, waits = Store(repo.spark, repo.store.files.root), []
    store.files.create = lambda *a: False
    with pytest.raises(Busy):
        store.change(lambda s: None, pause=waits.append)
    assert len(waits) == 14 and all(0.5 * min(0.1 * 2**i, 5) <= w < 1.5 * min(0.1 * 2**i, 5) for i, w in enumerate(waits))


def test_crashed_run_can_be_applied_again(repo):
    n = change(repo, "ALTER TABLE txns ALTER amount_cents TYPE text")
    repo.runner._set(n, "running")
    repo.store.files.create("lock", "a process that died")
    with pytest.raises(Locked):
        repo.apply_merge(n)
    repo.break_lock()
    assert repo.apply_merge(n)["state"] == "merged"
    with pytest.raises(MigrationError, match="merged"):
        repo.apply_merge(n)


def test_rewinds(repo):
    before, heads = values(repo, "txns", "id", "amount_cents", "memo"), [repo.branches()[0]["head"]]
    for ddl in ("ALTER TABLE txns ALTER amount_cents TYPE text", "ALTER TABLE txns RENAME memo TO note"):
        if "work" in [b["name"] for b in repo.branches()]:
            repo.ddl("work", ddl)
            repo.commit("work", ddl)
            n = repo.create_merge("work")["id"]
        else:
            n = change(repo, ddl)
        repo.apply_merge(n)
        heads.append(repo.branches()[0]["head"])
    r = repo.create_rewind(merges_back=2)
    assert r["to"] == heads[0] and r["undone"] == [heads[2], heads[1]] and r["kind"] == "rewind"
    repo.apply_merge(r["id"])
    assert values(repo, "txns", "id", "amount_cents", "memo") == before and hash_ir(repo.schema("main")) == heads[0]
    assert repo.get_merge(1)["state"] == "reverted"
    repo.ddl("work", "ALTER TABLE txns ADD COLUMN x int")
    with pytest.raises(Conflict, match="work"):
        repo.create_rewind(merges_back=1)


def test_rewind_to_a_merge(repo):
    """A merged state is the branch's commit; its columns' storage is known all the same."""
    repo.apply_merge(change(repo, "ALTER TABLE txns RENAME memo TO note"))
    target = repo.branches()[0]["head"]
    before = values(repo, "txns", "id", "note")
    repo.ddl("work", "ALTER TABLE txns RENAME note TO remark; ALTER TABLE txns ALTER amount_cents TYPE text")
    repo.commit("work", "again")
    repo.apply_merge(repo.create_merge("work")["id"])
    repo.apply_merge(repo.create_rewind(commit=target)["id"])
    assert values(repo, "txns", "id", "note") == before and repo.branches()[0]["head"] == target == hash_ir(repo.schema("main"))


def test_rewind_takes_back_dropped_columns_and_tables(repo):
    before = values(repo, "txns", "id", "memo"), values(repo, "accounts", "id", "email")
    repo.apply_merge(change(repo, "ALTER TABLE txns DROP COLUMN memo; DROP TABLE accounts"))
    assert repo.table("txns").columns == ["id", "amount_cents"]
    repo.apply_merge(repo.create_rewind(merges_back=1)["id"])
    assert (values(repo, "txns", "id", "memo"), values(repo, "accounts", "id", "email")) == before


def test_integrate(repo):
    for name, ddl in (("a", "ALTER TABLE txns ADD COLUMN one int"), ("b", "ALTER TABLE txns ADD COLUMN two int")):
        repo.create_branch(name)
        repo.ddl(name, ddl)
        repo.commit(name, name)
    head = repo.branches()[0]["head"]
    assert [o.target for o in repo.integrate("b", "a", preview=True).ops] == ["two"] and "two" not in repo.table("txns", "a").columns
    repo.integrate("b", "a")
    assert repo.table("txns", "a").columns[-2:] == ["one", "two"] and repo.branches()[0]["head"] == head and "two" not in repo.table("txns").columns
    repo.ddl("b", "ALTER TABLE txns ALTER amount_cents TYPE text")
    repo.commit("b", "t")
    repo.ddl("a", "ALTER TABLE txns ALTER amount_cents TYPE int")
    repo.commit("a", "i")
    with pytest.raises(Conflict) as e:
        repo.integrate("b", "a")
    assert [c.path for c in e.value.conflicts] == ["txns.amount_cents"]


def test_conflicting_and_dirty_merges(repo):
    for name, kind in (("a", "text"), ("b", "numeric(9,1)")):
        repo.create_branch(name)
        repo.ddl(name, f"ALTER TABLE txns ALTER amount_cents TYPE {kind}")
    with pytest.raises(Conflict, match="uncommitted"):
        repo.create_merge("a")
    for name in ("a", "b"):
        repo.commit(name, name)
    repo.apply_merge(repo.create_merge("a")["id"])
    with pytest.raises(Conflict) as e:
        repo.create_merge("b")
    assert e.value.conflicts[0].path == "txns.amount_cents"


def test_reset(repo):
    before = values(repo, "txns", "id", "amount_cents", "memo")
    repo.apply_merge(change(repo, "ALTER TABLE txns ALTER amount_cents TYPE text; DROP TABLE accounts"))
    repo.reset()
    assert values(repo, "txns", "id", "amount_cents", "memo") == before and repo.table("accounts").count() == 5 and [b["name"] for b in repo.branches()] == ["main"] and len(repo.store.files.names("commits")) == 1


def test_batches(spark, tmp_path):
    c = backfill.Controller()
    assert [c.after(1500), c.after(100), c.after(500)] == [5000, 7500, 7500]
    for _ in range(20):
        c.after(2000)
    assert c.size == 100
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1_000_000, "c"), (None, "d")], "k long, v string")
    cuts = backfill.quantile_cuts(rows, "k", 2)
    out = backfill.run(rows, "k", "w", F.upper("v"), str(tmp_path / "v"), cuts=cuts)
    assert out["batches"] == len(cuts) <= 2 and sorted(r.w for r in spark.read.parquet(str(tmp_path / "v/*")).collect()) == ["A", "B", "C", "D"]
    assert backfill.run(rows.where("false"), "k", "w", F.upper("v"), str(tmp_path / "e")) == {"rows": 0, "total": 0, "batches": 0, "cursor": None}
    assert list(backfill.by_value(1, 10, backfill.Controller(size=4), 4)) == [(4, 8), (8, 10)]


def test_seed(spark, tmp_path):
    sizes = dict.fromkeys(seed.MAKERS, 1000)
    paths = seed.seed(spark, str(tmp_path), sizes)
    again = seed.seed(spark, str(tmp_path), sizes, missing_only=True)
    assert paths == again and spark.read.parquet(paths["txns"]).where("memo is null").count() == 20
    assert catalog.table_counts({k: spark.read.parquet(p) for k, p in paths.items()}).agg(F.sum("n_rows")).first()[0] == 5000


def test_ranges_of_a_backfill(spark, tmp_path):
    rows = spark.range(0, 1000).selectExpr("id * id as k", "id as v")
    seen = []
    out = backfill.run(rows, "k", "w", F.col("v") + 1, str(tmp_path / "r"), progress=seen.append, a_range=100)
    assert out["batches"] == len(seen) == 10 and seen[-1]["cursor"] == 999 * 999 and [e["cursor"] for e in seen] == sorted(e["cursor"] for e in seen)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "r")).groupBy("batch").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 200
    assert backfill.ranges_for(10**12) == backfill.MOST_RANGES and backfill.ranges_for(5) == 1


def test_compaction_keeps_rows_and_frees_files(repo):
    for k in range(3):
        repo.write("txns", repo.table("txns").where(f"id <= {10 * (k + 1)}").withColumn("memo", F.lit(f"m{k}")))
    before, paths = values(repo, "txns", "id", "memo"), repo.store.files.names("data/txns")
    assert len(paths) == 3 and repo.compact("txns") and values(repo, "txns", "id", "memo") == before
    assert len(repo.store.files.names("data/txns")) == 1 and repo.stats()["tables"]["txns"]["rows"] == 40 and not repo.compact("accounts")
    n = change(repo, "ALTER TABLE txns ADD COLUMN flag int DEFAULT 3")
    repo.apply_merge(n)
    repo.write("txns", repo.table("txns").where("id = 2").withColumn("flag", F.lit(9)))
    want = values(repo, "txns", "id", "flag")
    assert want[0] == (1, 3) and want[1] == (2, 9) and repo.compact("txns") and values(repo, "txns", "id", "flag") == want
    repo.ddl("work", "ALTER TABLE txns ALTER amount_cents TYPE text")
    repo.commit("work", "text")
    repo.apply_merge(repo.create_merge("work")["id"])
    assert values(repo, "txns", "id", "flag") == want


def test_old_states_are_pruned(spark, tmp_path, monkeypatch):
    from tablegraft.sources import store as module

    monkeypatch.setattr(module, "KEPT_STATES", 5)
    store = Store(spark, str(tmp_path / "s"))
    for k in range(30):
        store.change(lambda s: s.update(next_merge=s["next_merge"] + 1))
    assert store.state()["next_merge"] == 31 and len(store.files.names("state")) <= 11
    n, _ = store.latest()
    late, real = Store(spark, str(tmp_path / "s")), store.latest
    late.latest = lambda calls=[]: calls.append(1) or ((0, {"next_merge": 0, "tables": {}}) if len(calls) == 1 else real())  # noqa: B006
    late.change(lambda s: s.update(next_merge=s["next_merge"] + 1))
    assert store.state()["next_merge"] == 32 and store.latest()[0] == n + 1


def test_dropped_column_of_a_new_row_cannot_be_reverted(repo):
    repo.apply_merge(change(repo, "ALTER TABLE txns ALTER memo SET DEFAULT 'x'"))
    repo.ddl("work", "ALTER TABLE txns DROP COLUMN memo")
    repo.commit("work", "drop")
    n = repo.create_merge("work")["id"]
    repo.apply_merge(n)
    repo.write("txns", repo.spark.createDataFrame([(7, 1), (99, 2)], "id long, amount_cents long"))
    repo.revert_merge(n)
    assert dict(values(repo, "txns", "id", "memo"))[7] == "memo 7" and dict(values(repo, "txns", "id", "memo"))[99] is None

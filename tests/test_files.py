"""The same small files through the local file system and through Hadoop's."""

import pytest

from tablegraft.api import Repo
from tablegraft.sources.files import Files


@pytest.mark.parametrize("local", [True, False])
def test_files(spark, tmp_path, local):
    files = Files(spark, f"file://{tmp_path}/r")
    if not local:
        files.local = None
    assert files.read("a/b.json") is None and files.names("a") == []
    assert files.create("a/b.json", "é") and not files.create("a/b.json", "other") and files.read("a/b.json") == "é"
    assert files.create("a/c.json", "") and files.names("a") == ["b.json", "c.json"] and files.size(files.path("a")) == 2
    files.delete("a/b.json")
    files.delete("nothing")
    assert files.names("a") == ["c.json"]


def test_repository_through_hadoop(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 as twice").write.parquet(f"{tmp_path}/t")
    repo = Repo(spark, f"file://{tmp_path}/repo")
    repo.store.files.local = repo.events.files.local = None
    repo.init({"t": f"{tmp_path}/t"}, {"t": ["id"]})
    repo.create_branch("b")
    repo.ddl("b", "ALTER TABLE t ALTER twice TYPE text")
    repo.commit("b", "text")
    repo.apply_merge(repo.create_merge("b")["id"])
    assert sorted(r.twice for r in repo.table("t").collect()) == ["0", "2", "4", "6", "8"]
    assert repo.stats()["rows"] == 5 and repo.stats()["bytes"] > 0 and [c["message"] for c in repo.log("main")] == ["text", "seeded catalog"]

"""Walks over parent chains and dependency graphs, as joins that double the distance walked and as recursive SQL, and the same over
commits held in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

LIMIT = 500
DRIVER_ROWS = 200_000


def ancestors(commits: DataFrame, head: str, limit: int = LIMIT, driver_rows: int = DRIVER_ROWS) -> DataFrame:
    """(id, depth) from head to root over (id, parent); stops at the root, a missing parent, a cycle or the limit. Up to
    `driver_rows` commits are walked on the driver; more of them by joins, each of which doubles the distance walked."""
    spark = commits.sparkSession
    known = commits.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"))
    rows = known.limit(driver_rows + 1).toArrow()
    if rows.num_rows <= driver_rows:
        parents = dict(zip(rows.column("id").to_pylist(), rows.column("parent").to_pylist(), strict=True))
        return spark.createDataFrame(list(enumerate(walk(parents, head, limit))), "depth int, id string").select("id", "depth")
    return _doubled(known, head, limit)


def _doubled(commits: DataFrame, head: str, limit: int) -> DataFrame:
    here = commits.select(F.col("id").alias("parent"))
    up = written(commits.join(here, "parent", "left_semi").select("id", F.col("parent").alias("to")), "up")
    walked = written(commits.where(F.col("id") == head).select("id", F.lit(0).alias("depth")), "walked")
    n, step = walked.count(), 1
    while step < limit:
        further = walked.join(up, "id").select(F.col("to").alias("id"), (F.col("depth") + step).alias("depth"))
        walked = written(walked.unionByName(further).groupBy("id").agg(F.min("depth").alias("depth")), "walked")
        if (now := walked.count()) == n:  # nothing new: the root, or a cycle all round
            break
        n, step = now, 2 * step
        a, b = up.alias("a"), up.alias("b")
        up = written(a.join(b, F.col("a.to") == F.col("b.id")).select("a.id", "b.to"), "up")
    return walked.where(F.col("depth") < limit)


def _whole(commits: DataFrame) -> int:
    """A limit that no chain reaches."""
    return commits.count() + 1


def common_ancestor(commits: DataFrame, left: str, right: str, driver_rows: int = DRIVER_ROWS) -> DataFrame:
    """(id) of the first ancestor of right that is one of left's, however deep; no row if there is none."""
    limit = _whole(commits)
    a, b = ancestors(commits, left, limit, driver_rows).select("id"), ancestors(commits, right, limit, driver_rows)
    return b.join(a, "id", "left_semi").orderBy("depth").limit(1).select("id")


def dependents(edges: DataFrame, root: str, levels: int = 100) -> DataFrame:
    """(name, depth) of what depends on root over (dependent, on), with the greatest depth by which it is reached. A graph deeper
    than `levels` is an error of Spark's own recursion limit unless the session raises it."""
    return edges.sparkSession.sql(
        """WITH RECURSIVE walk(name, depth, seen) AS (
            SELECT dependent, 1, array(dependent) FROM {edges} WHERE `on` = :root
            UNION ALL
            SELECT e.dependent, w.depth + 1, array_append(w.seen, e.dependent)
            FROM walk w JOIN {edges} e ON e.`on` = w.name WHERE NOT array_contains(w.seen, e.dependent))
        SELECT name, CAST(max(depth) AS INT) AS depth FROM walk GROUP BY name""",
        args={"root": root}, edges=edges.select("dependent", "on"),
    )


def prunable(commits: DataFrame, keep: str, driver_rows: int = DRIVER_ROWS) -> DataFrame:
    """(id) of commits that are neither `keep` nor one of its ancestors, however deep."""
    return commits.select("id").join(ancestors(commits, keep, _whole(commits), driver_rows).select("id"), "id", "left_anti")


def seeded(tables, seed_tables: list[str]):
    """How many of the seed tables an array of names holds."""
    return F.size(F.filter(tables, lambda x: x.isin(seed_tables)))


def seed_commit(spark: SparkSession, commits: DataFrame, seed_tables: list[str]) -> DataFrame:
    """(id) of the newest commit messaged `seeded catalog`, else of the earliest with most seed tables; commits are
    (id, message, ts, tables array<string>)."""
    named = F.col("message") == "seeded catalog"
    return commits.orderBy(named.desc(), F.when(named, F.col("ts")).desc_nulls_last(), seeded("tables", seed_tables).desc(), "ts", "id").limit(1).select("id")


def walk(parents: dict[str, str | None], head: str | None, limit: int = LIMIT) -> list[str]:
    out: list[str] = []
    seen: set[str] = set()
    while head is not None and head in parents and head not in seen and len(out) < limit:
        out.append(head)
        seen.add(head)
        head = parents[head]
    return out


def lca(parents: dict[str, str | None], left: str, right: str) -> str | None:
    known = set(walk(parents, left, len(parents) + 1))
    return next((x for x in walk(parents, right, len(parents) + 1) if x in known), None)


class RewindError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def rewind_target(parents: dict[str, str | None], head: str, commit: str | None = None, merges_back: int | None = None) -> tuple[str, list[str]]:
    """(target, undone): undone are the commits above the target, newest first."""
    if (commit is None) == (merges_back is None):
        raise RewindError("one_of_commit_or_merges_back")
    chain = walk(parents, head)
    if commit is not None:
        if commit not in chain:
            raise RewindError("not_ancestor")
        k = chain.index(commit)
    else:
        if not isinstance(merges_back, int) or merges_back < 1:
            raise RewindError("invalid_merges_back")
        if merges_back >= len(chain):
            raise RewindError("past_root")
        k = merges_back
    if k == 0:
        raise RewindError("already_at_head")
    return chain[k], chain[:k]

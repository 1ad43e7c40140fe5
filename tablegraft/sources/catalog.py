"""What is there: tables by name, a page of rows, keys and commits as rows, and sizes from file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..ir import SchemaIR
from .store import Store


def page(rows: DataFrame, key: str | None = None, limit: int = 25) -> tuple[list[dict], int]:
    """The first 1 to 100 rows by key, in display order, and how many rows there are."""
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    ordered = rows.orderBy(quoted(key)) if key else rows
    return [r.asDict() for r in ordered.limit(limit).collect()], rows.count()


def stats(store: Store, tables: dict[str, dict]) -> dict:
    """Rows and bytes on disk by table. Rows without changes are counted by parquet footers, else with changed rows in place of
    those they replace; either way no row is counted twice."""
    out = {"rows": 0, "bytes": 0, "exact": True, "tables": {}}
    for name, t in sorted(tables.items()):
        paths = [*t["files"], *(c["path"] for c in t["changes"])]
        n = store.rows(t).count() if t["files"] or t["changes"] else 0
        size = sum(store.files.size(p.removesuffix("/*")) for p in paths)
        out["tables"][name] = {"rows": n, "bytes": size}
        out["rows"] += n
        out["bytes"] += size
    return out


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of several tables in one result."""
    out = None
    for name, df in sorted(frames.items()):
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def key_rows(spark: SparkSession, ir: SchemaIR) -> DataFrame:
    """(tbl, kind, name, ord, col): a row for each column of each constraint and index."""
    rows = [(t.name, c.kind, c.name, k, x) for t in ir.tables for c in t.constraints for k, x in enumerate(c.columns, 1)]
    rows += [(t.name, "index", i.name, k, x) for t in ir.tables for i in t.indexes for k, x in enumerate(i.columns, 1)]
    return spark.createDataFrame(rows, "tbl string, kind string, name string, ord int, col string")


def keys(rows: DataFrame) -> DataFrame:
    """(tbl, kind, name, columns, n): keys put together again in declared order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "col"))), lambda x: x["col"])
    return rows.groupBy("tbl", "kind", "name").agg(F.array_join(ordered, ",").alias("columns"), F.count("*").alias("n"))


def commit_tables(texts: DataFrame) -> DataFrame:
    """Adds `tables`, the names of the tables that a commit's JSON in `ir` lists."""
    found = F.from_json("ir", "struct<tables:array<struct<name:string>>>")["tables"]
    return texts.withColumn("tables", F.transform(found, lambda x: x["name"]))


def lost_merges(merges: DataFrame, kept: DataFrame) -> DataFrame:
    """(id) of merged merges that kept columns of which none is left: merges are (id, state, backups array<string>), kept (backup)."""
    merged = merges.where("state = 'merged'")
    backups = merged.select("id", F.explode("backups").alias("backup"))
    return merged.join(backups, "id", "left_semi").join(backups.join(kept, "backup", "left_semi"), "id", "left_anti").select("id")

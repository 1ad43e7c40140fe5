"""State of a repository: one JSON document for each version, immutable table versions in parquet, and changes in a log.

A version is published by creating its file, which fails if another writer took the number; a change is then made again upon
the newer state, with growing pauses. Readers keep the files of the version they began with, so they never wait.

A table is a list of parquet paths (`files`), a list of changes (rows that replace those of the same key, the last one wins; each
with the stored columns that it has) and columns that say which stored column backs them. `kept` are columns replaced or dropped
by a migration, until contract. `constants` are values of columns in rows whose file lacks them. Compaction writes files and
changes as one new version; what no state names any more is then deleted, but never files that were adopted.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.types import from_spark, spark_type
from ..ir import Column, Constraint, Index, SchemaIR, Table
from .files import Files

TRIES, FIRST_PAUSE, LONGEST_PAUSE = 15, 0.1, 5.0
KEPT_STATES = 200


class Busy(RuntimeError):
    """Another writer was first each time."""


class Unchanged(Exception):
    """Raised inside a change to leave the state as it is."""


def pause_before(attempt: int) -> float:
    """Seconds to wait after a failed attempt, numbered from 0, before chance makes it half to one and a half times as long."""
    return min(FIRST_PAUSE * 2**attempt, LONGEST_PAUSE)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def _numbers(self) -> list[int]:
        return [int(x[:-5]) for x in self.files.names("state") if x.endswith(".json")]

    def latest(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            return -1, {"tables": {}, "branches": {}, "merges": {}, "next_merge": 1, "seed": None, "own": {}}
        return max(numbers), json.loads(self.files.read(f"state/{max(numbers):012d}.json"))

    def state(self) -> dict:
        return self.latest()[1]

    def change(self, edit: Callable[[dict], Any], tries: int = TRIES, pause: Callable[[float], None] = time.sleep) -> Any:
        """Applies `edit` to the newest state and publishes it; returns what edit returns."""
        for i in range(tries):
            n, state = self.latest()
            try:
                out = edit(state)
            except Unchanged as e:
                return e.args[0] if e.args else None
            if self.files.create(f"state/{n + 1:012d}.json", json.dumps(state, sort_keys=True)):
                if n < 0 or self._fresh(n):
                    return out
            elif i + 1 < tries:
                pause(pause_before(i) * random.uniform(0.5, 1.5))
        raise Busy(f"gave up after {tries} tries")

    def _fresh(self, n: int) -> bool:
        """Prunes old states; False if state n, which a new one was made from, had been pruned itself, so that its successor's
        number was free only for that reason."""
        numbers = sorted(self._numbers())
        if n not in numbers:
            self.files.delete(f"state/{n + 1:012d}.json")
            return False
        if len(numbers) > 2 * KEPT_STATES:
            for k in numbers[:-KEPT_STATES]:
                self.files.delete(f"state/{k:012d}.json")
        return True

    # tables

    def types(self, t: dict) -> dict[str, T.DataType]:
        """Spark types by stored column: as in the files, or as wide as a column has become since."""
        out = {f.name: f.dataType for f in T.StructType.fromDDL(t["schema"]).fields}
        for c in [*t.get("kept", []), *t["columns"]]:
            if c["physical"] not in out or isinstance(out[c["physical"]], T.DecimalType):
                out[c["physical"]] = spark_type(c["type"])
        return out

    def rows(self, t: dict) -> DataFrame:
        """A table's stored rows with stored column names: files, with changed rows in place of those they replace."""
        in_files = {f.name for f in T.StructType.fromDDL(t["schema"]).fields}
        types, constants = self.types(t), {p: v for p, v in t.get("constants", {}).items() if p not in in_files}
        wanted = {c["physical"] for c in [*t["columns"], *t.get("kept", [])]} | set(t["key"])
        base = self.spark.read.schema(t["schema"]).parquet(*t["files"]) if t["files"] else self.spark.createDataFrame([], t["schema"])
        for p, value in constants.items():
            if p in wanted:
                base = base.withColumn(p, F.expr(value).cast(types[p]))
        if t.get("changes"):
            base = self._changed(t, base, {k: v for k, v in types.items() if k in base.columns}, constants)
        return base.select(*[quoted(c) for c in base.columns if c in wanted])

    def _changed(self, t: dict, base: DataFrame, types: dict[str, T.DataType], constants: dict[str, str]) -> DataFrame:
        schema = T.StructType([T.StructField(k, v) for k, v in types.items()])
        nth, order = "_nth", "_change"
        while {nth, order} & set(types):
            nth, order = nth + "_", order + "_"
        numbers = F.create_map(*[F.lit(x) for k, c in enumerate(t["changes"]) for x in (c["path"].rpartition("/")[2], k)])
        log = self.spark.read.schema(schema).parquet(*[c["path"] for c in t["changes"]])
        log = log.withColumn(order, F.element_at(numbers, F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]*$", 1)))
        for p, value in constants.items():  # rows written before the column was added
            lack = [k for k, c in enumerate(t["changes"]) if p not in c["columns"]]
            if p in types and lack:
                log = log.withColumn(p, F.when(F.col(order).isin(lack), F.expr(value).cast(types[p])).otherwise(F.col(quoted(p))))
        key = [quoted(k) for k in t["key"]]
        newest = Window.partitionBy(*key).orderBy(F.desc(order), F.xxhash64(*map(quoted, types)))
        log = log.withColumn(nth, F.row_number().over(newest)).where(F.col(nth) == 1).drop(nth, order)
        return base.join(log.select(*key), t["key"], "left_anti").unionByName(log)

    def table(self, t: dict) -> DataFrame:
        """The rows under the logical names, in order."""
        rows = self.rows(t)
        out = []
        for c in sorted(t["columns"], key=lambda c: (c["ordinal"], c["name"])):
            kind, value = spark_type(c["type"]), F.col(quoted(c["physical"]))
            out.append((value if rows.schema[c["physical"]].dataType == kind else value.cast(kind)).alias(c["name"]))
        return rows.select(*out)

    def adopt(self, path: str, key: list[str] | None = None) -> dict:
        """A table that points at given parquet files; its schema is introspected from them."""
        schema = self.spark.read.parquet(path).schema
        columns = []
        for k, f in enumerate(schema.fields, 1):
            columns.append({"name": f.name, "physical": f.name, "type": from_spark(f.dataType, (f.metadata or {}).get("pgType")), "nullable": not (key and f.name in key), "default": None, "ordinal": k})
        return {"files": [path], "schema": ddl_of(schema.fields), "columns": columns, "key": key or [columns[0]["name"]], "constraints": [], "indexes": [], "kept": [], "changes": [], "constants": {}, "version": 0}

    # housekeeping

    def owned(self, path: str) -> bool:
        return path.startswith(self.files.root + "/")

    def compact(self, name: str) -> bool:
        """Files and changes of a table as one new version without what is neither live nor kept; False if there was nothing to do or
        the table changed meanwhile in more than further writes."""
        t = self.state()["tables"][name]
        if t.get("pending") or not (t["changes"] or any(map(self.owned, t["files"]))):
            return False
        rows = self.rows(t)
        path = self.files.path("data", name, f"v{t['version'] + 1}-{uuid.uuid4().hex[:8]}")
        rows.write.parquet(path)
        before = self.state()

        def edit(state: dict) -> bool:
            now = state["tables"].get(name)
            same = now and all(now[k] == t[k] for k in ("files", "version", "columns", "kept", "constants", "key")) and now["changes"][: len(t["changes"])] == t["changes"]
            if not same or now.get("pending"):
                raise Unchanged(False)
            now.update(files=[path], schema=ddl_of(rows.schema.fields), changes=now["changes"][len(t["changes"]) :], version=now["version"] + 1)
            return True

        done = self.change(edit)
        if done:
            self.release(before)
        else:
            self.delete(path)
        return done

    def _paths(self, state: dict) -> set[str]:
        tables = [*state["tables"].values(), *state.get("dropped", {}).values(), *state["own"].values(), *((state.get("seed") or {}).get("tables", {}).values())]
        out = set()
        for t in tables:
            out |= {*t["files"], *(c["path"] for c in t["changes"])}
            out |= {t["pending"]["path"]} if t.get("pending") else set()
        return {p.removesuffix("/*") for p in out if self.owned(p)}

    def release(self, before: dict) -> list[str]:
        """Deletes what `before` named and the newest state doesn't. Readers that began before lose it too."""
        gone = sorted(self._paths(before) - self._paths(self.state()))
        for path in gone:
            self.delete(path)
        return gone

    def delete(self, path: str) -> None:
        self.files.delete(path.removeprefix(self.files.root + "/"))


def ddl_of(fields) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields)


def empty(table: Table) -> dict:
    """A table without rows."""
    columns = [{"name": c.name, "physical": c.physical, "type": c.type, "nullable": c.nullable, "default": c.default, "ordinal": c.ordinal} for c in table.in_order()]
    primary = next((x for x in table.constraints if x.kind == "primary"), None)
    out = {"files": [], "schema": ", ".join(f"{quoted(c['physical'])} {spark_type(c['type']).simpleString()}" for c in columns), "columns": columns, "key": list(primary.columns) if primary else [columns[0]["name"]], "kept": [], "changes": [], "constants": {}, "version": 0}
    return out | {"constraints": [x.canonical() for x in table.constraints], "indexes": [x.canonical() for x in table.indexes]}


def table_ir(name: str, t: dict) -> Table:
    def constraint(x: dict) -> Constraint:
        to = x["references"]
        return Constraint(x["name"], x["kind"], tuple(x["columns"]), x["expression"], (to["table"], tuple(to["columns"])) if to else None, x["validated"])

    columns = tuple(Column(c["name"], c["type"], c["nullable"], c["default"], c["ordinal"]) for c in t["columns"])
    return Table(name, columns, tuple(map(constraint, t["constraints"])), tuple(Index(x["name"], tuple(x["columns"]), x["unique"], x["method"], x["predicate"]) for x in t["indexes"]))


def catalog_ir(state: dict) -> SchemaIR:
    """The live schema. A column's storage has its own name here: what backs it is the store's matter."""
    return SchemaIR(tuple(table_ir(n, t) for n, t in state["tables"].items()))

"""Rows on their way into a table that migrations may be changing at the same moment.

Rows are given under the schema that a writer saw. What the table has beside that schema is filled in on the way: a shadow that is
being backfilled, a column that a cutover replaced (through the conversion back, where it gives the value again), a dropped column
(from the row that is replaced). Values that can't be had exactly are counted, so that a revert can be refused."""

from __future__ import annotations

import json

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..functions.types import spark_type
from ..operators.overlay import convert
from .store import Store


def shape(t: dict) -> str:
    """What rows that are being written depend on."""
    p = t.get("pending") or {}
    kept = [(c["physical"], c.get("twin")) for c in t["kept"]]
    return json.dumps([t["columns"], t["constants"], kept, t["key"], p.get("physical"), p.get("sync"), p.get("expression")], sort_keys=True)


def forward(old: str, was: str, twin: dict) -> SparkColumn:
    """The value of the column that replaced a kept one."""
    if twin["expression"] is not None:
        return F.expr(twin["expression"]).cast(spark_type(twin["type"]))
    return convert(F.col(quoted(old)), was, twin["type"])


def staged(store: Store, given: dict, now: dict, rows: DataFrame, shadow: SparkColumn | None) -> tuple[DataFrame, dict[int, SparkColumn]]:
    """(rows with stored column names, conditions of rows that lack a former value by merge). `given` is the table as it was when
    the rows were made, `now` as it is; `shadow` is the pending column's value where sync is on."""
    types = store.types(now) | {k: v for k, v in store.types(given).items() if k not in store.types(now)}
    out = rows.select(*[F.col(quoted(c["name"])).cast(types[c["physical"]]).alias(c["physical"]) for c in given["columns"]])
    twins = [c for c in now["kept"] if c.get("twin")]
    lost: dict[int, SparkColumn] = {}

    def lose(merge: int, condition: SparkColumn) -> None:
        lost[merge] = lost[merge] | condition if merge in lost else condition

    for c in twins:  # the rows were made before a cutover
        if c["physical"] in out.columns and c["twin"]["new"] not in out.columns:
            out = out.withColumn(c["twin"]["new"], forward(c["physical"], c["type"], c["twin"]))
    for c in now["columns"]:
        p = c["physical"]
        if p not in out.columns:
            value = now["constants"].get(p) or c["default"]
            out = out.withColumn(p, (F.lit(None) if value is None else F.expr(value)).cast(spark_type(c["type"])))
    for c in reversed(twins):
        p, new = c["physical"], c["twin"]["new"]
        if p in out.columns or new not in out.columns:
            continue
        if c["twin"]["expression"] is not None:
            out = out.withColumn(p, F.lit(None).cast(spark_type(c["type"])))
            lose(c["merge"], F.lit(True))
        else:
            value = F.col(quoted(new))
            out = out.withColumn(p, (F.rint(value) if spark_type(c["twin"]["type"]).typeName() in ("double", "float") and c["type"].startswith("pg_catalog.int") else value).try_cast(spark_type(c["type"])))
            lose(c["merge"], ~forward(p, c["type"], c["twin"]).eqNullSafe(value))
    dropped = [c for c in now["kept"] if c["physical"] not in out.columns]
    if dropped:
        names = [c["physical"] for c in dropped]
        former = store.rows(now).groupBy(*map(quoted, now["key"])).agg(*[F.max(F.struct(F.lit(1), quoted(p)))[quoted(p).strip("`")].alias(p) for p in names])
        out = out.join(former, now["key"], "left")
        for c in dropped:
            if not c["nullable"]:
                lose(c["merge"], F.col(quoted(c["physical"])).isNull())
    if shadow is not None and now["pending"]["physical"] not in out.columns:
        out = out.withColumn(now["pending"]["physical"], shadow)
    return out, lost

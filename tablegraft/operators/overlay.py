"""Branch overlays: a branch's table as a projection over the parent's stored columns. Nothing is copied; Catalyst inlines the
projection, so pruning and pushed filters reach the parquet scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.types import canonicalize, parts, spark_type
from ..ir import Column, SchemaIR, Table


def convert(value: SparkColumn, old: str, new: str) -> SparkColumn:
    """A cast between canonical types as the source database does it: floats round half-even on their way to whole numbers, and
    text over a varchar's length is cut."""
    base, mods, array = parts(new)
    was = parts(old)[0]
    if not array and base in ("int2", "int4", "int8"):
        if was in ("float4", "float8"):
            value = F.rint(value)
        elif was == "numeric":
            value = F.round(value)
    out = value.cast(spark_type(new))
    return F.substring(out, 1, mods[0]) if base in ("varchar", "bpchar") and mods and not array else out


def select_list(branch: Table, parent: Table, sql: Callable[[str], SparkColumn] = F.expr) -> list[SparkColumn]:
    """The branch's columns in order: a default or typed null without backing, a cast where types differ, an alias where names
    do, else the column itself."""
    backing = {c.physical: c for c in parent.columns}
    out = []
    for c in branch.in_order():
        p = backing.get(c.physical) or parent.column(c.physical)
        if p is None:
            value = sql(c.default).cast(spark_type(c.type)) if c.default is not None else F.lit(None).cast(spark_type(c.type))
        else:
            value = F.col(names.quoted(p.name))
            if canonicalize(c.type) != canonicalize(p.type):
                value = F.expr(c.using).cast(spark_type(c.type)) if c.using else convert(value, p.type, c.type)
        out.append(value.alias(c.name))
    return out


def overlay(branch: Table, parent: Table, rows: DataFrame) -> DataFrame:
    return rows.select(*select_list(branch, parent))


def plan_views(branch: SchemaIR, parent: SchemaIR) -> dict[str, list[str]]:
    """Which tables are views over the parent, which the branch owns, and which of the parent's it dropped."""
    mine, theirs = {t.name for t in branch.tables}, {t.name for t in parent.tables}
    return {"views": sorted(mine & theirs), "own": sorted(mine - theirs), "dropped": sorted(theirs - mine)}


def referenced(table: Table) -> set[str]:
    """Stored columns that a table reads."""
    return {c.physical for c in table.columns}


def remap(branch: Table, old: Table, new: Table) -> tuple[Table, list[str]]:
    """The branch's table after its parent changed, and why it is stale, if it is: a column keeps its backing where name and type
    are as before, else takes the one kept copy `<name>__old_*` of its former type."""
    stale, columns = [], []
    for c in branch.columns:
        was = old.column(c.physical)
        if was is None:
            columns.append(c)
            continue
        now = new.column(c.physical)
        if now and canonicalize(now.type) == canonicalize(was.type):
            columns.append(c)
            continue
        kept = [p for p in new.columns if p.name.startswith(f"{c.physical}__old_") and canonicalize(p.type) == canonicalize(was.type)]
        if len(kept) == 1:
            columns.append(Column(c.name, c.type, c.nullable, c.default, c.ordinal, kept[0].name, c.using))
        else:
            columns.append(c)
            stale.append(f"{branch.name}.{c.name}: column {c.physical} changed or is gone in the parent")
    return Table(branch.name, tuple(columns), branch.constraints, branch.indexes), stale

"""Violation probes: how many rows would break a change. All probes of a table that look at single rows share one scan with one
aggregate; a UNIQUE probe shuffles its keys once, after a partial count in each task. Samples are read only where a probe found
something, in a fixed order."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.types import cast_pattern, parts, spark_type
from ..ir import Constraint
from .diff import Op, classify

ROWS_A_SECOND = 136_000
LOCK_MS = 12
SAMPLES = 10


@dataclass
class Finding:
    op: Op
    blocked: bool
    message: str
    count: int | None = None
    samples: list[dict] = field(default_factory=list)


def as_text(df: DataFrame, column: str) -> SparkColumn:
    """A value's text without exponents: floating numbers go through decimal, else 1e8 would not look like a whole number."""
    value, kind = F.col(names.quoted(column)), df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        exact = value.try_cast(T.DecimalType(38, 9)).cast("string")
        return F.coalesce(F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", ""), value.cast("string"))
    return value.cast("string")


def not_null(column: str) -> SparkColumn:
    return F.col(names.quoted(column)).isNull()


def too_long(df: DataFrame, column: str, most: int) -> SparkColumn:
    return F.length(as_text(df, column)) > most


def not_castable(df: DataFrame, column: str, to: str) -> SparkColumn | None:
    pattern = cast_pattern(to)
    return None if pattern is None else F.col(names.quoted(column)).isNotNull() & ~as_text(df, column).rlike(pattern)


def overflows(df: DataFrame, column: str, to: str) -> SparkColumn:
    """Rows whose text has the right form but whose value doesn't fit the type (an extra of this engine)."""
    pattern = cast_pattern(to)
    text = as_text(df, column)
    return F.col(names.quoted(column)).isNotNull() & (text.rlike(pattern) if pattern else F.lit(True)) & text.try_cast(spark_type(to)).isNull()


def check_text(expression: str | None) -> str:
    """A CHECK's text as Spark SQL, if it is one expression over the row: it is read by the DDL's parser, which knows the functions
    that may be called and nothing else."""
    from ..plans.ddl import row_expression

    return row_expression("true" if expression is None else expression)


def fails_check(expression: str | None) -> SparkColumn:
    """NULL passes."""
    return ~F.expr(f"({check_text(expression)})")


def duplicate_keys(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """(columns..., n) of keys that more than one row holds; keys with a null are no duplicates."""
    cols = [names.quoted(c) for c in columns]
    present = F.lit(True)
    for c in cols:
        present = present & F.col(c).isNotNull()
    return df.where(present).groupBy(*cols).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(df: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows whose key is complete and has no parent (an extra of this engine)."""
    child, own = df.alias("child"), parent.select(*[F.col(names.quoted(c)).alias(f"_{i}") for i, c in enumerate(parent_columns)]).alias("parent")
    on = [F.col(f"child.{names.quoted(c)}") == F.col(f"parent._{i}") for i, c in enumerate(columns)]
    return child.dropna(subset=list(columns)).alias("child").join(own, on, "left_anti")


#: The messages of findings.
SAYS = {
    "null": ("rows violate this", "no NULL rows"),
    "length": ("rows exceed varchar({})", "all values fit the new type"),
    "cast": ("rows are not castable", "all sampled values are castable"),
    "unique": ("duplicate keys", "values are unique"),
    "check": ("rows violate this", "check holds for all rows"),
}


def eta(rows: int) -> str:
    s = math.floor(rows / ROWS_A_SECOND + 0.5)
    return f"backfill ≈ {s // 60} m {s % 60:02d} s, lock window ≈ {LOCK_MS} ms"


def eta_column(rows: SparkColumn) -> SparkColumn:
    s = F.floor(rows / F.lit(float(ROWS_A_SECOND)) + 0.5)
    return F.format_string(f"backfill ≈ %d m %02d s, lock window ≈ {LOCK_MS} ms", F.floor(s / 60), s % 60)


def fused(df: DataFrame, conditions: dict[str, SparkColumn]) -> DataFrame:
    """One row: `rows`, and by name how many rows meet each condition, in one scan."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(c).cast("long").alias(k) for k, c in conditions.items()])


def _says(n: int, what: str, *args) -> str:
    bad, good = SAYS[what]
    return f"blocked: {n:,} {bad.format(*args)}" if n else good


def validate(ops: list[Op], table_of: Callable[[str], DataFrame | None]) -> list[Finding]:
    """Findings of all operations, in their order. table_of gives a table's rows, or None if there is no such table."""
    by_table: dict[str, dict[int, SparkColumn]] = {}
    frames: dict[str, DataFrame | None] = {}
    for k, op in enumerate(ops):
        df = frames.setdefault(op.table, table_of(op.table))
        if df is None:
            continue
        own = by_table.setdefault(op.table, {})
        if op.kind == "set_nullable" and op.to is False:
            own[k] = not_null(op.target)
        elif op.kind == "retype_column":
            base, mods, _ = parts(op.to)
            condition = too_long(df, op.target, mods[0]) if base == "varchar" and mods else not_castable(df, op.target, op.to)
            if condition is not None:
                own[k] = condition
        elif op.kind == "add_constraint" and op.to.kind == "check":
            own[k] = fails_check(op.to.expression)
    counts: dict[int, int] = {}
    rows: dict[str, int] = {}
    for t, conditions in by_table.items():
        if conditions or any(op.table == t and classify(op) == "REWRITE" for op in ops):
            got = fused(frames[t], {f"c{k}": c for k, c in conditions.items()}).first()
            rows[t] = got["rows"]
            counts |= {k: got[f"c{k}"] for k in conditions}
    out = []
    for k, op in enumerate(ops):
        df = frames[op.table]
        if df is not None:
            if finding := _finding(k, op, df, counts, by_table[op.table]):
                out.append(finding)
        if classify(op) == "REWRITE":
            out.append(Finding(op, False, eta(rows.get(op.table, 0))))
    return out


def _finding(k: int, op: Op, df: DataFrame, counts: dict[int, int], conditions: dict[int, SparkColumn]) -> Finding | None:
    def sampled() -> list[dict]:
        if not counts[k] or op.kind != "retype_column":
            return []
        value = F.col(names.quoted(op.target)).alias("value")
        return [r.asDict() for r in df.where(conditions[k]).select(value).orderBy("value").limit(SAMPLES).collect()]

    if op.kind == "set_nullable" and op.to is False:
        return Finding(op, counts[k] > 0, _says(counts[k], "null"), counts[k])
    if op.kind == "retype_column":
        if k not in counts:
            return Finding(op, False, f"no text pattern for {op.to}; rewrite estimated only")
        base, mods, _ = parts(op.to)
        if base == "varchar" and mods:
            return Finding(op, counts[k] > 0, _says(counts[k], "length", mods[0]), counts[k], sampled())
        return Finding(op, counts[k] > 0, _says(counts[k], "cast"), counts[k], sampled())
    if op.kind == "add_constraint" and op.to.kind == "unique":
        return _unique(op, op.to, df)
    if op.kind == "add_constraint" and op.to.kind == "check":
        return Finding(op, counts[k] > 0, _says(counts[k], "check"), counts[k])
    return None


def _unique(op: Op, c: Constraint, df: DataFrame) -> Finding:
    keys = duplicate_keys(df, c.columns)
    n = keys.count()
    samples = [r.asDict() for r in keys.orderBy(*[names.quoted(x) for x in c.columns]).limit(SAMPLES).collect()] if n else []
    return Finding(op, n > 0, _says(n, "unique"), n, samples)

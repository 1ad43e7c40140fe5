"""Three-way merge of schema states, as a function over paths and as a join over catalog rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Column, Constraint, Index, SchemaIR, Table, paths
from .diff import Op, _renames, diff


@dataclass(frozen=True)
class Conflict:
    path: str
    base: dict | None
    ours: dict | None
    theirs: dict | None
    reason: str


@dataclass(frozen=True)
class Merged:
    ir: SchemaIR | None
    ops: list[Op]
    conflicts: list[Conflict]


def _objects(ir: SchemaIR) -> dict[str, object]:
    out: dict[str, object] = {}
    for t in ir.tables:
        out[t.name] = t
        out |= {f"{t.name}.{c.name}": c for c in t.columns}
        out |= {f"{t.name}.constraint.{c.name}": c for c in t.constraints}
        out |= {f"{t.name}.index.{i.name}": i for i in t.indexes}
    return out


def _assemble(picked: dict[str, object]) -> SchemaIR:
    tables = []
    for path, x in picked.items():
        if isinstance(x, Table):
            own = [v for p, v in picked.items() if p.startswith(f"{path}.") and not isinstance(v, Table)]
            tables.append(Table(x.name, *(tuple(v for v in own if isinstance(v, kind)) for kind in (Column, Constraint, Index))))
    return SchemaIR(tuple(tables))


def merge(base: SchemaIR, ours: SchemaIR, theirs: SchemaIR) -> Merged:
    """For each path the side that changed wins, equal changes converge, others conflict. Two more conflicts are reported that a
    path by itself doesn't show: a column renamed differently on both sides, and something added to a table that the other
    side dropped. With a conflict there are no operations."""
    states = [paths(x) for x in (base, ours, theirs)]
    objects = _objects(ours), _objects(theirs)
    picked, conflicts = {}, []
    for path in sorted(set().union(*states)):
        kinds = [s[path][0] for s in states if path in s]
        b, o, t = (s[path][1] if path in s else None for s in states)
        if o == b and t != b:
            side = 1
        elif t == b or o == t:
            side = 0
        else:
            conflicts.append(Conflict(path, b, o, t, f"both sides changed {kinds[0]} {path} differently"))
            continue
        if path in objects[side]:
            picked[path] = objects[side][path]
    known = {c.path for c in conflicts}
    for path in sorted(p for p in picked if "." in p):
        table = path.split(".")[0]
        if table not in picked and table not in known:
            known.add(table)
            conflicts.append(Conflict(table, *(s[table][1] if table in s else None for s in states), f"one side dropped table {table}, the other changed {path}"))
    for t in base.tables:
        a, b = ours.table(t.name), theirs.table(t.name)
        if a and b:
            left, right = ({old: new for new, old in _renames(t, x).items()} for x in (a, b))
            for old in sorted(left.keys() & right.keys()):
                if left[old] != right[old]:
                    path = f"{t.name}.{old}"
                    conflicts.append(Conflict(path, states[0][path][1], states[1][f"{t.name}.{left[old]}"][1], states[2][f"{t.name}.{right[old]}"][1], f"both sides renamed column {path} differently"))
    if conflicts:
        return Merged(None, [], sorted(conflicts, key=lambda c: c.path))
    merged = _assemble(picked)
    return Merged(merged, diff(ours, merged), [])


def merge_rows(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, kind, base, ours, theirs, result, payload) over catalog rows; result is ours, theirs or conflict."""
    b, o, t = (x.select("path", "kind", "payload").alias(n) for x, n in ((base, "b"), (ours, "o"), (theirs, "t")))
    two = b.join(o, F.col("b.path") == F.col("o.path"), "full_outer").select(
        F.coalesce("b.path", "o.path").alias("path"), F.coalesce("b.kind", "o.kind").alias("kind"), F.col("b.payload").alias("base"), F.col("o.payload").alias("ours")
    )
    all_ = two.alias("x").join(t, F.col("x.path") == F.col("t.path"), "full_outer").select(
        F.coalesce("x.path", "t.path").alias("path"), F.coalesce("x.kind", "t.kind").alias("kind"), "base", "ours", F.col("t.payload").alias("theirs")
    )
    same = lambda a, c: F.col(a).eqNullSafe(F.col(c))
    result = F.when(same("ours", "base") & ~same("theirs", "base"), "theirs").when(same("theirs", "base") | same("ours", "theirs"), "ours").otherwise("conflict")
    return all_.withColumn("result", result).withColumn("payload", F.when(F.col("result") == "theirs", F.col("theirs")).when(F.col("result") == "ours", F.col("ours")))

"""Schema states: tables, columns, constraints, indexes, their canonical JSON and content address.

Collections are ordered by name. A column's ordinal is for display only: it takes no part in the canonical form. The physical
name says which stored column backs a logical one.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    ordinal: int = 1
    physical: str = ""
    using: str | None = None  # how an uncommitted retype converts values; never part of a commit

    def __post_init__(self):
        if not self.physical:
            object.__setattr__(self, "physical", self.name)

    def canonical(self) -> dict:
        return {"default": self.default, "name": self.name, "nullable": self.nullable, "physicalName": self.physical, "type": self.type}


@dataclass(frozen=True)
class Constraint:
    name: str
    kind: str  # primary, unique, check, foreign
    columns: tuple[str, ...] = ()
    expression: str | None = None
    references: tuple[str, tuple[str, ...]] | None = None
    validated: bool = True

    def canonical(self) -> dict:
        to = self.references and {"columns": list(self.references[1]), "table": self.references[0]}
        return {"columns": list(self.columns), "expression": self.expression, "kind": self.kind, "name": self.name, "references": to, "validated": self.validated}

    def definition(self) -> tuple:
        return self.kind, self.columns, self.expression, self.references


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    method: str = "btree"
    predicate: str | None = None

    def canonical(self) -> dict:
        return {"columns": list(self.columns), "method": self.method, "name": self.name, "predicate": self.predicate, "unique": self.unique}

    def definition(self) -> tuple:
        return self.unique, self.method, self.predicate, self.columns


def _sorted(items) -> tuple:
    return tuple(sorted(items, key=lambda x: x.name))


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    indexes: tuple[Index, ...] = ()

    def __post_init__(self):
        for part in ("columns", "constraints", "indexes"):
            object.__setattr__(self, part, _sorted(getattr(self, part)))

    def canonical(self) -> dict:
        return {part: [x.canonical() for x in getattr(self, part)] for part in ("columns", "constraints", "indexes")} | {"name": self.name}

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def in_order(self) -> list[Column]:
        """Columns as they are displayed: by ordinal, then name."""
        return sorted(self.columns, key=lambda c: (c.ordinal, c.name))

    def with_column(self, column: Column, instead_of: str | None = None) -> Table:
        gone = instead_of or column.name
        return replace(self, columns=tuple(c for c in self.columns if c.name != gone) + (column,))


@dataclass(frozen=True)
class SchemaIR:
    tables: tuple[Table, ...] = field(default=())
    version: int = 1

    def __post_init__(self):
        object.__setattr__(self, "tables", _sorted(self.tables))

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name == name), None)

    def with_table(self, table: Table) -> SchemaIR:
        return replace(self, tables=tuple(t for t in self.tables if t.name != table.name) + (table,))

    def without(self, name: str) -> SchemaIR:
        return replace(self, tables=tuple(t for t in self.tables if t.name != name))


def canonical_json(ir: SchemaIR) -> str:
    return json.dumps({"tables": [t.canonical() for t in ir.tables], "version": ir.version}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def hash_ir(ir: SchemaIR) -> str:
    """The id of a commit of this state."""
    return hashlib.sha256(canonical_json(ir).encode()).hexdigest()


def to_json(ir: SchemaIR) -> str:
    """Everything, ordinals and pending conversions too."""
    return json.dumps(asdict(ir), sort_keys=True, ensure_ascii=False)


def from_json(text: str) -> SchemaIR:
    def constraint(x: dict) -> Constraint:
        to = x.get("references")
        return Constraint(x["name"], x["kind"], tuple(x["columns"]), x.get("expression"), (to[0], tuple(to[1])) if to else None, x.get("validated", True))

    def table(x: dict) -> Table:
        indexes = (Index(i["name"], tuple(i["columns"]), i["unique"], i["method"], i.get("predicate")) for i in x["indexes"])
        return Table(x["name"], tuple(Column(**c) for c in x["columns"]), tuple(map(constraint, x["constraints"])), tuple(indexes))

    raw = json.loads(text)
    if raw.get("version") != 1:
        raise ValueError("unknown schema version")
    return SchemaIR(tuple(map(table, raw["tables"])))


def paths(ir: SchemaIR) -> dict[str, tuple[str, dict | None]]:
    """path -> (kind, payload): a table as `t`, a column as `t.c`, others as `t.constraint.n` and `t.index.n`. Types compare in
    their canonical spelling; ordinals never."""
    from .functions.types import canonicalize

    out: dict[str, tuple[str, dict | None]] = {}
    for t in ir.tables:
        out[t.name] = ("table", {"name": t.name})
        for c in t.columns:
            out[f"{t.name}.{c.name}"] = ("column", c.canonical() | {"type": canonicalize(c.type)})
        for kind, items in (("constraint", t.constraints), ("index", t.indexes)):
            for x in items:
                out[f"{t.name}.{kind}.{x.name}"] = (kind, x.canonical())
    return out


def catalog_rows(spark: SparkSession, ir: SchemaIR) -> DataFrame:
    """(path, kind, table, name, payload): the state as rows, for joins over schemas."""
    rows = []
    for path, (kind, payload) in sorted(paths(ir).items()):
        rows.append((path, kind, path.split(".")[0], payload["name"], json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    return spark.createDataFrame(rows, "path string, kind string, table string, name string, payload string")

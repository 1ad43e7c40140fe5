"""Queries over the tables of a folder, and their DuckDB forms."""

from . import branches, catalogs, checks, measures, repos, schemas

_PARTS = (branches, checks, schemas, catalogs, measures, repos)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

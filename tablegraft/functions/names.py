"""Identifiers, and how alike two names are."""

from __future__ import annotations

import re

MAIN = "main"
#: Fixed value: what a branch may be called.
_BRANCH = re.compile(r"^[a-z0-9][a-z0-9-]{0,38}$")
LONGEST = 63


class InvalidIdentifier(ValueError):
    pass


def check(name: str) -> str:
    if not isinstance(name, str) or not name:
        raise InvalidIdentifier("an identifier can't be empty")
    if len(name) > LONGEST:
        raise InvalidIdentifier(f"{name!r} is longer than {LONGEST} characters")
    if "\0" in name:
        raise InvalidIdentifier(f"{name!r} holds a NUL")
    return name


def quoted(name: str) -> str:
    return "`" + check(name).replace("`", "``") + "`"


def check_branch(name: str) -> str:
    if not _BRANCH.match(name or ""):
        raise InvalidIdentifier(f"{name!r}: a branch name has 1 to 39 of a-z, 0-9 and -, and starts with a letter or digit")
    return name


def database(branch: str) -> str:
    """The database that holds a branch's views."""
    return MAIN if branch == MAIN else "br_" + check_branch(branch).replace("-", "_")


def shadow(column: str) -> str:
    """The column that a rewrite fills beside the old one."""
    return f"{column[: LONGEST - 6 if len(column) > LONGEST - 5 else None]}__new"


def backup(column: str, merge_id: int) -> str:
    """The name under which a replaced column is kept until contract."""
    tail = f"__old_{merge_id}"
    return column[: LONGEST - len(tail)] + tail


def is_leftover(column: str) -> bool:
    return bool(re.search(r"__new$|__old_", column))


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n

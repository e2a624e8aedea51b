"""Read-only check of SQL text.

Spark's own parser decides what is a query (the text is only ever submitted as a subquery); the check
here gives the stable error codes and shuts functions that reach outside the data.
"""

from __future__ import annotations

import re

from ..errors import WorkspaceError

# How a query starts, and the words it must not hold outside quotes.
STARTERS = ("select", "with")
FORBIDDEN_WORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "truncate",
    "merge", "grant", "revoke", "copy", "call", "execute",
)
# Functions that run JVM methods or read files.
FORBIDDEN_FUNCTIONS = ("reflect", "java_method", "try_reflect", "read_files", "input_file_name")

_QUOTED = re.compile(
    r"""(?P<literal>r?'(?:[^'\\]|\\.|'')*'|r?"(?:[^"\\]|\\.|"")*")"""
    r"""|(?P<name>`(?:[^`]|``)*`)"""
    r"""|(?P<comment>--[^\n]*|/\*.*?\*/)""",
    re.DOTALL | re.IGNORECASE,
)

QUOTED_NAME = re.compile(r"`(\w+)`")


def without_comments(sql: str) -> str:
    """Comments become a space; quoted parts stay as they are."""
    return _QUOTED.sub(lambda m: " " if m["comment"] else m[0], sql)


def bare(sql: str) -> str:
    """The text with literals and back-quoted names blanked out, comments removed."""
    return _QUOTED.sub(lambda m: "''" if m["literal"] else ("``" if m["name"] else " "), sql)


def check_functions(sql: str) -> None:
    """Refuse the forbidden functions, also when their name is back-quoted."""
    called = bare(QUOTED_NAME.sub(r"\1", without_comments(sql)))
    found = re.search(rf"(?i)(?<!\w)({'|'.join(FORBIDDEN_FUNCTIONS)})\s*\(", called)
    if found:
        raise WorkspaceError("sql_forbidden_operation", f"Function {found[1]} is not allowed")


def validate(sql: str, max_chars: int | None = None) -> str:
    """Check the text and return it without comments and closing semicolon."""
    if max_chars is not None and len(sql) > max_chars:
        raise WorkspaceError("sql_too_long", f"SQL is limited to {max_chars} characters")
    clean = without_comments(sql).strip().rstrip(";").strip()
    if not clean:
        raise WorkspaceError("sql_empty", "SQL cannot be empty")
    words = bare(clean)
    if ";" in words:
        raise WorkspaceError("sql_multiple_statements", "Only one statement is allowed")
    if not re.match(rf"(?i)({'|'.join(STARTERS)})\b", words):
        raise WorkspaceError("sql_not_read_only", "Only SELECT queries are allowed")
    found = re.search(rf"(?i)\b({'|'.join(FORBIDDEN_WORDS)})\b", words)
    if found:
        raise WorkspaceError("sql_forbidden_operation", f"{found[0]} is not allowed")
    check_functions(clean)
    return clean

"""Names and references: header clean-up and short stable ids for long texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import WHITESPACE

# Longest reference, and how much of the digest it carries.
MAX_REFERENCE, DIGEST_CHARS = 128, 24


def normalize_headers(raw: Sequence[object | None]) -> list[str]:
    """Strip names, name blank ones by position, number the repeats of a name."""
    stripped = ["" if h is None else str(h).strip() for h in raw]
    base = [name or f"column_{i}" for i, name in enumerate(stripped, start=1)]
    seen: Counter[str] = Counter()
    result = []
    for name in base:
        seen[name] += 1
        result.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return result


def stable_reference(prefix: Column, value: Column) -> Column:
    """``prefix_<24 hex of SHA-256>``: the same text always gets the same short id."""
    word = F.btrim(F.regexp_replace(prefix, r"[^\p{L}\p{N}_]", "_"), F.lit("_"))
    head = F.coalesce(F.nullif(word, F.lit("")), F.lit("source"))
    return F.substring(
        F.concat(head, F.lit("_"), F.substring(F.sha2(value, 256), 1, DIGEST_CHARS)), 1, MAX_REFERENCE
    )


def view_source_id(source_type: Column, source_id: Column, source_sql: Column, view_id: Column) -> Column:
    """What a data view's lineage edge points back to: its id when short, else a stable reference."""
    given_id, given_sql = F.nullif(source_id, F.lit("")), F.nullif(source_sql, F.lit(""))
    return (
        F.when(F.length(given_id) <= MAX_REFERENCE, given_id)
        .when(given_id.isNotNull(), stable_reference(source_type, given_id))
        .when(given_sql.isNotNull(), stable_reference(F.lit("sql_query"), given_sql))
        .otherwise(view_id)
    )


__all__ = ["normalize_headers", "stable_reference", "view_source_id", "WHITESPACE"]

"""Identities: SHA-256 over NUL-joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*parts) -> Column:
    """Hex digest of the parts; a null part counts as empty (``concat_ws`` alone would drop it)."""
    each = [F.coalesce((p if isinstance(p, Column) else F.col(p)).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\0", *each), 256)


def pair_id(a, b, method: str) -> Column:
    """Identity of an unordered pair under a method."""
    return hashed(F.least(a, b), F.greatest(a, b), F.lit(method))


def item_id(kind, subject, object_, evidence) -> Column:
    """Identity of a signal or review: type, subject, object and sorted evidence."""
    head = [F.coalesce(x, F.lit("")) for x in (kind, subject, object_)]
    return F.sha2(F.array_join(F.concat(F.array(*head), F.array_sort(evidence)), "\0"), 256)


def sql_hashed(*parts: str) -> str:
    return "sha256(concat_ws(chr(0), " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + "))"


def sql_pair_id(a: str, b: str, method: str) -> str:
    return sql_hashed(f"least({a}, {b})", f"greatest({a}, {b})", f"'{method}'")

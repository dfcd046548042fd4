"""Training-data operators.  Nothing else in the library imports this subpackage."""

from __future__ import annotations


def _modules():
    from . import (
        bpe, decontamination, fingerprints, hard_negatives, jaccard_join, language_id, packing, quality_rules, spelling, suffix_dedup, token_counts,
        toxicity, url_filter,
    )

    return (fingerprints, bpe, suffix_dedup, url_filter, toxicity, quality_rules, jaccard_join, token_counts, language_id, packing, decontamination, spelling, hard_negatives)


def queries() -> dict:
    """Queries of the numbered operators."""
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    """DuckDB SQL of those queries that SQL can express."""
    return {k: q for m in _modules() for k, q in m.ORACLE.items()}

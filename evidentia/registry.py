"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations


def _modules():
    from evidentia.operators import cases, detect, enrich, extract, facts, ingest, jobs, lifecycle, people, publish, resolve, signals
    from evidentia.streaming import streams

    return (ingest, facts, extract, cases, jobs, people, resolve, enrich, detect, signals, lifecycle, publish, streams)


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _modules() for k, q in m.ORACLE.items()}

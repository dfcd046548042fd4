"""Extraction jobs by name, and a run of the sources that name them (K).

A job takes the landed rows of one source and the source itself, and returns facts with the
columns ``FACT``, so that facts of all kinds stand in one table.  Sources are configuration: a
short list, known before the run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.sources.pages import html_blocks

from . import extract
from .cases import case_facts, housing_facts

FACT = ("source_id", "predicate", "subject_id", "object_id", "value_text", "locator")


@dataclass(frozen=True)
class Source:
    """A source: the job that reads it, the organisation that it is of, and terms of its buyers."""

    source_id: str
    job: str
    organisation_id: str | None = None
    buyer_terms: tuple[str, ...] = ()


class Extraction(NamedTuple):
    facts: DataFrame
    counts: DataFrame


def _fact(rows: DataFrame, source: Source, subject, object_, value, locator: Column, predicate: str | Column = "predicate") -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else F.lit(None) if c is None else c).cast("string")
    return rows.select(
        F.lit(source.source_id).alias("source_id"), text(predicate).alias("predicate"), text(subject).alias("subject_id"),
        text(object_).alias("object_id"), text(value).alias("value_text"), locator.alias("locator"))


def _at(label: str, *columns: str) -> Column:
    """Where in its source a fact stands."""
    return F.concat(F.lit(label + " "), F.concat_ws("/", *columns))


def payments(rows: DataFrame, source: Source) -> DataFrame:
    """Tables of payments: row_number and columns of any known headers; the payer is the source's organisation."""
    mapped = extract.map_headers(rows, extract.PAYMENT_HEADERS, ("row_number",)).withColumn("payer_org", F.lit(source.organisation_id).cast("string"))
    return _fact(extract.extract_payments(mapped, source.source_id), source, "subject_id", "object_id", "amount", F.col("locator"))


def contract_register(rows: DataFrame, source: Source) -> DataFrame:
    """Registers of contracts: row_id and columns of any known headers; the buyer is the source's organisation."""
    mapped = extract.map_headers(rows, extract.CONTRACT_HEADERS, ("row_id",))
    return _fact(extract.extract_contract_register(mapped, source.source_id, source.organisation_id), source, "subject_id", "object_id", "value_text", _at("row", "row_id"))


def contracts(rows: DataFrame, source: Source) -> DataFrame:
    """Releases as JSON texts (json): facts of awards and their periods, for buyers with one of the terms, if there are any."""
    releases = extract.filter_buyers(extract.parse_releases(rows), list(source.buyer_terms))
    award = _at("award", "ocid", "award_id")
    return _fact(extract.extract_ocds(releases), source, "ocid", "party", "value_text", award).unionByName(
        _fact(extract.extract_contract_periods(releases), source, "ocid", None, "value_text", award))


def grants(rows: DataFrame, source: Source) -> DataFrame:
    """Pages of grants: the recipient and the purpose with the amount."""
    found = extract.extract_grants(html_blocks(rows))
    return _fact(found, source, "recipient", None, F.concat_ws(": ", "purpose", F.col("amount").cast("string")), _at("page", "page_id", "seq"), F.lit("GRANT_AWARDED"))


def case_listings(rows: DataFrame, source: Source) -> DataFrame:
    return _fact(case_facts(rows), source, "reference", None, "value_text", _at("page", "page_id"))


def decisions(rows: DataFrame, source: Source) -> DataFrame:
    return _fact(housing_facts(rows, length=None), source, "case_id", None, "value_text", _at("page", "page_id"))


def council_pages(rows: DataFrame, source: Source) -> DataFrame:
    return _fact(extract.extract_council_pages(html_blocks(rows)), source, "subject", "object", "value_text", _at("page", "page_id"))


def council_feeds(rows: DataFrame, source: Source) -> DataFrame:
    return _fact(extract.extract_council_feeds(rows), source, "subject", "object", "value_text", _at("feed", "feed_id"))


#: Jobs by name.
JOBS: dict[str, Callable[[DataFrame, Source], DataFrame]] = {f.__name__: f for f in (
    payments, contract_register, contracts, grants, case_listings, decisions, council_pages, council_feeds)}


def run_jobs(sources: list[Source], landed: dict[str, DataFrame], jobs: dict | None = None) -> Extraction:
    """Facts of all sources, and (source_id, job, known_kind, fact_count) of each.

    ``landed`` has the rows of a source by its id.  A source whose job is not known, or that has
    landed nothing, has no facts and still its row of counts, as the status of a run needs it.
    Repeated facts stay as they are; identities make one of them when they are stored.
    """
    if not sources:
        raise ValueError("no sources to run")
    jobs = JOBS if jobs is None else jobs
    found = [jobs[s.job](landed[s.source_id], s) for s in sources if s.job in jobs and s.source_id in landed]
    spark = next(iter(landed.values())).sparkSession
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in FACT))
    facts = reduce(DataFrame.unionByName, found, none)
    listed = spark.createDataFrame([(s.source_id, s.job, s.job in jobs) for s in sources], "source_id string, job string, known_kind boolean")
    n = facts.groupBy("source_id").agg(F.count("*").alias("fact_count"))
    return Extraction(facts, listed.join(n, "source_id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0).cast("long"))))


# Queries over the driver's tables -----------------------------------------------------------


SOURCES = [
    Source("spending", "payments", "o1"), Source("register", "contract_register", "b1"), Source("notices", "contracts"),
    Source("notices of some", "contracts", buyer_terms=("URGENT", "low")), Source("awards", "grants"), Source("feeds", "council_feeds"),
    Source("odd", "no such job"), Source("silent", "grants"),
]


def _ran(v) -> Extraction:
    releases = extract._releases(v).select("json")
    return run_jobs(SOURCES, {
        "spending": extract._payment_csv(v), "register": extract._register(v), "notices": releases, "notices of some": releases,
        "awards": extract._grant_pages(v), "feeds": extract._event_feeds(v), "odd": v("region")})


QUERIES = {
    "k_run_jobs": extract._q(lambda v: _ran(v).facts.select("source_id", "predicate", "value_text", "locator")),
    "k_job_counts": extract._q(lambda v: _ran(v).counts),
}

_O = extract.ORACLE
_AWARD = "'award ' || ocid || '/' || award_id"
_NOTICES = f"SELECT ocid, award_id, predicate, value_text FROM ({_O['c8_extract_ocds']}) UNION ALL SELECT ocid, award_id, predicate, value_text FROM ({_O['c9_extract_contract_periods']})"
_FACTS = f"""WITH no AS ({_NOTICES}), f AS (
  SELECT 'spending' AS source_id, 'PAYMENT_TO_SUPPLIER' AS predicate, amount::VARCHAR AS value_text, locator FROM ({_O['c5_extract_payments']})
  UNION ALL SELECT 'register', predicate, value_text, 'row ' || row_id FROM ({_O['c7_extract_contract_register']})
  UNION ALL SELECT 'notices', predicate, value_text, {_AWARD} FROM no
  UNION ALL SELECT 'notices of some', predicate, value_text, {_AWARD} FROM no WHERE ocid IN (SELECT ocid FROM ({_O['c11_filter_buyers']}))
  UNION ALL SELECT 'awards', 'GRANT_AWARDED', purpose || ': ' || amount, 'page ' || page_id || '/1' FROM ({_O['c14_extract_grants']})
  UNION ALL SELECT 'feeds', predicate, value_text, 'feed ' || feed_id FROM ({_O['c18_event_feeds']}))
"""
ORACLE = {
    "k_run_jobs": _FACTS + "SELECT * FROM f",
    "k_job_counts": _FACTS + """SELECT source_id, job, job <> 'no such job' AS known_kind, (SELECT count(*) FROM f WHERE f.source_id = s.source_id) AS fact_count FROM (VALUES
      """ + ", ".join(f"('{s.source_id}', '{s.job}')" for s in SOURCES) + ") s(source_id, job)",
}

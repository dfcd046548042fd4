"""People of council pages: an index of surnames by host, and declarations tied to those they name.

A page's person is one of its host.  Minutes often give a surname alone: it stands for the only
person of that host whose name ends with it.  Where there is none, or more than one, the
declaration stays a text of the meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.functions.ids import hashed, sql_hashed
from evidentia.sources.pages import html_blocks
from evidentia.sources.staging import view, with_views

from .extract import extract_council_pages

#: Predicates whose subject is a person.
OF_PEOPLE = ("MEMBER_OF", "MEMBER_OF_PARTY", "REPRESENTS_WARD", "APPOINTED_TO_OUTSIDE_BODY", "DECLARED_INTEREST", "ATTENDANCE_RECORDED_FOR")
DECLARED = "DECLARED_INTEREST_AT"


def page_host(url) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def person_id(host, name) -> Column:
    return hashed(F.lit("PERSON"), host, text.normalize_name(name))


def people_of(facts: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, person_id, person_name) that facts of pages name in full: office-holders, and those who declared by two words or more."""
    rows = facts.withColumn("name", text.clean_person_name("subject"))
    whole = F.col("predicate").isin(*OF_PEOPLE) | ((F.col("predicate") == DECLARED) & (F.instr(F.trim("name"), " ") > 0))
    rows = rows.filter(whole & (F.col("name") != "")).join(hosts, "page_id").select("host", person_id("host", "name").alias("person_id"), "name")
    return rows.groupBy("host", "person_id").agg(F.min("name").alias("person_name"))


def surname_index(people: DataFrame) -> DataFrame:
    """(host, surname, person_id) of surnames that only one person of the host has; a name of one word is its own surname."""
    last = people.select("host", "person_id", F.element_at(F.split(text.normalize_name("person_name"), " "), -1).alias("surname")).distinct()
    return last.groupBy("host", "surname").agg(F.count("*").alias("n"), F.min("person_id").alias("person_id")).filter("n = 1").drop("n")


def resolve_people(facts: DataFrame, pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Facts of ``extract_council_pages`` with subject_id and the name as recorded.

    ``pages`` (page_id, url) are those of the facts; ``known`` (host, person_id, person_name) are
    the people of earlier runs.  Declarations whose person is not known or not the only one
    become DECLARATION_TEXT of their meeting.
    """
    hosts = pages.select("page_id", page_host("url").alias("host")).distinct()
    people = people_of(facts, hosts)
    if known is not None:
        people = people.unionByName(known.select("host", "person_id", "person_name"))
    rows = facts.join(hosts, "page_id", "left").withColumn("recorded", F.when(F.col("predicate").isin(*OF_PEOPLE, DECLARED), text.clean_person_name("subject")))
    alone = (F.col("predicate") == DECLARED) & (F.instr("recorded", " ") == 0)
    rows = rows.withColumn("surname", F.when(alone, text.normalize_name("recorded")))
    found = rows.filter(alone).join(surname_index(people).withColumnRenamed("person_id", "subject_id"), ["host", "surname"], "left")
    rest = rows.filter(~F.coalesce(alone, F.lit(False))).withColumn("subject_id", F.when(F.col("recorded").isNotNull(), person_id("host", "recorded")))
    both = found.unionByName(rest)
    lost = (F.col("predicate") == DECLARED) & F.col("subject_id").isNull()
    return both.select(
        "page_id", F.when(lost, "DECLARATION_TEXT").otherwise(F.col("predicate")).alias("predicate"), "subject_id",
        F.when(lost, F.col("object")).otherwise(F.col("subject")).alias("subject"), F.when(~lost, F.col("object")).alias("object"), "value_text", "recorded",
    )


# Queries over the driver's tables -----------------------------------------------------------


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _pages(v) -> DataFrame:
    """Members and meetings of 50 hosts; some surnames are of one person, some of two, some of nobody."""
    return v("customer").select(F.col("c_custkey").alias("page_id"),
        F.expr("concat('https://H', c_custkey % 50, '.example/', CASE WHEN c_custkey % 100 < 50 THEN 'mgUserInfo' ELSE 'ieListDocuments' END, '.aspx?ID=', c_custkey)").alias("url"),
        F.expr("""CASE WHEN c_custkey % 100 < 50 THEN concat('<h1>Councillor ', CASE WHEN c_custkey % 3 = 0 THEN 'Ann' ELSE 'Bo' END, ' Sur', chr(97 + c_nationkey), '</h1><p>Party: P</p>')
          ELSE concat('<h1>Meeting ', c_custkey, '</h1><table><tr><td>1.</td><td>Disclosures of interest Minutes: Councillor Sur', chr(97 + c_nationkey), ' declared a thing and Councillor Cy Full',
            chr(97 + c_nationkey), ' declared too</td></tr></table>') END""").alias("html"))


def _resolved(v) -> DataFrame:
    pages = _pages(v)
    return resolve_people(extract_council_pages(html_blocks(pages)), pages)


QUERIES = {
    "c17_resolved_declarations": _q(lambda v: _resolved(v).filter("recorded IS NOT NULL OR predicate = 'DECLARATION_TEXT'").select("page_id", "predicate", "subject_id", "subject", "object", "recorded")),
}
_ID = lambda name: sql_hashed("'PERSON'", "host", f"lower({name})")
ORACLE = {k: with_views(q) for k, q in {
    "c17_resolved_declarations": f"""WITH c AS (SELECT c_custkey AS page_id, 'h' || (c_custkey % 50) || '.example' AS host, c_custkey % 100 < 50 AS member, CASE WHEN c_custkey % 3 = 0 THEN 'Ann' ELSE 'Bo' END AS first, chr((97 + c_nationkey)::INT) AS l FROM customer),
      p AS (SELECT host, 'sur' || l AS surname, {_ID("min(first || ' Sur' || l)")} AS one FROM c WHERE member GROUP BY host, l HAVING count(DISTINCT first) = 1)
      SELECT page_id, 'MEMBER_OF_PARTY' AS predicate, {_ID("first || ' Sur' || l")} AS subject_id, first || ' Sur' || l AS subject, 'P' AS object, first || ' Sur' || l AS recorded FROM c WHERE member
      UNION ALL SELECT page_id, 'DECLARED_INTEREST_AT', {_ID("'Cy Full' || l")}, 'Cy Full' || l, 'Meeting ' || page_id, 'Cy Full' || l FROM c WHERE NOT member
      UNION ALL SELECT page_id, CASE WHEN one IS NULL THEN 'DECLARATION_TEXT' ELSE 'DECLARED_INTEREST_AT' END, one, CASE WHEN one IS NULL THEN 'Meeting ' || page_id ELSE 'Sur' || l END,
        CASE WHEN one IS NOT NULL THEN 'Meeting ' || page_id END, 'Sur' || l FROM c LEFT JOIN (SELECT host AS h, surname, one FROM p) p ON h = c.host AND surname = 'sur' || l WHERE NOT member""",
}.items()}

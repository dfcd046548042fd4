"""Ombudsman cases: the facts of listings of cases, of decision pages and of housing determinations.

Pages are texts in order (``pages.html_lines``).  A page's text is these, one a line; labels,
outcomes and ends of sections are a small grammar of patterns over it, which may run over line
ends as the markup does.  Sections and labels in tables need the tree, and come with the page's
texts from where it is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.sources.pages import html_lines, html_outlines
from evidentia.sources.staging import view, with_views

# Outcomes, and the facts of a case with their predicates and places.
OUTCOMES = ("Closed after initial enquiries", "Not upheld", "Upheld")
CASE_FACTS = (
    ("OMBUDSMAN_CASE", "HAS_OMBUDSMAN_CASE", "case_name", "case reference"),
    ("OMBUDSMAN_DECISION", "HAS_OMBUDSMAN_DECISION", "decision", "Decision"),
    ("OMBUDSMAN_CATEGORY", "HAS_OMBUDSMAN_CATEGORY", "category", "Category"),
    ("OMBUDSMAN_DECISION_DATE", "HAS_OMBUDSMAN_DECISION_DATE", "decision_date", "Decision date"),
    ("OMBUDSMAN_SUMMARY", "HAS_OMBUDSMAN_SUMMARY", "summary", "summary"),
)
HOUSING_FACTS = (
    ("HOUSING_OMBUDSMAN_CASE", "HAS_HOUSING_OMBUDSMAN_CASE", "case_id", "Case ID"),
    ("HOUSING_OMBUDSMAN_DECISION_TYPE", "HAS_DECISION_TYPE", "decision_type", "Decision type"),
    ("HOUSING_OMBUDSMAN_DECISION_DATE", "HAS_DECISION_DATE", "decision_date", "Date"),
    ("HOUSING_OMBUDSMAN_DETERMINATION", "HAS_DETERMINATION", "determination", "Our decision (determination)"),
)
DECISION_URL = r"(?i)/decisions/.+/\d{2}-\d{3}-\d{3}/?$"
HOUSING_URL = r"(?i)/decisions/[^/]+-(\d{6,})/?$"
CASE_HEADING = r"(?mdU)^([^\n]+?)\s+\((\d{2}\s+\d{3}\s+\d{3})\)\s*$"
RESULT_META = r"(?imdU)^(?:Statement|Report)\s+(" + "|".join(OUTCOMES) + r")\s+(.+?)\s+(\d{2}-[A-Za-z]{3}-\d{4})\s*$"
LANDLORD = "Home Group Limited"
SECTION_LENGTH = 4000  # the reference's own cut; no query or job asks for it
_CASE, _REFERENCE, _BODY = "\ue000", "\ue001", "\ue002"  # private characters that cut a listing into its cases


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _found(value: Column) -> Column:
    return F.nullif(_stripped(value), F.lit(""))


def _tag_text(lines: DataFrame, tag: str) -> DataFrame:
    """page_id, text of the first element of a tag."""
    at = F.array_position("tags", tag).cast("int")
    own = lines.filter((at > 0) & F.col("text").isNotNull()).select("page_id", "seq", "text", F.element_at("path", at).alias("number"))
    each = own.groupBy("page_id", "number").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    return each.select("page_id", "number", joined.alias("t")).groupBy("page_id").agg(F.min_by("t", "number").alias(tag))


def page_texts(lines: DataFrame) -> DataFrame:
    """page_id, url, body (the texts, one a line), h1."""
    rows = lines.filter("text IS NOT NULL").groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    rows = rows.select("page_id", "url", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("body"))
    return rows.join(_tag_text(lines, "h1"), "page_id", "left")


def listed_cases(texts: DataFrame) -> DataFrame:
    """Cases of result pages: a heading with a reference, and what follows up to the next one."""
    cut = F.regexp_replace("body", CASE_HEADING, f"{_CASE}$1{_REFERENCE}$2{_BODY}")
    cases = texts.select("page_id", F.posexplode(F.split(cut, _CASE)).alias("place", "part")).filter("place > 0")
    body = F.substring_index("part", _BODY, -1)
    meta = lambda k: _found(F.regexp_extract(body, RESULT_META, k))
    told = F.filter(F.transform(F.split(body, "\n"), _stripped), lambda x: x != "")
    at = F.array_position(F.transform(told, lambda x: F.startswith(F.lower(x), F.lit("summary:"))), True).cast("int")
    head = F.get(told, at - 1)
    cases = cases.select(
        "page_id", "place", _stripped(F.substring_index("part", _REFERENCE, 1)).alias("title"),
        F.regexp_replace(F.substring_index(F.substring_index("part", _BODY, 1), _REFERENCE, -1), " ", "-").alias("reference"),
        meta(1).alias("decision"), meta(2).alias("category"), meta(3).alias("decision_date"), head.alias("head"), F.get(told, at).alias("after"),
    )
    summary = F.when(F.col("head").isNotNull(), F.coalesce(_found(F.expr("substring(head, 9)")), F.col("after")))
    return cases.select("page_id", "place", "title", "reference", "decision", "category", "decision_date", summary.alias("summary"))


def decision_pages(texts: DataFrame, title: Column | None = None) -> DataFrame:
    """The case of each page whose address is a decision's; without any of its values it has none."""
    name = F.coalesce("h1", F.lit("") if title is None else title)
    label = lambda x: _found(F.regexp_extract("body", rf"(?imdU)^{x}\s*:\s*(.+?)\s*$", 1))
    rows = texts.filter(F.col("url").rlike(DECISION_URL)).select(
        "page_id", F.lit(0).alias("place"), name.alias("title"),
        F.nullif(F.regexp_replace(F.regexp_extract(name, r"(?U)\((\d{2}\s+\d{3}\s+\d{3})\)", 1), " ", "-"), F.lit("")).alias("reference"),
        label("Decision").alias("decision"), label("Category").alias("category"), label("Decision date").alias("decision_date"),
        _found(F.regexp_extract("body", r"(?imdU)^Summary:\s*(.+?)\s*$", 1)).alias("summary"),
    )
    return rows.filter(F.coalesce("reference", "decision", "category", "decision_date", "summary").isNotNull())


def _facts(rows: DataFrame, facts: tuple, prefix: Column, keep: list[str]) -> DataFrame:
    place = lambda p: F.concat(prefix, F.lit(p))
    each = F.array(*[F.struct(F.lit(t).alias("fact_type"), F.lit(p).alias("predicate"), F.col(c).alias("value_text"), place(at).alias("locator")) for t, p, c, at in facts])
    return rows.select(*keep, F.inline(F.filter(each, lambda x: F.coalesce(x["value_text"], F.lit("")) != "")))


def case_facts(pages: DataFrame, is_listing: Column | None = None) -> DataFrame:
    """(page_id, reference, case_name, listing_result, fact_type, predicate, value_text, locator) of pages (page_id, url, html).

    A decision's page gives its own case; of the others, those that are listings (all, unless a
    condition on url says which) give a case for each heading.
    """
    texts = page_texts(html_lines(pages))
    lists = texts.filter(~F.col("url").rlike(DECISION_URL)).filter(F.lit(True) if is_listing is None else is_listing)
    rows = decision_pages(texts).withColumn("listing_result", F.lit(False)).unionByName(listed_cases(lists).withColumn("listing_result", F.lit(True)))
    rows = rows.withColumn("case_name", F.coalesce("reference", "title"))
    prefix = F.when(F.col("listing_result"), F.concat(F.lit("search result "), "reference", F.lit(": "))).otherwise("decision page: ")
    return _facts(rows, CASE_FACTS, prefix, ["page_id", "reference", "case_name", "listing_result"])


def housing_facts(pages: DataFrame, landlord: str = LANDLORD, length: int | None = SECTION_LENGTH) -> DataFrame:
    """(page_id, case_id, landlord, fact_type, predicate, value_text, locator) of housing decisions.

    Labels are those of table rows, or else a line that begins with one; the determination is the
    section of the first heading that names it and has one, or else the text behind that name.  It
    is whole without a ``length``, as in all queries and jobs.
    """
    rows = html_outlines(pages.filter(F.col("url").rlike(HOUSING_URL)), "our decision|determination")
    label = lambda x: F.coalesce(_found(F.col("labels")[x.lower()]), _found(F.regexp_extract("body", rf"(?imdU)^{x}\s+(.+?)\s*$", 1)))
    legacy = _found(F.regexp_extract("body", r"(?isU)(?:Determination|Our decision)\s*(.*?)(?:Reasons|Orders|Recommendations|\z)", 1))
    found = F.coalesce(F.get("sections", F.lit(0)), legacy)
    rows = rows.select(
        "page_id", F.coalesce(label("Case ID"), F.regexp_extract("url", HOUSING_URL, 1)).alias("case_id"), label("Decision type").alias("decision_type"),
        F.coalesce(label("Landlord"), F.lit(landlord)).alias("landlord"), label("Date").alias("decision_date"),
        (found if length is None else F.substring(found, 1, length)).alias("determination"),
    )
    return _facts(rows, HOUSING_FACTS, F.lit(""), ["page_id", "case_id", "landlord"])


# Queries over the driver's tables -----------------------------------------------------------


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _case_pages(v) -> DataFrame:
    """Listings with every outcome and shape of markup, and decision pages."""
    rows = v("customer").withColumn("no", F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    return rows.select(F.col("c_custkey").alias("page_id"), F.expr("""CASE WHEN c_custkey % 5 = 4 THEN concat('https://l.example/decisions/a/b/23-001-', no) ELSE 'https://l.example/Decisions/SearchResults?page=1' END""").alias("url"),
        F.expr("""CASE WHEN c_custkey % 5 = 4 THEN concat('<h1>', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN concat(' (23 001 ', no, ')') ELSE '' END, '</h1><p>Category : Education &gt; ', c_mktsegment,
            '</p><p>Decision : Not upheld</p><p>Decision date : 22 Jan 2026</p><p>Summary: About ', c_name, '</p>')
          ELSE concat('<div>', c_mktsegment, ' Council (23 001 ', no, ')</div><div>', CASE WHEN c_custkey % 2 = 0 THEN 'Statement' ELSE 'Report' END, CASE WHEN c_custkey % 3 = 0 THEN '</div><span>' ELSE ' ' END,
            CASE c_custkey % 4 WHEN 0 THEN 'Upheld' WHEN 1 THEN 'Not upheld' WHEN 2 THEN 'Closed after initial enquiries' ELSE 'Withdrawn' END, CASE WHEN c_custkey % 3 = 0 THEN '</span><i>' ELSE ' ' END,
            'Adult care ', c_mktsegment, ' 05-Jan-2024</i><p><b>Summary:</b> About ', c_name, '</p><h2>B <a>(24 002 ', no, ')</a></h2><p>REPORT UPHELD Parking 09-Aug-2026</p><p>no summary</p>') END""").alias("html"))


def _housing_pages(v) -> DataFrame:
    return v("customer").select(F.col("c_custkey").alias("page_id"),
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'https://h.example/decisions/' ELSE concat('https://h.example/decisions/x-', 202400000 + c_custkey, '/') END").alias("url"),
        F.expr("""CASE c_custkey % 3
          WHEN 0 THEN concat('<h1>T</h1><table><tr><th>Case ID</th><td>', c_custkey, '</td></tr><tr><th>Decision type</th><td>Investigation</td></tr><tr><td>Landlord</td><td>', c_name,
            '</td></tr><tr><th>Date</th><td>24 April 2026</td></tr></table><h2>Our decision <b>(determination)</b></h2><div>We found ', c_mktsegment, '.</div>bare<ul><li>one</li><li>two</li></ul><h2>Summary of reasons</h2><p>x</p>')
          WHEN 1 THEN concat('<p>Case ID 9', c_custkey, '</p><p>Date 1 May 2025</p><section><h3>Our decision</h3></section><h3>Determination</h3><p>It is ', c_mktsegment, '</p><h1>End</h1><p>y</p>')
          ELSE concat('<p>Determination</p><p>Service failure by ', c_name, '</p><p>Orders</p><p>pay</p>') END""").alias("html"))


QUERIES = {
    "c15_extract_case_listings": _q(lambda v: case_facts(_case_pages(v), F.contains("url", F.lit("SearchResults")))),
    "c16_extract_decisions": _q(lambda v: housing_facts(_housing_pages(v), length=None)),
}
ORACLE = {k: with_views(q) for k, q in {
    "c15_extract_case_listings": """WITH c AS (SELECT c_custkey AS page_id, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS no, c_mktsegment AS m, c_name FROM customer),
      r AS (SELECT page_id, '23-001-' || no AS reference, m || ' Council' AS title, true AS listing_result, CASE page_id % 4 WHEN 0 THEN 'Upheld' WHEN 1 THEN 'Not upheld' WHEN 2 THEN 'Closed after initial enquiries' END AS decision,
          CASE WHEN page_id % 4 < 3 THEN 'Adult care ' || m END AS category, CASE WHEN page_id % 4 < 3 THEN '05-Jan-2024' END AS decision_date, 'About ' || c_name AS summary FROM c WHERE page_id % 5 <> 4
        UNION ALL SELECT page_id, '24-002-' || no, 'B', true, 'UPHELD', 'Parking', '09-Aug-2026', NULL FROM c WHERE page_id % 5 <> 4
        UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '23-001-' || no END, m || CASE WHEN page_id % 2 = 0 THEN ' (23 001 ' || no || ')' ELSE '' END, false, 'Not upheld', 'Education > ' || m, '22 Jan 2026', 'About ' || c_name FROM c WHERE page_id % 5 = 4),
      k(t, l) AS (VALUES ('OMBUDSMAN_CASE', 'case reference'), ('OMBUDSMAN_DECISION', 'Decision'), ('OMBUDSMAN_CATEGORY', 'Category'), ('OMBUDSMAN_DECISION_DATE', 'Decision date'), ('OMBUDSMAN_SUMMARY', 'summary')),
      f AS (SELECT *, coalesce(reference, title) AS case_name, CASE t WHEN 'OMBUDSMAN_CASE' THEN coalesce(reference, title) WHEN 'OMBUDSMAN_DECISION' THEN decision WHEN 'OMBUDSMAN_CATEGORY' THEN category
        WHEN 'OMBUDSMAN_DECISION_DATE' THEN decision_date ELSE summary END AS value_text FROM r, k)
      SELECT page_id, reference, case_name, listing_result, t AS fact_type, 'HAS_' || t AS predicate, value_text, CASE WHEN listing_result THEN 'search result ' || reference ELSE 'decision page' END || ': ' || l AS locator
      FROM f WHERE value_text IS NOT NULL""",
    "c16_extract_decisions": """WITH c AS (SELECT c_custkey AS page_id, c_custkey % 3 AS k, c_name, c_mktsegment AS m FROM customer WHERE c_custkey % 7 <> 0),
      r AS (SELECT page_id, CASE k WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN '9' || page_id ELSE (202400000 + page_id)::VARCHAR END AS case_id, CASE WHEN k = 0 THEN c_name ELSE 'Home Group Limited' END AS landlord,
          CASE WHEN k = 0 THEN 'Investigation' END AS kind, CASE k WHEN 0 THEN '24 April 2026' WHEN 1 THEN '1 May 2025' END AS day,
          CASE k WHEN 0 THEN 'We found ' || m || '. one two' WHEN 1 THEN 'It is ' || m ELSE 'Service failure by ' || c_name END AS found FROM c)
      SELECT page_id, case_id, landlord, 'HOUSING_OMBUDSMAN_CASE' AS fact_type, 'HAS_HOUSING_OMBUDSMAN_CASE' AS predicate, case_id AS value_text, 'Case ID' AS locator FROM r
      UNION ALL SELECT page_id, case_id, landlord, 'HOUSING_OMBUDSMAN_DECISION_TYPE', 'HAS_DECISION_TYPE', kind, 'Decision type' FROM r WHERE kind IS NOT NULL
      UNION ALL SELECT page_id, case_id, landlord, 'HOUSING_OMBUDSMAN_DECISION_DATE', 'HAS_DECISION_DATE', day, 'Date' FROM r WHERE day IS NOT NULL
      UNION ALL SELECT page_id, case_id, landlord, 'HOUSING_OMBUDSMAN_DETERMINATION', 'HAS_DETERMINATION', found, 'Our decision (determination)' FROM r""",
}.items()}

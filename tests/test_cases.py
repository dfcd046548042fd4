"""Facts of ombudsman cases from single pages."""

from pyspark.sql import functions as F

from evidentia.operators.cases import case_facts, housing_facts


def facts(spark, extract, url, html, **kwargs):
    pages = spark.createDataFrame([(1, url, html), (2, url, None), (3, url, ""), (4, "https://x.example/", "<p>other</p>")], "page_id long, url string, html string")
    return sorted((r.fact_type, r.value_text) for r in extract(pages, **kwargs).collect())


DECISION = "https://www.lgo.org.uk/decisions/education/special-educational-needs/25-000-276"
SEARCH = "https://www.lgo.org.uk/Decisions/SearchResults?page=1"
HOUSING = "https://www.housing-ombudsman.org.uk/decisions/home-group-limited-202427524/"


def test_decision_page(spark):
    html = """<html><body><h1>Cumberland Council (25 000 276)</h1>
    <p>Category : Education &gt; Special educational needs</p>
    <p>Decision : Upheld</p><p>Decision date : 22 Jan 2026</p>
    <h2>The Ombudsman's final decision:</h2>
    <p>Summary: There was fault by the Council and it agreed a remedy.</p></body></html>"""
    assert facts(spark, case_facts, DECISION, html) == [
        ("OMBUDSMAN_CASE", "25-000-276"), ("OMBUDSMAN_CATEGORY", "Education > Special educational needs"), ("OMBUDSMAN_DECISION", "Upheld"),
        ("OMBUDSMAN_DECISION_DATE", "22 Jan 2026"), ("OMBUDSMAN_SUMMARY", "There was fault by the Council and it agreed a remedy."),
    ]
    assert facts(spark, case_facts, DECISION, "<h1>Nothing known</h1><p>text</p>") == []
    assert facts(spark, case_facts, DECISION, "<h1>No number</h1><p>Decision: Upheld</p>") == [("OMBUDSMAN_CASE", "No number"), ("OMBUDSMAN_DECISION", "Upheld")]


def test_listing_with_every_outcome(spark):
    html = """<html><body><script>Fake Council (11 111 111)</script>
    <div>Westmorland and Furness Council (26 002 445)</div>
    <div>Statement Closed after initial enquiries Parking and other penalties 09-Aug-2026</div>
    <p>Summary: We will not investigate Mr X's complaint about parking restrictions.</p>
    <div>Westmorland and Furness Council (25 014 511)</div>
    <div>Statement Upheld Refuse and recycling 28-Apr-2026</div>
    <p>Summary: Miss X complained the Council repeatedly missed assisted collections.</p>
    <div>Third Council (25 014 512)</div><div>Report</div><span>not upheld</span><span>Adult care services</span><span>01-May-2026</span>
    <p><b>Summary:</b></p><p>On the next line.</p>
    <div>Fourth Council (25 014 513)</div><div>Statement Withdrawn Planning 01-May-2026</div></body></html>"""
    got = facts(spark, case_facts, SEARCH, html, is_listing=F.contains("url", F.lit("SearchResults")))
    of = lambda kind: [v for k, v in got if k == kind]
    assert of("OMBUDSMAN_CASE") == ["25-014-511", "25-014-512", "25-014-513", "26-002-445"]
    assert of("OMBUDSMAN_DECISION") == ["Closed after initial enquiries", "Upheld", "not upheld"]
    assert of("OMBUDSMAN_CATEGORY") == ["Adult care services", "Parking and other penalties", "Refuse and recycling"]
    assert of("OMBUDSMAN_DECISION_DATE") == ["01-May-2026", "09-Aug-2026", "28-Apr-2026"]
    assert len(of("OMBUDSMAN_SUMMARY")) == 3 and "On the next line." in of("OMBUDSMAN_SUMMARY")
    assert facts(spark, case_facts, SEARCH, html, is_listing=F.lit(False)) == []


def test_housing_decision(spark):
    html = """<html><body><h1>Home Group Limited (202427524)</h1>
    <table><tr><th>Case ID</th><td>202427524</td></tr><tr><th>Decision type</th><td>Investigation</td></tr>
    <tr><th>Landlord</th><td>Home Group Limited</td></tr><tr><th>Date</th><td>24 April 2026</td></tr></table>
    <h2>Our decision (determination)</h2><p>We found reasonable redress on one complaint.</p>
    <div>There was <b>no maladministration</b> in complaint handling.</div><h2>Summary of reasons</h2><p>Not this.</p></body></html>"""
    assert facts(spark, housing_facts, HOUSING, html) == [
        ("HOUSING_OMBUDSMAN_CASE", "202427524"), ("HOUSING_OMBUDSMAN_DECISION_DATE", "24 April 2026"),
        ("HOUSING_OMBUDSMAN_DECISION_TYPE", "Investigation"),
        ("HOUSING_OMBUDSMAN_DETERMINATION", "We found reasonable redress on one complaint. There was no maladministration in complaint handling."),
    ]


def test_housing_labels_without_a_table_and_sections_elsewhere(spark):
    html = """<p>Case ID 202200001</p><p>Landlord A Homes</p><section><h2>Our decision</h2></section><p>outside</p>
    <h3>Determination</h3><p></p><h3>Determination</h3><ul><li>one<ul><li>two</li></ul></li></ul><h4>Orders</h4><p>pay</p>"""
    got = dict(facts(spark, housing_facts, HOUSING, html))
    assert got == {"HOUSING_OMBUDSMAN_CASE": "202200001", "HOUSING_OMBUDSMAN_DETERMINATION": "one two"}
    legacy = dict(facts(spark, housing_facts, HOUSING, "<p>Determination</p><p>Service failure.</p><p>Reasons</p><p>no</p>"))
    assert legacy == {"HOUSING_OMBUDSMAN_CASE": "202427524", "HOUSING_OMBUDSMAN_DETERMINATION": "Service failure."}
    long = dict(facts(spark, housing_facts, HOUSING, f"<h2>Our decision</h2><p>{'x' * 5000}</p>"))
    assert len(long["HOUSING_OMBUDSMAN_DETERMINATION"]) == 4000
    assert facts(spark, housing_facts, "https://www.housing-ombudsman.org.uk/decisions/", html) == []


def test_housing_pages_are_parsed_once_and_not_joined(spark):
    pages = spark.createDataFrame([(1, HOUSING, "<p>Determination</p><p>x</p>")], "page_id long, url string, html string")
    plan = housing_facts(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan and "BroadcastExchange" not in plan


def test_housing_sections_of_nested_headings(spark):
    html = """<div><h2>Our <i>decision</i></h2>bare<div><h3>Part</h3><p>a</p><table><tr><td>Date</td></tr><tr><td> Date </td><td>1 <b>May</b></td><td>no</td></tr>
    <tr><td>date</td><td>later</td></tr></table></div><h1>Stop</h1><p>not this</p></div><h2>Determination</h2><p>second</p>"""
    assert dict(facts(spark, housing_facts, HOUSING, html)) == {
        "HOUSING_OMBUDSMAN_CASE": "202427524", "HOUSING_OMBUDSMAN_DECISION_DATE": "1 May", "HOUSING_OMBUDSMAN_DETERMINATION": "Part a Date Date 1 May no date later"}


def test_queries_and_jobs_give_whole_determinations(spark, monkeypatch):
    from evidentia.operators import cases, jobs

    told = "<p>" + "word " * 2000 + "end</p>"
    pages = spark.createDataFrame([(1, HOUSING, f"<h2>Our decision</h2>{told}"), (2, HOUSING, f"<p>Determination</p>{told}")], "page_id long, url string, html string")
    monkeypatch.setattr(cases, "_housing_pages", lambda v: pages)
    got = cases.QUERIES["c16_extract_decisions"](spark, "").filter("predicate = 'HAS_DETERMINATION'").collect()
    assert len(got) == 2 and all(len(r.value_text) == 10003 and r.value_text.endswith("word end") for r in got)

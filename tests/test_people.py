"""Declarations at meetings and the people they name."""

from evidentia.operators.extract import extract_council_pages
from evidentia.operators.people import people_of, person_id, page_host, resolve_people
from evidentia.sources.pages import html_blocks

MEETING = """<h1>Agenda and minutes</h1><h2>People Overview and Scrutiny Committee - Friday 26 June 2026 10.30 am</h2><table>
  <tr><td>PEOS.20/26</td><td>Disclosures of Interest Minutes: Councillor {0} declared a registrable interest in respect of agenda item 8.</td></tr></table>"""


def declared(spark, pages, known=None):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = resolve_people(extract_council_pages(html_blocks(df)), df, known).filter("predicate IN ('DECLARED_INTEREST_AT', 'DECLARATION_TEXT')")
    return {(r.page_id, r.predicate, r.subject_id, r.object is not None) for r in got.collect()}


def identity(spark, host, name):
    return spark.createDataFrame([(host, name)], "h string, n string").select(person_id("h", "n")).first()[0]


MEMBER = (1, "https://Cumberland.moderngov.co.uk/mgUserInfo.aspx?UID=151", "<h1>Councillor Michael Eldon</h1><p><span>Party:</span> Labour</p>")


def meeting(n, host, name):
    return (n, f"https://{host}/ieListDocuments.aspx?CId=174&MID={n}", MEETING.format(name))


def test_a_surname_stands_for_the_only_person_of_its_host(spark):
    eldon = identity(spark, "cumberland.moderngov.co.uk", "Michael Eldon")
    pages = [MEMBER, meeting(2, "cumberland.moderngov.co.uk", "Eldon"), meeting(3, "other.example", "Eldon"), meeting(4, "cumberland.moderngov.co.uk", "Don"), meeting(5, "other.example", "Ann Bell")]
    assert declared(spark, pages) == {
        (2, "DECLARED_INTEREST_AT", eldon, True), (3, "DECLARATION_TEXT", None, False), (4, "DECLARATION_TEXT", None, False),
        (5, "DECLARED_INTEREST_AT", identity(spark, "other.example", "ann bell"), True),
    }
    again = (6, "https://cumberland.moderngov.co.uk/mgUserInfo.aspx?UID=9", "<h1>Cllr Mrs Jo Eldon</h1><p>Party: Green</p>")
    assert (2, "DECLARATION_TEXT", None, False) in declared(spark, [*pages, again])


def test_people_of_earlier_runs_are_known(spark):
    df = spark.createDataFrame([MEMBER, MEMBER], "page_id long, url string, html string").dropDuplicates()
    known = people_of(extract_council_pages(html_blocks(df)), df.select("page_id", page_host("url").alias("host")))
    assert [(r.host, r.person_name) for r in known.collect()] == [("cumberland.moderngov.co.uk", "Michael Eldon")]
    later = [meeting(2, "cumberland.moderngov.co.uk", "Eldon")]
    assert {p for _, p, _, _ in declared(spark, later, known)} == {"DECLARED_INTEREST_AT"}
    assert {p for _, p, _, _ in declared(spark, later)} == {"DECLARATION_TEXT"}

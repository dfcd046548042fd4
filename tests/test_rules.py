"""Small cases of name functions, money, dates, components and pages."""

import difflib

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import extract, facts, ingest, lifecycle, publish, resolve
from evidentia.operators.components import connected_components
from evidentia.sources.pages import html_blocks


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_names(spark):
    got = values(spark, ["The Acme & Sons (Holdings) Ltd", "LIMITED", "O'Neil Company Limited by Guarantee Ltd", "  "], text.normalize_org_name("x"))
    assert [g[0] for g in got] == ["acme and sons holdings", "limited", "oneil", ""]


def test_channels_and_plausibility(spark):
    got = values(spark, ["NPOWER LTD (NCR)", "HMRC (chaps)", "01/02/2024", "Various", "12345", "3C Payment Limited", None],
                 text.without_channel("x"), text.payment_channel("x"), text.is_plausible_org_name("x"))
    assert got == [("NPOWER LTD", "NCR", True), ("HMRC", "CHAPS", True), ("", None, False), ("Various", None, False), ("12345", None, False),
                   ("3C Payment Limited", None, True), ("", None, False)]


def test_payee_class(spark):
    got = values(spark, ["Keswick T.C.", "HM Revenue & Customs", "Cumbria County Council", "99999", "Smith Ltd"], text.payee_class("x"))
    assert [g[0] for g in got] == ["public_authority", "tax_or_revenue_authority", "public_authority", "placeholder_or_accounting_code", None]


def test_money_is_half_even(spark):
    got = values(spark, ["£1,234.50", "(0.125)", "0.375", "x", ""], text.money("x"))
    assert [None if g[0] is None else str(g[0]) for g in got] == ["1234.50", "-0.12", "0.38", None, None]


def test_dates_are_day_first(spark):
    got = values(spark, ["03/04/2024", "2024-04-03", "soon"], text.iso_or_raw("x"))
    assert [g[0] for g in got] == ["2024-04-03", "2024-04-03", "soon"]


def test_kin_terms(spark):
    assert values(spark, ["My wife's brother and grandson"], text.kin_terms("x"))[0][0] == ["brother", "wife"]


def test_nfkc_only_where_needed(spark):
    df = spark.createDataFrame([("ＡＢＣ",), ("Straße",), ("Plain",), (None,)], "x string")
    assert sorted(r[0] or "" for r in text.nfkc_names(df, "x").collect()) == ["", "abc", "plain", "strasse"]


def test_ratio_is_difflibs(spark):
    df = spark.createDataFrame([("alpha beta", "alpah beta"), ("a", "b")], "a string, b string")
    for a, b, r in df.select("a", "b", resolve.ratcliff_ratio("a", "b").alias("r")).collect():
        assert r == difflib.SequenceMatcher(None, a, b).ratio()


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[1000 + k] for k in range(200)} == {1000} and len(got) == 261


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_reversion_gives_two_windows(spark):
    rows = [("d", "A", 1, 1), ("d", "A", 2, 2), ("d", "B", 3, 3), ("d", "A", 4, 4)]
    df = spark.createDataFrame(rows, "document_id string, snapshot_id string, retrieved_at int, observation_id int")
    islands = sorted((r.snapshot_id, r.valid_from, r.valid_to) for r in facts.snapshot_windows(df).collect())
    assert islands == [("A", 1, 3), ("A", 4, None), ("B", 3, 4)]
    assert all(r.valid_to for r in facts.snapshot_windows(df, "compat").collect())


def test_diff_ignores_loose_locators(spark):
    columns = "fact_id string, document_id string, snapshot_id string, fact_type string, subject_id string, predicate string, object_id string, value_text string, locator string"
    rows = [("1", "d", "s1", "OMBUDSMAN_CASE", None, "p", None, "v", "row 1"), ("2", "d", "s2", "OMBUDSMAN_CASE", None, "p", None, "v", "row 9"),
            ("3", "d", "s1", "PAYMENT", "a", "p", None, "10", "x"), ("4", "d", "s2", "PAYMENT", "a", "p", None, "11", "x")]
    windows = spark.createDataFrame([("d", "s1", 1, 2), ("d", "s2", 2, None)], "document_id string, snapshot_id string, valid_from int, valid_to int")
    got = facts.structured_diff(spark.createDataFrame(rows, columns), windows).collect()
    assert sorted((r.change_type, r.fact_id) for r in got) == [("FACT_ADDED", "4"), ("FACT_REMOVED", "3")]


def test_only_listed_types_lose_their_locator(spark):
    columns = "fact_id string, document_id string, snapshot_id string, fact_type string, subject_id string, predicate string, object_id string, value_text string, locator string"
    kinds = ["OMBUDSMAN_SUMMARY", "OMBUDSMAN_NOTE", "PAYMENT", "OMBUDSMAN"]
    rows = [(f"{k}{n}", "d", f"s{n}", k, None, "p", None, "v", f"row {n}") for k in kinds for n in (1, 2)]
    windows = spark.createDataFrame([("d", "s1", 1, 2), ("d", "s2", 2, None)], "document_id string, snapshot_id string, valid_from int, valid_to int")
    changes = facts.structured_diff(spark.createDataFrame(rows, columns), windows)
    assert sorted(r.fact_id for r in changes.collect()) == sorted(f"{k}{n}" for k in kinds[1:] for n in (1, 2))
    # of these, the report leaves out the pair of the family that may move, and no other
    docs = spark.createDataFrame([("d", "u", "t")], "document_id string, url string, title string")
    names = spark.createDataFrame([], "entity_id string, name string")
    report = facts.change_report(changes.withColumn("detected_at", F.lit(1)), docs, names)
    assert sorted(r.fact_type for r in report.collect()) == ["OMBUDSMAN", "OMBUDSMAN", "PAYMENT", "PAYMENT"]


def test_the_newest_decision_counts_once(spark):
    signals = spark.createDataFrame([("1", "review"), ("2", "approved"), ("3", "stale")], "signal_id string, status string")
    rows = [("1", "approve", 1), ("1", "approve", 1), ("2", "approve", 1), ("2", "withhold", 2), ("3", "archive", 1), ("9", "approve", 1), (None, "approve", 1), ("3", None, 1)]
    got, rejected = lifecycle.apply_decisions(signals, spark.createDataFrame(rows, "signal_id string, decision string, decided_at int"))
    assert sorted(map(tuple, got.collect())) == [("1", "approved"), ("2", "review"), ("3", "stale")]
    assert sorted(map(str, (tuple(r) for r in rejected.collect()))) == sorted(map(str, [("3", "archive", 1), ("9", "approve", 1), (None, "approve", 1), ("3", None, 1)]))


def test_stars_have_the_components_of_all_pairs(spark):
    """Entities of all rules, some with a channel or suffix in a group and some without."""
    named = ["Acme Works Ltd", "ACME WORKS", "Acme Works (CHAPS)", "Beta Hall", "beta hall", "Gamma Delta Partners LLP", "GammaDelta Partners", "Gamma Delta Partner", "Gamma Delta Partners",
             "Short", "SHORT", "Epsilon Long Name Services", "Epsilon Long Name Service", "Various", "12345", "Zeta (CHAPS)", "Zeta", "Eta Council"]
    rows = [(f"E{i:02}", "SUPPLIER" if i % 3 else "COMPANY", n, "contracts finder", "GB-COH" if i in (3, 11) else None, "77" if i in (3, 11) else None) for i, n in enumerate(named)]
    df = spark.createDataFrame(rows, "entity_id string, entity_type string, canonical_name string, source_system string, scheme string, identifier string")
    standard = resolve.standardise_names(df)
    pairs = resolve.resolve_members(df, resolve.all_matches(standard))
    stars = resolve.resolve_members(df, resolve.accepted_edges(standard))
    assert sorted(map(tuple, stars.collect())) == sorted(map(tuple, pairs.collect()))
    assert len({r.component for r in stars.collect()}) < len(rows)


def test_identifiers_of_named_parties(spark):
    release = """{"ocid":"o","buyer":{"name":"B"},"parties":[{"name":"B","roles":["buyer"],"identifier":{"scheme":"S","id":"1"},"additionalIdentifiers":[{"id":"2"},{"scheme":"T"}]},
      {"name":"N","roles":["tenderer"],"identifier":{"scheme":"S","id":"3"}}]}"""
    rows = extract.extract_ocds(extract.parse_releases(spark.createDataFrame([(release,)], "json string"))).filter("predicate = 'HAS_IDENTIFIER'").collect()
    assert sorted((r.party, r.value_text) for r in rows) == [("B", "S:1"), ("B", "unknown:2")]


def test_upsert_keeps_human_decisions(spark):
    schema = "match_id string, left_id string, right_id string, match_method string, confidence double, status string"
    old = spark.createDataFrame([("1", "a", "b", "m", 0.5, "rejected"), ("2", "a", "c", "m", 0.5, "review")], schema)
    new = spark.createDataFrame([("1", "a", "b", "m", 0.9, "auto_accepted"), ("2", "a", "c", "m", 0.9, "auto_accepted"), ("3", "b", "c", "m", 1.0, "review")], schema)
    assert {r.match_id: (r.confidence, r.status) for r in resolve.upsert_matches(old, new).collect()} == {"1": (0.9, "rejected"), "2": (0.9, "auto_accepted"), "3": (1.0, "review")}


def test_cycle_sweeps_only_what_ran(spark):
    schema = "signal_id string, signal_type string, status string, score double"
    state = spark.createDataFrame([("1", "A", "approved", 0.1), ("2", "B", "approved", 0.1), ("3", "A", "stale", 0.1)], schema)
    new = spark.createDataFrame([("3", "A", "review", 0.2)], schema)
    assert {r.signal_id: r.status for r in lifecycle.run_cycle(state, new, ran=["A"]).collect()} == {"1": "stale", "2": "approved", "3": "review"}


def test_gate_blanks_private_paths(spark):
    snaps = spark.createDataFrame([("s", "/home/x")], "snapshot_id string, archive_path string")
    gated, _ = publish.publication_gate({"snapshots": snaps, "claims": spark.createDataFrame([("c", "open")], "claim_id string, status string")})
    assert gated["snapshots"].first().archive_path == "" and gated["claims"].count() == 0
    assert publish.verify_boundary({"snapshots": snaps}).count() == 1


def test_canonical_url(spark):
    got = values(spark, ["HTTPS://Ex.ORG/A/?b=2&a=&a=1#x", "nothing"], ingest.canonical_url("x"))
    assert [g[0] for g in got] == ["https://ex.org/A/?a=&a=1&b=2", "nothing"]


def test_blocks_of_bad_markup(spark):
    pages = spark.createDataFrame([(1, "u", "<h1>A<p>b<ul><li>c<ul><li>d</li></ul><li>e</ul><script>x()</script>"), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    rows = html_blocks(pages).filter("tag = 'li'").orderBy("seq").collect()
    assert [(r.level, r.text) for r in rows] == [(1, "cd"), (2, "d"), (1, "e")] and {r.page_id for r in rows} == {1}


def test_redacted_answers_and_no_mail(spark):
    html = "<h1>Councillor Mrs Jo Day</h1><p>Email: a@b.example</p><h2>4. Land</h2><table><tr><td>12 High St</td></tr></table><h2>1. Work</h2><table><tr><td>Baker</td></tr></table>"
    pages = spark.createDataFrame([(1, "https://c/mgRofI.aspx?ID=1", html)], "page_id long, url string, html string")
    rows = {(r.subject, r.object, r.value_text) for r in extract.extract_council_pages(html_blocks(pages)).collect()}
    assert rows == {("Jo Day", "4", extract.REDACTION), ("Jo Day", "1", "Baker")}


def test_denied_file_wins(spark):
    rows = [("Spending over 500 private home", ["Supplier", "Amount"], True), ("Spending over 500", ["Supplier", "Amount"], False), ("x", ["Supplier", "Amount"], True), ("Spend over", ["Notes"], True)]
    df = spark.createDataFrame(rows, "file_text string, headers array<string>, by_header boolean")
    assert [r.file_text for r in extract.select_payment_files(df).collect()] == ["Spending over 500", "x"]


def test_bad_release_text(spark):
    df = extract.parse_releases(spark.createDataFrame([("{bad",), ('{"ocid":"o1","tender":{"title":"T"}}',), (None,)], "json string"))
    assert [(r.ocid, r.award_id, r.predicate) for r in extract.extract_ocds(df).collect()] == [("o1", "notice", "HAS_TITLE")]


def test_sink_rewrites_only_what_a_batch_touches(spark, tmp_path):
    from evidentia.streaming import streams

    columns = "document_id string, snapshot_id string, fact_type string, subject_id string, predicate string, object_id string, value_text string, locator string, metadata string"
    fact = lambda n, m: (f"d{n}", "s", "T", None, "p", None, str(n), None, m)
    batches = [[fact(n, "a") for n in range(300)], [fact(n, "b") for n in (3, 4, 400)], [fact(4, "c")]]
    upsert, want = streams.fact_upsert(str(tmp_path)), {}
    for number, rows in enumerate(batches):
        want |= {r[6]: r[8] for r in rows}
        for _ in range(2):  # a repeated batch changes nothing
            upsert(spark.createDataFrame(rows, columns), number)
            table = streams.read_sink(spark, str(tmp_path), number)
            assert {r.value_text: r.metadata for r in table.collect()} == want and table.count() == len(want)
    assert len(list((tmp_path / "data" / "2").glob("bucket=*"))) == 1
    assert len(list((tmp_path / "data" / "0").glob("bucket=*"))) < streams.SINK_BUCKETS

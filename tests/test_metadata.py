"""Lookups in JSON metadata, orderings of published tables, evidence of matches, runs of jobs."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidentia.functions.metadata import json_object, number_at, text_at
from evidentia.operators import jobs, publish, resolve


def test_lookups_in_good_and_bad_texts(spark):
    texts = ['{"a": "x", "n": 1.5}', '{"a": "x", "n": 1', "[1]", '"a"', "", None, "null", "{}", '{"a": null, "n": "1.5"}', '{"a": {"b": 1}, "n": true}', '{"a": 7, "n": -3}', '{"a": "é\\n", "n": 12345678901.25}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("o", json_object("t"))
    got = {r.i: (r.a, r.n) for r in df.select("i", text_at(F.col("o"), "a").alias("a"), number_at(F.col("o"), "n").alias("n")).collect()}
    none = (None, None)
    assert got == {0: ("x", Decimal("1.50")), 1: none, 2: none, 3: none, 4: none, 5: none, 6: none, 7: none, 8: none, 9: ('{"b":1}', None), 10: ("7", Decimal("-3.00")), 11: ("é\n", Decimal("12345678901.25"))}


def test_signals_are_published_by_the_interpretation_in_their_metadata(spark):
    kind = "SUPPLIER_PAYMENT_CONTRACT_OVERLAP"
    listed = publish.AUTO_PUBLIC[kind]
    rows = [("a", kind, "review", json.dumps({"interpretation": listed, "net_payment_total_gbp": 4, "payment_total_gbp": "4"}), 0.5),
            ("b", kind, "review", json.dumps({"interpretation": listed})[:-1], 0.5), ("c", kind, "review", None, 0.5)]
    told = publish.with_metadata(spark.createDataFrame(rows, "signal_id string, signal_type string, status string, metadata string, score double"))
    found = publish.public_findings(publish.publication_gate({"signals": told})[0]["signals"]).collect()
    assert [(r.id, r.category, r.amount) for r in found] == [("a", "documented_contract_link", Decimal("4.00"))]


def test_newest_first_where_times_are_known(spark):
    names = spark.createDataFrame([("x", "X")], "entity_id string, name string")
    signals = spark.createDataFrame([(f"s{i}", "T", 0.1 * i, "x", None, t) for i, t in enumerate([3, 1, 3, 2])], "signal_id string, signal_type string, score double, subject_id string, object_id string, updated_at int")
    fact = "fact_id string, fact_type string, predicate string, subject_id string, object_id string, value_text string, locator string, document_id string"
    facts = spark.createDataFrame([(f"f{i}", "P", "p", "x", None, None, None, f"d{i % 2}") for i in range(4)], fact)
    documents = spark.createDataFrame([("d0", "u0", 1), ("d1", "u1", 9)], "document_id string, url string, last_seen int")
    links = spark.createDataFrame([("s0", "f3"), ("s0", "f0"), ("s0", "f0"), ("gone", "f1"), ("s1", "missing")], "signal_id string, fact_id string")
    matches = spark.createDataFrame([(f"m{i}", "x", "x", "r", c, "accepted", t) for i, (c, t) in enumerate([(0.5, 1), (0.9, 1), (0.5, 2)])],
                                    "match_id string, left_id string, right_id string, match_method string, confidence double, status string, updated_at int")
    reviews = spark.createDataFrame([(f"r{i}", "I", s, "x", None, t) for i, (s, t) in enumerate([("open", 1), ("open", 5), ("closed", 0)])], "review_id string, item_type string, status string, subject_id string, object_id string, updated_at int")
    out = publish.api_tables({"signals": signals, "signal_evidence": links, "facts": facts, "documents": documents, "matches": matches, "reviews": reviews}, names)
    ids = lambda name, c: [r[c] for r in out[name].collect()]
    assert ids("signals", "signal_id") == ["s0", "s2", "s3", "s1"]
    assert ids("examples", "signal_id") == ["s0", "s2", "s3"]
    assert ids("facts", "fact_id") == ["f1", "f3", "f0", "f2"]
    assert ids("matches", "match_id") == ["m1", "m2", "m0"]
    assert ids("reviews", "review_id") == ["r2", "r1", "r0"]
    assert [(r.signal_id, r.fact_id, r.url) for r in out["signal_evidence"].collect()] == [("s0", "f0", "u0"), ("s0", "f3", "u1")]


def test_evidence_is_made_and_refreshed_and_decisions_stay(spark):
    rows = [("1", "SUPPLIER", "Acorn Works Ltd", "s", "GB-COH", "12"), ("2", "SUPPLIER", "Acorn Works", "s", "GB-COH", "1 2"), ("3", "SUPPLIER", "Acorn Works (CHAPS)", "s", None, None)]
    named = resolve.standardise_names(spark.createDataFrame(rows, "entity_id string, entity_type string, canonical_name string, source_system string, scheme string, identifier string"))
    found = resolve.all_matches(named).persist()
    got = {(r.match_method, r.left_id, r.right_id): json.loads(r.evidence) for r in found.collect()}
    assert got["identifier_exact", "1", "2"] == {"scheme": "gb-coh", "identifier": "12"}
    assert got["legal_suffix", "1", "2"] == {"normalized_name": "acorn works", "left_name": "Acorn Works Ltd", "right_name": "Acorn Works", "left_legal_suffix": "ltd", "right_legal_suffix": None}
    assert got["payment_channel", "2", "3"]["right_channel"] and got["payment_channel", "2", "3"]["left_channel"] is None
    old = found.filter("match_method = 'legal_suffix'").withColumns({"status": F.lit("rejected"), "evidence": F.lit("{}"), "confidence": F.lit(0.1)})
    again = {r.match_id: r for r in resolve.upsert_matches(old, found).collect()}
    assert len(again) == len(got)
    for r in found.filter("match_method = 'legal_suffix'").collect():
        assert (again[r.match_id].status, again[r.match_id].evidence, again[r.match_id].confidence) == ("rejected", r.evidence, 0.99)


def test_components_by_stars_equal_those_of_all_pairs(spark):
    from evidentia.sources.staging import view

    named = resolve.standardise_names(view(spark, "/root/testdata/sf0.001", "entities")).persist()
    pairs = resolve.all_matches(named)
    of = lambda edges: {(r.entity_id, r.component) for r in resolve.resolve_members(named, edges).collect()}
    assert of(resolve.accepted_edges(named)) == of(pairs)
    some = resolve.SURE
    assert of(resolve.accepted_edges(named, some)) == of(pairs.filter(F.col("match_method").isin(*some)))
    assert of(resolve.accepted_edges(named, ())) == {(r.entity_id, r.entity_id) for r in named.select("entity_id").collect()}


def test_jobs_of_unknown_and_silent_sources_are_counted(spark):
    rows = spark.createDataFrame([("1", "Acme (CHAPS)", "1,234.50", "31/01/2024"), ("2", None, "5", None), ("3", "B", "x", None)], "row_number string, `Supplier Name` string, Amount string, Date string")
    sources = [jobs.Source("a", "payments", "o1"), jobs.Source("b", "nothing"), jobs.Source("c", "grants")]
    ran = jobs.run_jobs(sources, {"a": rows, "b": rows})
    assert [(r.predicate, r.subject_id, r.value_text, r.locator) for r in ran.facts.collect()] == [("PAYMENT_TO_SUPPLIER", "o1", "1234.50", "CSV row 1")]
    assert {(r.source_id, r.known_kind, r.fact_count) for r in ran.counts.collect()} == {("a", True, 1), ("b", False, 0), ("c", True, 0)}
    none = jobs.run_jobs(sources, {"a": rows.limit(0)})
    assert none.facts.count() == 0 and none.counts.count() == 3
    with pytest.raises(ValueError):
        jobs.run_jobs([], {"a": rows})

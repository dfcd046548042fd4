"""Connections between people and suppliers: signals that share the evidence of a supplier."""

from evidentia.operators import detect, signals
from evidentia.operators.publish import publication_gate


def tables(spark, controllers=3):
    df = spark.createDataFrame
    return dict(
        payments=df([(f"p{i}", "C1", "S1", 10.0, None) for i in range(200)] + [("p900", "C1", None, 1.0, None)], "fact_id string, payer_id string, supplier_id string, amount double, payment_date date"),
        contract_suppliers=df([("r1", "S1", "K1"), ("r2", "S2", "K2")], "fact_id string, supplier_id string, contract_id string"),
        appointments=df([("o1", "P1", "B1"), ("o2", "P2", "B1"), ("o2", "P2", "B1"), ("o3", "P1", "B2"), ("o4", None, "B2")], "fact_id string, person_id string, body_id string"),
        declarations=df([("d1", "P1", "I own Acme Widgets Limited."), ("d2", "P2", "[REDACTED_FROM_STRUCTURED_DATA]"), ("d3", "P3", None), ("d4", "P4", "shares of Beta Tools"), ("d5", "P4", "Nobody")], "fact_id string, person_id string, value_text string"),
        aliases=df([("S1", "Acme Widgets Ltd"), ("S1", "Acme"), ("S2", "Beta Tools Ltd"), ("S3", "Nobody Known Ltd")], "entity_id string, name string"),
        control=df([(f"Q{i}", f"Jane Smith {'x' * i}", "S1") for i in range(controllers)] + [("Q90", "Jo", "S1"), ("Q91", "Al Gone", "S9")], "psc_id string, psc_name string, company_id string"),
        office=df([("h1", "P1", "JANE  SMITH", "MEMBER_OF"), ("h2", "P1", "Jane Smith", "REPRESENTS_WARD"), ("h3", "P2", "Al Gone", "MEMBER_OF"), ("h4", "P2", "Jane Smith x", "OTHER")], "fact_id string, person_id string, name string, predicate string"),
        interests=df([("i1", "P5", "My husband Jane  Smith works there"), ("i2", "P6", "Jane Smithson"), ("i3", "P7", "[REDACTED_FROM_STRUCTURED_DATA]")], "fact_id string, person_id string, value_text string"),
    )


def test_four_types_with_shared_sets(spark):
    got = signals.connections(**tables(spark))
    rows = {(r.signal_type, r.subject_id, r.object_id): (r.n_evidence, r.score) for r in got.signals.collect()}
    assert rows == {
        ("SHARED_OUTSIDE_BODY", None, "B1"): (2, 0.25),
        ("DECLARED_INTEREST_SUPPLIER_OVERLAP", "P1", "S1"): (202, 0.68),
        ("DECLARED_INTEREST_SUPPLIER_OVERLAP", "P4", "S2"): (2, 0.68),
        ("PSC_SUPPLIER_PUBLIC_OFFICEHOLDER_CANDIDATE", "Q0", "S1"): (203, 0.76),
        ("DECLARED_INTEREST_PSC_SUPPLIER_LINK", "P5", "S1"): (202, 0.84),
    }
    assert {(r.object_id, r.contract_supplier, r.payment_supplier) for r in got.candidates.collect()} == {("S1", True, True), ("S2", True, False)}
    assert sorted(r.score for r in signals.reviews_of(got.signals).collect()) == [0.68, 0.68, 0.76, 0.84]
    # evidence by way of the sets is as many distinct facts as each signal says
    evidence = got.refs.join(got.sets, "set_id").select("signal_id", "fact_id").distinct().groupBy("signal_id").count()
    assert {(r.signal_id, r["count"]) for r in evidence.collect()} == {(r.signal_id, r.n_evidence) for r in got.signals.collect()}
    assert publication_gate({"signals": got.signals})[0]["signals"].count() == 0  # nothing goes out without a person


def test_controllers_do_not_copy_their_suppliers_facts(spark):
    given = tables(spark, 400)
    given["office"] = given["control"].selectExpr("concat('h', psc_id) AS fact_id", "psc_id AS person_id", "psc_name AS name", "'MEMBER_OF' AS predicate")
    got = signals.connections(**given)
    assert got.signals.filter("signal_type LIKE 'PSC%'").count() == 400
    assert got.sets.count() <= 201 + 400 + 10 and got.refs.count() <= 2 * got.signals.count()


def test_closed_candidates_make_no_signal(spark):
    given = tables(spark)
    review = signals.connections(**given).candidates.filter("object_id = 'S1'").select("review_id").first()[0]
    reviewed = spark.createDataFrame([(review, "rejected"), ("unknown", "open")], "review_id string, status string")
    got = signals.connections(**given, reviewed=reviewed).signals.filter("signal_type = 'DECLARED_INTEREST_SUPPLIER_OVERLAP'")
    assert [r.object_id for r in got.collect()] == ["S2"]


def test_mentions_are_of_the_suppliers_that_are_asked_for(spark):
    t = tables(spark)
    found = lambda s: sorted((r.fact_id, r.entity_id) for r in detect.interest_mentions(t["declarations"], t["aliases"], s).collect())
    assert found(t["payments"]) == [("d1", "S1")]
    assert found(t["contract_suppliers"]) == [("d1", "S1"), ("d4", "S2")]
    assert detect.interest_mentions(t["declarations"], t["aliases"].limit(0), t["payments"]).count() == 0

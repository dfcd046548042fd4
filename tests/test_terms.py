"""Terms in texts by an index of grams, against a plain search."""

import random

from pyspark.sql import functions as F

from evidentia.operators import facts
from evidentia.operators.terms import indexed_terms, term_hits


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_twenty_thousand_terms(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 12)))
    terms = [f"District Council of {word()}{i % 977}" for i in range(19_960)] + ["a", "ÉÉ", "b c", "", None, "District Council of ", "a", "zzzzzzzzzz"] + [word() for _ in range(32)]
    texts = [(f"d{i}", " ".join(rng.choice([word(), rng.choice(terms) or "x", "DISTRICT council OF nowhere"]) for _ in range(6))) for i in range(120)]
    texts += [("null", None), ("empty", ""), ("d1", "a second text of d1 with zzzzzzzzzz"), (None, "a")]
    rules = spark.createDataFrame(list(enumerate(terms)), "rule_no int, term string").withColumn("organisation_id", F.concat(F.lit("o"), "rule_no"))
    docs = spark.createDataFrame(texts, "document_id string, doc_text string").withColumn("term", F.lit("clash"))
    got = {(r.document_id, r.rule_no) for r in term_hits(docs, rules, "doc_text").collect()}
    want = {(d, n) for d, t in texts if d is not None for n, x in enumerate(terms) if t and x and x.lower() in t.lower()}
    assert got == want and len(want) > 500
    first = {r.document_id: r.organisation_id for r in facts.first_rule(docs, rules, "doc_text").collect()}
    assert first == {d: f"o{min(n for e, n in want if e == d)}" for d in {d for d, _ in want}}
    text = plan(facts.first_rule(docs, rules, "doc_text"))
    assert "NestedLoop" not in text and "Cartesian" not in text
    # the common beginning stands for the one term that has nothing else
    assert indexed_terms(rules).filter("gram = 'distri'").count() <= 1


def test_no_terms(spark):
    docs = spark.createDataFrame([("d", "text")], "document_id string, doc_text string")
    assert term_hits(docs, spark.createDataFrame([], "rule_no int, term string"), "doc_text").count() == 0

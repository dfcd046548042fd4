"""How queries get their rows: what is shuffled, written and repeated for each signal."""

import re

from pyspark.sql import functions as F

from evidentia import registry
from evidentia.operators import detect, publish, signals
from evidentia.sources import staging
from evidentia.sources.pages import html_blocks, html_lines
from evidentia.sources.staging import stored_views, view

SF = "/root/testdata/sf0.001"


def exchanges(df) -> list[str]:
    """Keys of the shuffles by hash that a query plans."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_diffs_stay_in_partitions_of_their_document(spark):
    for name in ("b10_structured_diff", "b11_change_report"):
        keys = exchanges(registry.queries()[name](spark, SF))
        assert any("document_id" in k for k in keys) and not any("snapshot_id" in k for k in keys), name


def test_signals_of_one_item_share_its_blocks(spark):
    signals = spark.createDataFrame([(f"s{i}", "T", "review" if i == 9 else "approved") for i in range(10)], "signal_id string, signal_type string, status string")
    of = signals.select("signal_id", F.when(F.col("signal_id") < "s7", "hot").otherwise(F.lit("none")).alias("item_id"))
    chain = spark.range(25).select(F.lit("hot").alias("item_id"), F.concat(F.lit("f"), "id").alias("fact_id"), *[F.lit("x").alias(c) for c in publish.SHOWN[1:]])
    shared = publish.evidence_manifests(signals, chain, 10, of=of)
    alone = publish.evidence_manifests(signals, chain.join(of, "item_id").select(F.col("signal_id").alias("item_id"), *publish.SHOWN), 10)
    for a, b in zip(shared, alone):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    written = spark.read.parquet(shared.blocks.inputFiles()[0].rsplit("/", 1)[0])
    assert max(spark.read.parquet(f.rsplit("/", 1)[0]).count() for f in shared.blocks.inputFiles()) <= 10 and written.count() > 0


def test_stored_views_are_derived_once(spark):
    v = stored_views(spark, SF, "payments", "contracts")
    assert v("payments").inputFiles() == v("payments").inputFiles() and not any("lineitem" in f for f in v("evidence_facts").inputFiles())
    assert v("contract_values").count() == view(spark, SF, "contract_values").count()


def test_evidence_of_a_connection_counts_a_shared_fact_once(spark):
    suppliers = spark.createDataFrame([("S1", "f1"), ("S1", "f2")], "supplier_id string, fact_id string")
    held = spark.createDataFrame([("ann lee", "f2"), ("ann lee", "f3")], "key string, fact_id string")
    found = spark.createDataFrame([("Q1", "S1", "ann lee")], "psc_id string, company_id string, key string")
    assert [tuple(r) for r in detect.officeholder_evidence(found, suppliers, held).collect()] == [("Q1", "S1", "ann lee", 3, 0.76)]
    said = spark.createDataFrame([("Q1", "S1", f, "P", "") for f in ("f1", "f9")], "psc_id string, company_id string, fact_id string, person_id string, kin string")
    assert {r.fact_id: r.n_evidence for r in detect.declared_evidence(said, suppliers).collect()} == {"f1": 2, "f9": 3}
    bodies = spark.createDataFrame([("a", "P1", "B"), ("b", "P2", "B"), ("c", "P2", "C")], "fact_id string, person_id string, body_id string")
    assert {(r.person_id, r.fact_id, r.n) for r in detect.shared_body_evidence(bodies).collect()} == {("P1", "a", 2), ("P2", "b", 2)}


def test_pages_and_texts_of_one_file_are_many_tasks(spark):
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>x</p>").alias("html")).coalesce(1)
    for parse in (html_blocks, html_lines):
        assert any(k.startswith("page_id") for k in exchanges(parse(pages)))
    assert any("document_id" in k for k in exchanges(registry.queries()["c4_assign_payer"](spark, SF)))


def test_signals_are_derived_once_for_both_sides(spark):
    for name in ("h1_upsert_signals", "h3_run_cycle"):
        files = registry.queries()[name](spark, SF).inputFiles()
        assert files and not any("lineitem" in f for f in files), name


def test_timelines_of_large_entities_write_what_they_show(spark, monkeypatch):
    from evidentia.operators import ordered

    monkeypatch.setattr(ordered, "LIMIT", 100)
    got = publish.entity_timelines(view(spark, SF, "published_facts"))
    written = {c for f in got.inputFiles() for c in spark.read.parquet(f).columns}
    assert {"entity_id", "at", "fact_id"} <= written and not written & {"document_id", "value_text", "locator"}


def test_stored_and_incoming_facts_are_joined_once(spark):
    from evidentia.operators import facts

    columns = "document_id string, snapshot_id string, fact_type string, subject_id string, predicate string, object_id string, value_text string, locator string, metadata string"
    fact = lambda n, m: (f"d{n}", "s", "T", None, "p", None, str(n), None, m)
    old = facts.with_fact_id(spark.createDataFrame([fact(1, "a"), fact(2, "a"), fact(2, "b"), fact(3, "a"), fact(6, None)], columns))
    lost = old.limit(1).withColumns({"fact_id": F.lit(None).cast("string"), "value_text": F.lit("lost")})
    new = spark.createDataFrame([fact(2, "c"), fact(2, "d"), fact(3, None), fact(4, "e"), fact(4, None), fact(5, None)], columns)
    got = facts.add_facts(old.unionByName(lost), new)
    assert sorted((r.value_text, str(r.metadata)) for r in got.collect()) == [("1", "a"), ("2", "d"), ("2", "d"), ("3", "a"), ("4", "e"), ("5", "None"), ("6", "None"), ("lost", "a")]
    assert got.columns == old.columns and sum("fact_id" in k for k in exchanges(facts.add_facts(old, new))) == 2


def recorded(monkeypatch, *modules) -> list[list[str]]:
    """Columns of the tables that the modules write from now on."""
    written = []
    for m in modules:
        monkeypatch.setattr(m, "through_files", lambda df, path=None, real=m.through_files: written.append(df.columns) or real(df, path))
    return written


def test_candidates_need_no_facts_of_suppliers(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(detect, "phrase_mentions", lambda *a, real=detect.phrase_mentions, **b: searched.append(a) or real(*a, **b))
    written = recorded(monkeypatch, signals, staging)
    assert registry.queries()["g_candidate_reviews"](spark, SF).count() >= 0
    # texts are searched once, and neither payments nor sets are written for it
    assert len(searched) == 1 and written and not {c for w in written for c in w} & {"fact_id", "amount", "set_id"}, written


def test_changes_are_sorted_once(spark):
    for name in ("b10_structured_diff", "b11_change_report"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        sorts = [x for x in plan.splitlines() if re.search(r"\bSort \[", x) and re.search("old_snapshot_id|fact_id|value_text", x)]
        assert len(sorts) == 1, (name, sorts)
        # a fact that is there twice needs no groups of its own before
        assert len(re.findall(r"Aggregate\([^)]*fact_type", plan)) == 0 and plan.count("SortAggregate(key=[document_id") <= 4, name


def test_changes_are_not_shuffled_when_nothing_is_sent(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("b10_structured_diff", "b11_change_report"):
            keys = exchanges(registry.queries()[name](spark, SF))
            assert keys and not any(re.search("snapshot_id|_same|fact_type|value_text", k) for k in keys), keys
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sides_by_windows_are_sides_by_a_join(spark):
    import random

    from evidentia.operators import facts

    rng = random.Random(3)
    seen = [(f"d{rng.randint(0, 5)}", f"s{rng.randint(0, 3)}", i, rng.randint(0, 40)) for i in range(150)] + [("alone", "s", 200, 1)]
    obs = spark.createDataFrame(seen, "document_id string, snapshot_id string, observation_id long, t int").select(
        "document_id", "snapshot_id", "observation_id", F.timestamp_seconds("t").alias("retrieved_at"))
    windows = facts.snapshot_windows(obs)
    at = windows.groupBy("document_id", F.col("snapshot_id").alias("new_snapshot_id")).agg(F.max("valid_from").alias("detected_at"))
    want = obs.join(facts.diff_sides(windows), ["document_id", "snapshot_id"]).join(at, ["document_id", "new_snapshot_id"])
    got = facts.with_sides(obs)
    columns = sorted(got.columns)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(got) == rows(want) and got.count() > 300


def test_signals_of_streams_write_no_links(spark, monkeypatch):
    written = recorded(monkeypatch, signals)
    found, links = signals._found(stored_views(spark, SF, "payments", "contracts"))
    assert found.count() > 0 and not any("fact_id" in w for w in written), written
    # links may be of other streams too, and evidence is of the signals only, once each
    evidence = signals.evidence_of(found, links.unionByName(links))
    n = found.agg(F.sum("n_evidence")).first()[0]
    assert evidence.count() == n and evidence.join(found, "signal_id", "left_anti").count() == 0


def test_connections_keep_facts_of_named_suppliers_only(spark, monkeypatch):
    kept = []
    real = detect.supplier_facts
    monkeypatch.setattr(detect, "supplier_facts", lambda *a: kept.append(real(*a)) or kept[0])
    v = stored_views(spark, SF, "payments", "contracts")
    control = v("control").filter("company_id = 'S3'")
    signals.connections(v("payments"), v("contract_suppliers"), v("outside_bodies"), v("texts"), v("aliases").limit(0), control, v("office"), v("declared"))
    assert {r.supplier_id for r in kept[0].select("supplier_id").distinct().collect()} == {"S3"}

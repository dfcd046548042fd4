"""Fact store: facts with provenance, their validity windows, time travel and diffs.

A fact has fact_id, document_id, snapshot_id, fact_type, subject_id, predicate, object_id,
value_text, locator, evidence_class and metadata.  Windows are half-open: valid_from <= t < valid_to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.functions.ids import hashed, sql_hashed
from evidentia.sources.staging import view, with_views

from .ingest import _SNAP, snapshot_observations
from .ordered import LIMIT, Scan, asof, key_sizes, scanned
from .terms import term_hits

#: Fact types whose locator wording does not tell facts apart.
#: Types whose facts may move between pages of their source, and the start of their names and others'.
LOOSE_LOCATOR_TYPES = ("OMBUDSMAN_CASE", "OMBUDSMAN_DECISION", "OMBUDSMAN_CATEGORY", "OMBUDSMAN_DECISION_DATE", "OMBUDSMAN_SUMMARY")
MOVING_FAMILY = "OMBUDSMAN"
SIGNATURE = ("fact_type", "predicate", "subject_id", "object_id", "value_text", "compared_locator")


def entity_ids(df: DataFrame, kind, name, namespace=None) -> DataFrame:
    """Adds entity_id: hash of type, namespace and normalised name."""
    return df.withColumn("entity_id", hashed(kind, F.lit("") if namespace is None else namespace, text.normalize_name(name)))


def upsert_entities(existing: DataFrame, incoming: DataFrame, order: str = "seen_at") -> DataFrame:
    """One row an entity_id: the incoming row of largest ``order``, else the existing one."""
    rest = [c for c in existing.columns if c != "entity_id"]
    newest = incoming.groupBy("entity_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("entity_id", "r.*")
    return existing.join(newest.select("entity_id"), "entity_id", "left_anti").unionByName(newest)


def with_fact_id(facts: DataFrame) -> DataFrame:
    parts = ("document_id", "snapshot_id", "fact_type", "subject_id", "predicate", "object_id", "value_text", "locator")
    return facts.withColumn("fact_id", hashed(*parts))


def add_facts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by fact_id; a fact that is there already takes the incoming metadata only.

    One full join, so that each side is shuffled once.
    """
    fresh = with_fact_id(incoming)
    rest = [c for c in existing.columns if c != "fact_id"]
    fresh = fresh.groupBy("fact_id").agg(F.max(F.struct("metadata", *(c for c in rest if c != "metadata"))).alias("r")).select("fact_id", "r.*")
    e, n = existing.withColumn("_held", F.lit(True)).alias("e"), fresh.alias("n")
    both = e.join(n, F.col("e.fact_id") == F.col("n.fact_id"), "full")
    held = lambda c: F.coalesce(f"n.{c}", f"e.{c}") if c == "metadata" else F.col(f"e.{c}")
    return both.select(*[F.when(F.col("e._held"), held(c)).otherwise(F.col(f"n.{c}")).alias(c) for c in existing.columns])


def snapshot_windows(snapped: DataFrame, mode: str = "islands") -> DataFrame:
    """Validity windows of a document's snapshots.

    ``islands`` gives one window for each unbroken stretch of a snapshot, so content that comes
    back opens a new one.  ``compat`` keeps a snapshot's first window only, so a document whose
    content came back has none that is open.
    """
    order = [F.col("retrieved_at"), F.col("observation_id")]
    rows = snapped.select("document_id", "snapshot_id", "retrieved_at", "observation_id")
    sizes = key_sizes(rows, ["document_id"])
    rows = scanned(rows, ["document_id"], order, [Scan("before", "_before", "snapshot_id"), Scan("place", "_place")], sizes=sizes)
    starts = rows.filter((F.col("_place") == 1) | ~F.col("_before").eqNullSafe(F.col("snapshot_id")))
    starts = scanned(starts, ["document_id"], order, [Scan("after", "valid_to", "retrieved_at")], sizes=sizes)
    out = starts.select("document_id", "snapshot_id", F.col("retrieved_at").alias("valid_from"), "valid_to", "observation_id")
    if mode == "compat":
        first = Window.partitionBy("document_id", "snapshot_id").orderBy("valid_from", "observation_id")
        out = out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return out.drop("observation_id")


def latest_facts(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts of each document's latest snapshot that are not superseded."""
    latest = documents.select("document_id", F.col("latest_snapshot_id").alias("snapshot_id"))
    return facts.filter("predicate NOT LIKE 'SUPERSEDED_%'").join(latest, ["document_id", "snapshot_id"])


def current_facts(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Facts whose window is open."""
    still = windows.filter("valid_to IS NULL").select("document_id", "snapshot_id")
    return facts.filter("predicate NOT LIKE 'SUPERSEDED_%'").join(still, ["document_id", "snapshot_id"])


def facts_at(facts: DataFrame, windows: DataFrame, when) -> DataFrame:
    """Facts that held at one moment."""
    t = F.lit(when).cast("timestamp")
    held = windows.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))
    return facts.join(held.select("document_id", "snapshot_id"), ["document_id", "snapshot_id"])


def facts_asof(facts: DataFrame, windows: DataFrame, probes: DataFrame) -> DataFrame:
    """Facts that held at each probe (probe_id, document_id, at): windows of a document do not overlap."""
    p = probes.select("probe_id", "document_id", "at")
    found = asof(p, windows, "document_id", "at", "valid_from", "valid_to", ["snapshot_id"])
    return found.select("probe_id", "document_id", "snapshot_id").join(facts, ["document_id", "snapshot_id"])


def supersede_row_slots(facts: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Of the payment facts of one (document, snapshot, locator) only the newest keeps its predicate."""
    pay = F.col("fact_type") == "PAYMENT"
    rows = scanned(facts.withColumn("_pay", pay), ["document_id", "snapshot_id", "locator", "_pay"], [F.desc(order), F.desc("fact_id")], [Scan("place", "_place")])
    older = F.col("_pay") & (F.col("_place") > 1) & ~F.col("predicate").startswith("SUPERSEDED_")
    return rows.withColumn("predicate", F.when(older, F.concat(F.lit("SUPERSEDED_"), "predicate")).otherwise(F.col("predicate"))).select(facts.columns)


def first_rule(docs: DataFrame, rules: DataFrame, text_col: str) -> DataFrame:
    """document_id and organisation_id of the first rule (rule_no, organisation_id, term) whose term is in the text.

    Terms are found by an index of their grams (``terms.term_hits``), at any number of rules.
    """
    hit = term_hits(docs, rules, text_col).join(rules.select("rule_no", F.lower("term").alias("term"), "organisation_id"), ["rule_no", "term"])
    return hit.groupBy("document_id").agg(F.min_by("organisation_id", F.struct("rule_no", "organisation_id")).alias("organisation_id"))


def repair_payer(facts: DataFrame, documents: DataFrame, rules: DataFrame, default_org: str) -> DataFrame:
    """Payment facts of documents of a predecessor: a corrected fact each, the old one superseded."""
    found = first_rule(documents, rules, "doc_text").filter(F.col("organisation_id") != default_org)
    pay = F.col("predicate") == "PAYMENT_TO_SUPPLIER"
    joined = facts.join(found, "document_id", "left")
    wrong = pay & F.col("organisation_id").isNotNull() & ~F.col("subject_id").eqNullSafe(F.col("organisation_id"))
    old = joined.withColumn("predicate", F.when(wrong, F.concat(F.lit("SUPERSEDED_"), "predicate")).otherwise(F.col("predicate")))
    new = with_fact_id(joined.filter(wrong).withColumn("subject_id", F.col("organisation_id")))
    return old.select(facts.columns).unionByName(new.select(facts.columns))


def diff_sides(windows: DataFrame, *more: str) -> DataFrame:
    """(document_id, snapshot_id, old_snapshot_id, new_snapshot_id, change_type): each window's snapshot, in which a fact
    is added, and the one before it in its document, from which it is removed; ``more`` are columns that tell of the new one."""
    order = Window.partitionBy("document_id").orderBy("valid_from", "snapshot_id")
    steps = windows.withColumn("old_snapshot_id", F.lag("snapshot_id").over(order)).filter("old_snapshot_id IS NOT NULL")
    steps = steps.select("document_id", "old_snapshot_id", F.col("snapshot_id").alias("new_snapshot_id"), *more).distinct()
    sides = F.array(*[F.struct(F.col(c).alias("snapshot_id"), F.lit(t).alias("change_type")) for c, t in (("old_snapshot_id", "FACT_REMOVED"), ("new_snapshot_id", "FACT_ADDED"))])
    return steps.select("document_id", "old_snapshot_id", "new_snapshot_id", *more, F.inline(sides))


def with_sides(snapped: DataFrame) -> DataFrame:
    """Observations, once for each of the ``diff_sides`` of their snapshot, with detected_at: when the new snapshot's last window began.

    Only windows within the document: as a join with the steps is on the snapshot too, it would take
    rows out of the partitions of their document, and what they become would be shuffled once more.
    """
    box = F.struct("snapshot_id")
    before = F.lag(box).over(Window.partitionBy("document_id").orderBy("retrieved_at", "observation_id"))
    rows = snapped.withColumn("_opens", ~before.eqNullSafe(box))
    own = Window.partitionBy("document_id", "snapshot_id")
    rows = rows.withColumn("detected_at", F.max(F.when(F.col("_opens"), F.col("retrieved_at"))).over(own))
    order, at = Window.partitionBy("document_id", "_opens").orderBy("retrieved_at", "snapshot_id"), F.struct("snapshot_id", "detected_at")
    rows = rows.withColumns({"_old": F.lag("snapshot_id").over(order), "_new": F.lead(at).over(order)})
    side = lambda old, new, detected, kind, there: F.collect_set(F.when(F.col("_opens") & there.isNotNull(), F.struct(
        old.alias("old_snapshot_id"), new.alias("new_snapshot_id"), detected.alias("detected_at"), F.lit(kind).alias("change_type")))).over(own)
    c = F.col
    rows = rows.withColumns({
        "_added": side(c("_old"), c("snapshot_id"), c("detected_at"), "FACT_ADDED", c("_old")),
        "_removed": side(c("snapshot_id"), c("_new.snapshot_id"), c("_new.detected_at"), "FACT_REMOVED", c("_new"))})
    return rows.select(*snapped.columns, F.inline(F.concat("_added", "_removed")))


def structured_diff(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """FACT_REMOVED and FACT_ADDED between each window's snapshot and the one before it in its document.

    Facts are the same if type, predicate, subject, object, value and locator are; types of
    LOOSE_LOCATOR_TYPES compare without their locator.  Facts that come in partitions of their
    document are not shuffled again.
    """
    return diff_of(facts.join(diff_sides(windows), ["document_id", "snapshot_id"]))


def diff_of(rows: DataFrame, *more: str, moved: bool = True) -> DataFrame:
    """``structured_diff`` of facts that have their ``diff_sides``; a fact may be there more than once.

    Without ``moved`` ones, see ``change_report``.  Rows that lie in partitions of their document stay
    there, and are sorted once, for groups and windows: what groups have in common leads their keys.
    """
    loose = F.coalesce(F.col("fact_type").isin(*LOOSE_LOCATOR_TYPES), F.lit(False))
    step = ["document_id", "old_snapshot_id", "new_snapshot_id"]
    rows = rows.withColumns({"compared_locator": F.when(~loose, F.col("locator")), "_same": F.struct(*SIGNATURE[:-1])})
    out = rows.groupBy(*step, "_same", "compared_locator").agg(
        F.min("change_type").alias("change_type"), F.max("change_type").alias("_other"),
        F.min("fact_id").alias("fact_id"), F.min("locator").alias("locator"), *[F.min(c).alias(c) for c in more],
    ).filter("change_type = _other")
    if not moved:
        out = out.withColumn("_moved", _moved(Window.partitionBy(*step, "_same"), F.col("_same.fact_type"))).filter("NOT _moved")
    out = out.select(*step, "_same.*", "compared_locator", "fact_id", "locator", "change_type", *more)
    return out.withColumn("change_id", hashed(*step, "change_type", *SIGNATURE)).drop("compared_locator")


def _moved(over, fact_type: Column) -> Column:
    return F.coalesce((F.min("change_type").over(over) != F.max("change_type").over(over)) & fact_type.rlike(f"(?s)^{MOVING_FAMILY}."), F.lit(False))


def change_report(changes: DataFrame, documents: DataFrame, names: DataFrame, limit: int = 500) -> DataFrame:
    """Newest changes with their document and names.

    Of MOVING_FAMILY types, pairs of removal and addition that differ in the locator only are left
    out; of other types they are changes, such as a payment that stands in another row.
    """
    # a window in place of a join of the changes with themselves
    over = Window.partitionBy("document_id", "old_snapshot_id", "new_snapshot_id", *SIGNATURE[:-1])
    return newest_changes(changes.withColumn("_moved", _moved(over, F.col("fact_type"))).filter("NOT _moved").drop("_moved"), documents, names, limit)


def newest_changes(real: DataFrame, documents: DataFrame, names: DataFrame, limit: int = 500) -> DataFrame:
    """``change_report`` of changes without the moved ones; names, which leave out no row, are joined to the newest only."""
    name = lambda c: names.select(F.col("entity_id").alias(c), F.col("name").alias(c.replace("_id", "_name")))
    newest = lambda df: df.orderBy(F.desc("detected_at"), "change_id").limit(limit)
    full = newest(real.join(documents.select("document_id", "url", "title"), "document_id"))
    full = full.join(name("subject_id"), "subject_id", "left").join(name("object_id"), "object_id", "left")
    return newest(full)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def recent(df: DataFrame, ts: str, n: int = 100, tie: str = "document_id") -> DataFrame:
    """Newest rows."""
    return df.orderBy(F.desc(ts), tie).limit(n)


# Queries over the driver's tables -----------------------------------------------------------


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _in_partitions(v) -> bool:
    """No document has more observations than a task may take."""
    return key_sizes(snapshot_observations(v("observations")), ["document_id"])[0] <= LIMIT


def _observed(v, small: bool | None = None) -> DataFrame:
    """Observations with their value.

    They go to partitions of their document before they become facts, unless one has more rows than a task may take.
    """
    snapped = snapshot_observations(v("observations").join(v("events").select(F.col("event_id").alias("observation_id"), "value"), "observation_id"))
    if _in_partitions(v) if small is None else small:
        snapped = snapped.select("document_id", "snapshot_id", "observation_id", "retrieved_at", "value", "body", "title").repartition("document_id")
    return snapped


def _facts(v) -> DataFrame:
    return _facts_of(_observed(v))


def _facts_of(snapped: DataFrame, *more: str) -> DataFrame:
    """Three facts an observation: its value, its properties and its title."""
    locator = F.when(F.col("observation_id") % 2 == 0, F.concat(F.lit("row "), "observation_id"))
    base = snapped.select(
        "document_id", "snapshot_id", "observation_id", *more,
        F.explode(F.array(
            F.struct(F.lit("PAYMENT").alias("fact_type"), F.lit("HAS_VALUE").alias("predicate"), F.col("value").cast("decimal(18,2)").cast("string").alias("value_text")),
            F.struct(F.lit("OMBUDSMAN_SUMMARY").alias("fact_type"), F.lit("HAS_PROPS").alias("predicate"), F.col("body").alias("value_text")),
            F.struct(F.lit("OMBUDSMAN_NOTE").alias("fact_type"), F.lit("HAS_TITLE").alias("predicate"), F.col("title").alias("value_text")),
        )).alias("f"), locator.alias("locator"),
    )
    return base.select(
        "document_id", "snapshot_id", "f.fact_type", F.lit(None).cast("string").alias("subject_id"), "f.predicate",
        F.lit(None).cast("string").alias("object_id"), "f.value_text", "locator",
        F.concat(F.lit("m"), "observation_id").alias("metadata"), *more,
    )


def _stored(v) -> DataFrame:
    """Facts by id, once each."""
    f = with_fact_id(_facts(v))
    return f.groupBy(*(c for c in f.columns if c != "metadata")).agg(F.max("metadata").alias("metadata"))


def _windows(v, mode: str = "islands") -> DataFrame:
    return snapshot_windows(snapshot_observations(v("observations")), mode)


def _changes(v, moved: bool = True) -> DataFrame:
    """Changes of the facts of observations, which meet the sides of their steps before they become facts: fewer and narrower rows are sorted."""
    if small := _in_partitions(v):
        sided = with_sides(_observed(v, small))
    else:
        windows = _windows(v).withColumn("detected_at", F.max("valid_from").over(Window.partitionBy("document_id", "snapshot_id")))
        sided = _observed(v, small).join(diff_sides(windows, "detected_at"), ["document_id", "snapshot_id"])
    return diff_of(with_fact_id(_facts_of(sided, "old_snapshot_id", "new_snapshot_id", "change_type", "detected_at")), "detected_at", moved=moved)


def _documents(v) -> DataFrame:
    at = F.struct("retrieved_at", "observation_id")
    return snapshot_observations(v("observations")).groupBy("document_id").agg(
        F.max_by("snapshot_id", at).alias("latest_snapshot_id"), F.first("url").alias("url"), F.max_by("title", at).alias("title"))


def _slots(v) -> DataFrame:
    return v("lineitem").select(
        F.concat(F.lit("D"), F.col("l_suppkey")).alias("document_id"), F.lit("x").alias("snapshot_id"), F.lit("PAYMENT").alias("fact_type"),
        F.lit("PAYMENT_TO_SUPPLIER").alias("predicate"), (F.col("l_orderkey") % 500).cast("string").alias("locator"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("fact_id"), "l_shipdate")


def _payer_facts(v) -> DataFrame:
    return v("payments").select(
        "fact_id", F.col("payer_id").alias("document_id"), F.lit("s").alias("snapshot_id"), F.lit("PAYMENT").alias("fact_type"), F.lit("C1").alias("subject_id"),
        F.lit("PAYMENT_TO_SUPPLIER").alias("predicate"), F.col("supplier_id").alias("object_id"), F.col("amount").cast("string").alias("value_text"),
        F.col("fact_id").alias("locator"), F.lit("").alias("metadata"))


def _payer_rules(v) -> DataFrame:
    return v("region").select(F.col("r_regionkey").alias("rule_no"), F.concat(F.lit("R"), "r_regionkey").alias("organisation_id"), F.substring("r_name", 1, 2).alias("term"))


def _payer_docs(v) -> DataFrame:
    return v("nation").select(F.concat(F.lit("C"), "n_nationkey").alias("document_id"), F.col("n_name").alias("doc_text"))


_SHOWN = ("fact_id", "document_id", "snapshot_id", "predicate", "value_text")
QUERIES = {
    "b1_entity_ids": _q(lambda v: entity_ids(v("entities"), "entity_type", "canonical_name", "source_system").select("entity_id", "canonical_name")),
    "b2_upsert_entities": _q(lambda v: upsert_entities(
        v("customer").select(F.col("c_nationkey").alias("entity_id"), "c_name", F.col("c_custkey").alias("seen_at")).groupBy("entity_id").agg(F.min("c_name").alias("c_name"), F.min("seen_at").alias("seen_at")),
        v("customer").select((F.col("c_nationkey") + 12).alias("entity_id"), "c_name", F.col("c_custkey").alias("seen_at")))),
    "b3_add_facts": _q(lambda v: add_facts(_stored(v).filter("metadata < 'm5'"), _facts(v).filter("metadata >= 'm3'")).select(*_SHOWN, "metadata")),
    "b4_snapshot_windows": _q(_windows),
    "b4_snapshot_windows_compat": _q(lambda v: _windows(v, "compat")),
    "b5_latest_facts": _q(lambda v: latest_facts(_stored(v), _documents(v)).select(*_SHOWN)),
    "b6_current_facts": _q(lambda v: current_facts(_stored(v), _windows(v)).select(*_SHOWN)),
    "b7_facts_at": _q(lambda v: facts_at(_stored(v), _windows(v), "2024-01-15 00:00:00").select(*_SHOWN)),
    "b7_facts_asof": _q(lambda v: facts_asof(_stored(v), _windows(v), snapshot_observations(v("observations")).select(
        F.col("observation_id").alias("probe_id"), "document_id", (F.col("retrieved_at") + F.expr("INTERVAL 1 HOUR")).alias("at"))).select("probe_id", *_SHOWN)),
    "b8_supersede_row_slots": _q(lambda v: supersede_row_slots(_slots(v), "l_shipdate").select("fact_id", "document_id", "locator", "predicate")),
    "b9_repair_payer": _q(lambda v: repair_payer(_payer_facts(v), _payer_docs(v), _payer_rules(v), "R0").select("fact_id", "subject_id", "predicate", "locator")),
    "b10_structured_diff": _q(lambda v: _changes(v).select("change_id", "change_type", "fact_id", "document_id", "new_snapshot_id")),
    "b11_change_report": _q(lambda v: newest_changes(_changes(v, moved=False), _documents(v), v("names")).select("change_id", "change_type", "fact_type", "url", "title", "detected_at")),
    "b12_table_counts": _q(lambda v: table_counts({n: v(n) for n in ("orders", "customer", "events", "payments")})),
    "b12_recent": _q(lambda v: recent(v("events").select("event_id", "ts"), "ts", 100, "event_id")),
}

_FACT_PARTS = ("document_id", "snapshot_id", "fact_type", "NULL", "predicate", "NULL", "value_text", "locator")
_F = f"""WITH sn AS ({_SNAP}), b AS (SELECT sn.*, value FROM sn JOIN events ON event_id = observation_id),
 f0 AS (SELECT document_id, snapshot_id, 'PAYMENT' AS fact_type, 'HAS_VALUE' AS predicate, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value_text,
   CASE WHEN observation_id % 2 = 0 THEN 'row ' || observation_id END AS locator, 'm' || observation_id AS metadata FROM b
  UNION ALL SELECT document_id, snapshot_id, 'OMBUDSMAN_SUMMARY', 'HAS_PROPS', body, CASE WHEN observation_id % 2 = 0 THEN 'row ' || observation_id END, 'm' || observation_id FROM b
  UNION ALL SELECT document_id, snapshot_id, 'OMBUDSMAN_NOTE', 'HAS_TITLE', title, CASE WHEN observation_id % 2 = 0 THEN 'row ' || observation_id END, 'm' || observation_id FROM b),
 f1 AS (SELECT *, {sql_hashed(*_FACT_PARTS)} AS fact_id FROM f0),
 f AS (SELECT fact_id, document_id, snapshot_id, fact_type, predicate, value_text, locator, max(metadata) AS metadata FROM f1 GROUP BY ALL),
 i AS (SELECT *, lag(snapshot_id) OVER (PARTITION BY document_id ORDER BY retrieved_at, observation_id) AS prev FROM sn),
 w AS (SELECT document_id, snapshot_id, retrieved_at AS valid_from, lead(retrieved_at) OVER (PARTITION BY document_id ORDER BY retrieved_at, observation_id) AS valid_to
   FROM i WHERE prev IS DISTINCT FROM snapshot_id),
 st AS (SELECT DISTINCT document_id, old_snapshot_id, snapshot_id AS new_snapshot_id FROM (SELECT *, lag(snapshot_id) OVER (PARTITION BY document_id ORDER BY valid_from, snapshot_id) AS old_snapshot_id FROM w) WHERE old_snapshot_id IS NOT NULL),
 k AS (SELECT *, CASE WHEN fact_type IN ('OMBUDSMAN_CASE', 'OMBUDSMAN_DECISION', 'OMBUDSMAN_CATEGORY', 'OMBUDSMAN_DECISION_DATE', 'OMBUDSMAN_SUMMARY') THEN NULL ELSE locator END AS cl FROM f),
 r AS (SELECT st.*, fact_type, predicate, value_text, cl, fact_id, locator, 0 AS isnew FROM st JOIN k ON k.document_id = st.document_id AND k.snapshot_id = old_snapshot_id
   UNION ALL SELECT st.*, fact_type, predicate, value_text, cl, fact_id, locator, 1 FROM st JOIN k ON k.document_id = st.document_id AND k.snapshot_id = new_snapshot_id),
 d AS (SELECT document_id, old_snapshot_id, new_snapshot_id, fact_type, predicate, value_text, cl, min(fact_id) AS fact_id, CASE WHEN max(isnew) = 1 THEN 'FACT_ADDED' ELSE 'FACT_REMOVED' END AS change_type
   FROM r GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING min(isnew) = max(isnew)),
 dc AS (SELECT *, {sql_hashed('document_id', 'old_snapshot_id', 'new_snapshot_id', 'change_type', 'fact_type', 'predicate', 'NULL', 'NULL', 'value_text', 'cl')} AS change_id FROM d)
"""
_S = "fact_id, f.document_id, f.snapshot_id, predicate, value_text"
ORACLE = {k: with_views(q) for k, q in {
    "b1_entity_ids": f"SELECT {sql_hashed('entity_type', 'source_system', 'lower(' + text.sql_squeeze('canonical_name') + ')')} AS entity_id, canonical_name FROM {{entities}}",
    "b2_upsert_entities": """SELECT c_nationkey + 12 AS entity_id, arg_max(c_name, c_custkey) AS c_name, max(c_custkey) AS seen_at FROM customer GROUP BY 1
      UNION ALL SELECT c_nationkey, min(c_name), min(c_custkey) FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey + 12 FROM customer) GROUP BY 1""",
    "b3_add_facts": _F + """, e AS (SELECT * FROM f WHERE metadata < 'm5'), n AS (SELECT fact_id, document_id, snapshot_id, predicate, value_text, max(metadata) AS metadata FROM f1 WHERE metadata >= 'm3' GROUP BY ALL)
      SELECT coalesce(e.fact_id, n.fact_id) AS fact_id, coalesce(e.document_id, n.document_id) AS document_id, coalesce(e.snapshot_id, n.snapshot_id) AS snapshot_id,
      coalesce(e.predicate, n.predicate) AS predicate, coalesce(e.value_text, n.value_text) AS value_text, coalesce(n.metadata, e.metadata) AS metadata FROM e FULL JOIN n ON e.fact_id = n.fact_id""",
    "b4_snapshot_windows": _F + "SELECT * FROM w",
    "b4_snapshot_windows_compat": _F + "SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY document_id, snapshot_id ORDER BY valid_from) = 1",
    "b5_latest_facts": _F + f", l AS (SELECT document_id, arg_max(snapshot_id, (retrieved_at, observation_id)) AS snapshot_id FROM sn GROUP BY 1) SELECT {_S} FROM f JOIN l USING (document_id, snapshot_id)".replace("f.document_id", "document_id").replace("f.snapshot_id", "snapshot_id"),
    "b6_current_facts": _F + f"SELECT {_S} FROM f JOIN w ON w.document_id = f.document_id AND w.snapshot_id = f.snapshot_id WHERE valid_to IS NULL",
    "b7_facts_at": _F + f"SELECT {_S} FROM f JOIN w ON w.document_id = f.document_id AND w.snapshot_id = f.snapshot_id WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')",
    "b7_facts_asof": _F + f""", p AS (SELECT observation_id AS probe_id, document_id, retrieved_at + INTERVAL 1 HOUR AS t FROM sn)
      SELECT probe_id, {_S} FROM p JOIN w ON w.document_id = p.document_id AND valid_from <= t AND (valid_to IS NULL OR t < valid_to) JOIN f ON f.document_id = w.document_id AND f.snapshot_id = w.snapshot_id""",
    "b8_supersede_row_slots": """WITH s AS (SELECT 'D' || l_suppkey AS document_id, CAST(l_orderkey % 500 AS VARCHAR) AS locator, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS fact_id, l_shipdate FROM lineitem)
      SELECT fact_id, document_id, locator, CASE WHEN row_number() OVER (PARTITION BY document_id, locator ORDER BY l_shipdate DESC, fact_id DESC) > 1 THEN 'SUPERSEDED_' ELSE '' END || 'PAYMENT_TO_SUPPLIER' AS predicate FROM s""",
    "b9_repair_payer": f"""WITH h AS (SELECT 'C' || n_nationkey AS document_id, arg_min('R' || r_regionkey, r_regionkey) AS org FROM nation JOIN region ON contains(lower(n_name), lower(substring(r_name, 1, 2))) GROUP BY 1),
      x AS (SELECT fact_id, supplier_id, amount, payer_id, CASE WHEN org <> 'R0' THEN org END AS org FROM {{payments}} LEFT JOIN h ON document_id = payer_id)
      SELECT fact_id, 'C1' AS subject_id, CASE WHEN org IS NULL THEN 'PAYMENT_TO_SUPPLIER' ELSE 'SUPERSEDED_PAYMENT_TO_SUPPLIER' END AS predicate, fact_id AS locator FROM x
      UNION ALL SELECT {sql_hashed('payer_id', "'s'", "'PAYMENT'", 'org', "'PAYMENT_TO_SUPPLIER'", 'supplier_id', 'amount', 'fact_id')}, org, 'PAYMENT_TO_SUPPLIER', fact_id FROM x WHERE org IS NOT NULL""",
    "b10_structured_diff": _F + "SELECT change_id, change_type, fact_id, document_id, new_snapshot_id FROM dc",
    "b11_change_report": _F + """, t AS (SELECT document_id, snapshot_id AS new_snapshot_id, max(valid_from) AS detected_at FROM w GROUP BY 1, 2),
      dd AS (SELECT document_id, any_value(url) AS url, arg_max(title, (retrieved_at, observation_id)) AS title FROM sn GROUP BY 1)
      SELECT change_id, change_type, fact_type, url, title, detected_at FROM dc JOIN t USING (document_id, new_snapshot_id) JOIN dd USING (document_id)
      WHERE NOT (fact_type LIKE 'OMBUDSMAN_%' AND EXISTS (SELECT 1 FROM dc o WHERE o.change_type <> dc.change_type AND o.document_id = dc.document_id AND o.old_snapshot_id = dc.old_snapshot_id AND o.new_snapshot_id = dc.new_snapshot_id
        AND o.fact_type = dc.fact_type AND o.predicate = dc.predicate AND o.value_text IS NOT DISTINCT FROM dc.value_text))
      ORDER BY detected_at DESC, change_id LIMIT 500""",
    "b12_table_counts": """SELECT 'orders' AS "table", count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events
      UNION ALL SELECT 'payments', count(*) FROM {payments}""",
    "b12_recent": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100",
}.items()}

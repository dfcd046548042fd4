"""Publication: an allow-list, a gate over all tables, and report tables that read its output only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.ids import hashed, sql_hashed
from evidentia.functions.metadata import json_object, number_at, text_at
from evidentia.plans.storage import through_files
from evidentia.sources.staging import view, with_views

from .ordered import Scan, key_sizes, scanned

#: Neutral observations that may be published without a human decision.
AUTO_PUBLIC = {
    "SUPPLIER_PAYMENT_CONTRACT_OVERLAP": "documented_cross_source_link_not_a_finding",
    "PAYMENT_STREAM_WITHOUT_TRACKED_PROCUREMENT_LINK": "source_discovery_review_not_a_finding",
    "PAYMENTS_OUTSIDE_TRACKED_CONTRACT_PERIODS": "review_required_not_a_finding",
}
#: Categories of findings and their labels.
CATEGORIES = {
    "PAYMENT_STREAM_WITHOUT_TRACKED_PROCUREMENT_LINK": "contract_coverage_gap",
    "PAYMENTS_OUTSIDE_TRACKED_CONTRACT_PERIODS": "contract_coverage_gap",
    "SUPPLIER_PAYMENT_CONTRACT_OVERLAP": "documented_contract_link",
    "PAYMENTS_EXCEED_TRACKED_CONTRACT_VALUE": "reviewed_value_concern",
    "DECLARED_INTEREST_SUPPLIER_OVERLAP": "reviewed_connection",
}
LABELS = {
    "contract_coverage_gap": "Contract transparency gaps",
    "documented_contract_link": "Documented payment / contract links",
    "reviewed_value_concern": "Reviewed value-for-money concerns",
    "reviewed_connection": "Reviewed declared-interest connections",
    "documented_finding": "Documented findings",
    "other": "Other reviewed findings",
}
AMOUNTS = ("payment_total", "net_payment_total", "gross_positive_payments", "tracked_total")
#: Names of those amounts in metadata.
AMOUNT_NAMES = ("payment_total_gbp", "net_payment_total_gbp", "gross_positive_payments_gbp", "tracked_contract_value_gbp")
ACCEPTED = ("auto_accepted", "accepted")


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def with_metadata(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """Adds what signals and reviews keep in a JSON text: interpretation, linked_signal_id and the amounts.

    Columns of these names are replaced.  Broken texts and texts that are no object give nulls.
    """
    read = rows.withColumn("_m", json_object(column))
    found = {"interpretation": text_at(F.col("_m"), "interpretation"), "linked_signal_id": text_at(F.col("_m"), "signal_id")}
    return read.withColumns(found | {a: number_at(F.col("_m"), n) for a, n in zip(AMOUNTS, AMOUNT_NAMES)}).drop("_m")


def auto_publish(signals: DataFrame) -> DataFrame:
    """Signals in review whose type and exact interpretation are on the list become approved."""
    listed = _map(AUTO_PUBLIC)[F.col("signal_type")] == F.col("interpretation")
    return signals.withColumn("status", F.when((F.col("status") == "review") & listed, "approved").otherwise(F.col("status")))


def publication_gate(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """What may be published of each table, and (table, withheld) counts.

    Takes any of matches, reviews, signals, claims, claim_evidence, snapshots, observations;
    other tables pass through.  The input tables do not change.
    """
    out = dict(tables)
    if "signals" in out:
        out["signals"] = auto_publish(out["signals"]).filter("status = 'approved'")
    if "matches" in out:
        out["matches"] = out["matches"].filter(F.col("status").isin(*ACCEPTED))
    if "reviews" in out:
        out["reviews"] = out["reviews"].filter(F.lit(False))
    if "claims" in out:
        out["claims"] = out["claims"].filter("status = 'approved'")
        if "claim_evidence" in out:
            out["claim_evidence"] = out["claim_evidence"].join(out["claims"].select("claim_id"), "claim_id", "left_semi")
    for name, column in (("snapshots", "archive_path"), ("observations", "observation_path")):
        if name in out and column in out[name].columns:
            out[name] = out[name].withColumn(column, F.lit(""))
    counts = None
    for name in sorted(set(tables) & {"matches", "reviews", "signals", "claims", "claim_evidence"}):
        n = lambda df: df.agg(F.count("*").alias("n"))
        one = n(tables[name]).withColumnRenamed("n", "a").crossJoin(n(out[name])).select(F.lit(name).alias("table"), (F.col("a") - F.col("n")).alias("withheld"))
        counts = one if counts is None else counts.unionByName(one)
    return out, counts


def public_findings(signals: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(id, category, label, amount, score) of published signals and claims; the amount is the first there is."""
    have = [F.col(c).cast("decimal(28,2)") for c in AMOUNTS if c in signals.columns]
    category = F.coalesce(_map(CATEGORIES)[F.col("signal_type")], F.lit("other"))
    rows = signals.select(
        F.col("signal_id").alias("id"), category.alias("category"),
        (F.coalesce(*have) if have else F.lit(None)).cast("decimal(28,2)").alias("amount"), F.col("score").cast("double").alias("score"),
    )
    if claims is not None:
        rows = rows.unionByName(claims.select(
            F.col("claim_id").alias("id"), F.lit("documented_finding").alias("category"), F.lit(None).cast("decimal(28,2)").alias("amount"), F.lit(None).cast("double").alias("score")))
    return rows.withColumn("label", _map(LABELS)[F.col("category")])


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category", "label").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,2)").alias("amount"))


def evidence_chain(items: DataFrame, facts: DataFrame, documents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Items (item_id, evidence) exploded to fact, document and snapshot, with its hash."""
    return chain_of_links(items.select("item_id", F.explode("evidence").alias("fact_id")), facts, documents, snapshots)


def chain_of_links(links: DataFrame, facts: DataFrame, documents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The same from (item_id, fact_id) rows."""
    got = links.select("item_id", "fact_id").distinct().join(facts.select("fact_id", "document_id", "snapshot_id", "predicate", "value_text", "locator", "evidence_class"), "fact_id")
    return got.join(documents.select("document_id", "url"), "document_id").join(snapshots.select("snapshot_id", "sha256"), "snapshot_id")


#: Rows of a block of evidence, and nodes under one node of the tree above the blocks.
BLOCK = 1000
SHOWN = ("fact_id", "predicate", "value_text", "locator", "url", "sha256")


class Manifests(NamedTuple):
    """roots: signal_id, manifest, manifest_sha256, evidence_count, root_sha256; blocks: signal_id, block_no, body, block_sha256."""

    roots: DataFrame
    blocks: DataFrame


def evidence_manifests(
    signals: DataFrame, chain: DataFrame, block: int = BLOCK, limit: int | None = None, of: DataFrame | None = None, sizes: tuple[int, int] | None = None,
) -> Manifests:
    """A manifest for each approved signal, and its evidence (``chain``, item_id) in blocks.

    Evidence is put in order and cut into blocks of ``block`` rows, each a JSON text of its own
    with the digest of its rows' digests.  A tree over these, ``block`` nodes to a node, gives the
    root digest that the manifest carries, so a signal with a million facts is many tasks' work
    and a block can be checked without the others.  A node with a single child is that child;
    without evidence the root is the digest of nothing.

    ``of`` (signal_id, item_id), one item a signal, is for signals that share evidence: blocks and
    trees are made once an item, whatever the number of its signals.  Without it items are the
    signals.  ``sizes`` are ``ordered.key_sizes`` of the chain's items, or of more rows.
    """
    approved = signals.filter("status = 'approved'").select("signal_id", "signal_type")
    approved = through_files(approved.withColumn("item_id", F.col("signal_id")) if of is None else approved.join(of.select("signal_id", "item_id"), "signal_id", "left"))
    rows = chain.select("item_id", *SHOWN).join(approved.select("item_id").distinct(), "item_id", "left_semi")
    rows = scanned(rows, ["item_id"], [F.asc(c) for c in SHOWN], [Scan("place", "place")], limit, sizes)
    rows = rows.withColumns({"block_no": F.floor((F.col("place") - 1) / block), "digest": hashed(*SHOWN)})
    # an item's rows lie together, so a block needs no shuffle; the text of a row is made before rows are gathered
    row = F.struct("place", F.to_json(F.struct(*SHOWN)).alias("row"), "digest")
    parts = rows.groupBy("item_id", "block_no").agg(F.array_sort(F.collect_list(row)).alias("parts"))
    joined = lambda c: F.array_join(F.transform("parts", lambda x: x[c]), ",")
    blocks = parts.select(
        "item_id", "block_no", F.concat(F.lit("["), joined("row"), F.lit("]")).alias("body"), F.size("parts").cast("long").alias("n"), F.sha2(joined("digest"), 256).alias("block_sha256"))
    blocks = through_files(blocks)
    nodes = blocks.select("item_id", F.col("block_no").alias("no"), "n", F.lit(1).cast("long").alias("blocks"), F.col("block_sha256").alias("node"))
    most = blocks.agg(F.coalesce(F.max("block_no"), F.lit(0)) + 1).first()[0]
    while most > 1:
        under = F.transform(F.array_sort(F.collect_list(F.struct("no", "node"))), lambda x: x["node"])
        nodes = nodes.groupBy("item_id", F.floor(F.col("no") / block).alias("no")).agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks"), under.alias("under"))
        nodes = nodes.withColumn("node", F.when(F.size("under") == 1, F.col("under")[0]).otherwise(F.sha2(F.array_join("under", ","), 256))).drop("under")
        most = -(-most // block)
    roots = approved.join(nodes, "item_id", "left").withColumns({
        "evidence_count": F.coalesce("n", F.lit(0).cast("long")), "block_count": F.coalesce("blocks", F.lit(0).cast("long")), "root_sha256": F.coalesce("node", F.sha2(F.lit(""), 256))})
    manifest = F.to_json(F.struct("signal_id", "signal_type", "evidence_count", "block_count", "root_sha256"))
    roots = roots.select("signal_id", manifest.alias("manifest"), F.sha2(manifest, 256).alias("manifest_sha256"), "evidence_count", "root_sha256")
    own = blocks.withColumnRenamed("item_id", "signal_id") if of is None else blocks.join(approved.select("item_id", "signal_id"), "item_id")
    return Manifests(roots, own.select("signal_id", "block_no", "body", "block_sha256"))


def write_manifests(manifests: Manifests, folder: str) -> None:
    """Roots and blocks as JSON lines, in folders by the first two letters of the digest of the signal's id."""
    shelf = F.substring(F.sha2("signal_id", 256), 1, 2)
    manifests.roots.withColumn("shelf", shelf).write.mode("overwrite").partitionBy("shelf").json(f"{folder}/roots")
    manifests.blocks.withColumn("shelf", shelf).write.mode("overwrite").partitionBy("shelf").json(f"{folder}/blocks")


def _mentions(facts: DataFrame) -> DataFrame:
    """One row for each entity that a fact names as subject or object (an OR join as a union)."""
    side = lambda c, other: facts.select(F.col(c).alias("entity_id"), F.col(other).alias("other_id"), *facts.columns)
    return side("subject_id", "object_id").unionByName(side("object_id", "subject_id").filter("NOT (subject_id <=> object_id)")).filter("entity_id IS NOT NULL")


def entity_index(facts: DataFrame) -> DataFrame:
    """Distinct facts of each entity."""
    return _mentions(facts).groupBy("entity_id").agg(F.count_distinct("fact_id").alias("n_facts"))


def entity_timelines(facts: DataFrame, n: int | None = None) -> DataFrame:
    """Facts of each entity by time, newest first, with the other party and their place."""
    at = F.coalesce(*(F.col(c) for c in ("published_at", "retrieved_at") if c in facts.columns))
    # only what is shown goes along: large entities are written on the way, with all columns they have
    shown = _mentions(facts).withColumn("at", at).select("entity_id", "at", "fact_id", "predicate", "other_id")
    rows = scanned(shown, ["entity_id"], [F.desc("at"), F.asc("fact_id"), F.asc("other_id")], [Scan("place", "place")]).select("entity_id", "place", "at", "fact_id", "predicate", "other_id")
    return rows if n is None else rows.filter(F.col("place") <= n)


def publication_status(expectations: DataFrame, health: DataFrame, obs: DataFrame, as_of: str) -> DataFrame:
    """Status of each expected source at a fixed moment, from its newest run and observation."""
    last = obs.groupBy("source_id").agg(F.max("retrieved_at").alias("last_snapshot"))
    rows = expectations.join(health.select("source_id", F.col("status").alias("run")), "source_id", "left").join(last, "source_id", "left")
    age = F.datediff(F.lit(as_of).cast("timestamp"), "last_snapshot")
    status = (
        F.when(F.col("run").isNull(), "not_checked").when(F.col("run") == "blocked", "blocked").when(F.col("run") == "partial_blocked", "partial")
        .when(F.col("run") == "missing", "missing").when(F.col("run").isin("rate_limited", "http_error", "network_error", "error", "configuration_error"), "error")
        .when(F.col("run").isin("partial", "partial_extraction"), "partial").when(F.col("last_snapshot").isNull(), "missing")
        .when(age > F.col("cadence_days") + F.col("grace_days"), "stale").otherwise("present")
    )
    return rows.select("source_id", status.alias("status"), "last_snapshot", age.alias("age_days"))


def api_tables(gated: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """Enriched projections of the gate's output, each with fixed columns and a fixed order of rows.

    Takes any of entities and members, facts (with documents, snapshots and windows, if given), matches, reviews, signals,
    signal_evidence and review_evidence (signal_id or review_id, fact_id; given with facts), health, registry_records and
    registry_relationships.  Where documents have last_seen, facts of the documents seen last come first; where matches,
    reviews or signals have updated_at, it is shown and the newest come first.  ``examples`` are the first three signals.
    """
    stamp = lambda df, c="updated_at": [c] if c in df.columns else []
    newest = lambda df, c="updated_at": [F.desc(x) for x in stamp(df, c)]
    named = lambda c: names.select(F.col("entity_id").alias(c), F.col("name").alias(c.replace("_id", "_name")))
    both = lambda df: df.join(named("subject_id"), "subject_id", "left").join(named("object_id"), "object_id", "left")
    out = {}
    if "entities" in gated:
        rows = gated["entities"]
        resolved = F.lit(None).cast("string")
        if "members" in gated:
            rows, resolved = rows.join(gated["members"].select("entity_id", "canonical_id"), "entity_id", "left"), F.col("canonical_id")
        out["entities"] = rows.select(
            "entity_id", "entity_type", "canonical_name", F.coalesce(resolved, "entity_id").alias("resolved_entity_id"),
        ).orderBy("entity_type", "canonical_name", "entity_id")
    if "signals" in gated:
        rows = gated["signals"]
        out["signals"] = both(rows).select(
            "signal_id", "signal_type", "score", "subject_id", "subject_name", "object_id", "object_name", *stamp(rows)).orderBy(*(newest(rows) or [F.desc("score")]), "signal_id")
        out["examples"] = out["signals"].limit(3)
    if "facts" in gated:
        rows = both(gated["facts"])
        more = []
        for name, key, columns in (("documents", ["document_id"], ["url"]), ("snapshots", ["snapshot_id"], ["sha256"]), ("windows", ["document_id", "snapshot_id"], ["valid_from", "valid_to"])):
            if name in gated:
                columns = columns + stamp(gated[name], "last_seen")
                rows, more = rows.join(gated[name].select(*key, *columns), key, "left"), more + columns
        rows = rows.select("fact_id", "fact_type", "predicate", "subject_name", "object_name", "value_text", "locator", "document_id", *more)
        out["facts"] = rows.orderBy(*(newest(rows, "last_seen") or ["document_id"]), "fact_type", "fact_id")
        for name, key in (("signals", "signal_id"), ("reviews", "review_id")):
            links = name[:-1] + "_evidence"
            if name in gated and links in gated:
                of = gated[links].select(key, "fact_id").distinct().join(gated[name].select(key), key, "left_semi")
                out[links] = of.join(rows, "fact_id").orderBy(key, "fact_type", "fact_id")
    if "matches" in gated:
        side = lambda c, n: names.select(F.col("entity_id").alias(c), F.col("name").alias(n))
        out["matches"] = gated["matches"].join(side("left_id", "left_name"), "left_id", "left").join(side("right_id", "right_name"), "right_id", "left").select(
            "match_id", "left_id", "left_name", "right_id", "right_name", "match_method", "confidence", "status", *stamp(gated["matches"])).orderBy(F.desc("confidence"), *newest(gated["matches"]), "match_id")
    if "reviews" in gated:
        out["reviews"] = both(gated["reviews"]).select(
            "review_id", "item_type", "status", "subject_id", "subject_name", "object_id", "object_name", *stamp(gated["reviews"])).orderBy("status", *newest(gated["reviews"]), "review_id")
    if "health" in gated:
        out["health"] = gated["health"].select("source_id", "status", "record_count", "fact_count", "http_status", "started_at").orderBy(
            F.desc(F.col("status") != "success"), "source_id")
    if "registry_records" in gated:
        out["registry_records"] = gated["registry_records"].select(
            "registry", "record_type", "external_id", "entity_id", "canonical_name").orderBy("registry", "record_type", "canonical_name", "external_id")
    if "registry_relationships" in gated:
        out["registry_relationships"] = both(gated["registry_relationships"]).select(
            "registry", "predicate", "subject_id", "subject_name", "object_id", "object_name").orderBy("registry", "predicate", "subject_name", "object_name", "subject_id", "object_id")
    return out


def verify_boundary(published: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) that are broken; empty if all may be published."""
    checks = {
        "signal_not_approved": ("signals", F.col("status") != "approved") if "signals" in published else None,
        "match_not_accepted": ("matches", ~F.col("status").isin(*ACCEPTED)) if "matches" in published else None,
        "review_present": ("reviews", F.lit(True)) if "reviews" in published else None,
        "private_path": ("snapshots", F.coalesce("archive_path", F.lit("")) != "") if "archive_path" in getattr(published.get("snapshots"), "columns", ()) else None,
    }
    out = None
    for rule, check in checks.items():
        if check is not None:
            one = published[check[0]].filter(check[1]).agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
            out = one if out is None else out.unionByName(one)
    return out.filter("violations > 0")


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _matches(v) -> DataFrame:
    return v("part").select(F.col("p_partkey").alias("match_id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'auto_accepted' WHEN 1 THEN 'review' ELSE 'accepted' END").alias("status"))


def _gate(v):
    return publication_gate({"signals": v("signals"), "reviews": v("signal_reviews"), "matches": _matches(v)})


def _claims(v) -> dict[str, DataFrame]:
    """Claims on parts with the facts of their order lines, beside the signals."""
    claims = v("part").select(F.concat(F.lit("c"), "p_partkey").alias("claim_id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'draft' ELSE 'rejected' END").alias("status"))
    evidence = v("lineitem").select(F.concat(F.lit("c"), "l_partkey").alias("claim_id"), F.concat_ws("-", F.concat(F.lit("f"), "l_orderkey"), "l_linenumber").alias("fact_id"))
    return {"signals": v("signals"), "claims": claims, "claim_evidence": evidence}


def _claim_gate(v):
    return publication_gate(_claims(v))


def _named_entities(v) -> DataFrame:
    return v("entities").select("entity_id", F.col("canonical_name").alias("name"))


def _api(v, name: str, **tables) -> DataFrame:
    return api_tables(tables, _named_entities(v) if name in ("matches", "registry_relationships") else v("names"))[name]


def _entity_pairs(v) -> DataFrame:
    """Matches of neighbouring parts."""
    e = lambda k: F.concat(F.lit("E"), F.lpad(k.cast("string"), 8, "0"))
    return v("part").select(
        F.col("p_partkey").alias("match_id"), e(F.col("p_partkey")).alias("left_id"), e(F.col("p_partkey") + 1).alias("right_id"), F.lit("near_typo").alias("match_method"),
        (F.col("p_size") / 64).alias("confidence"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'auto_accepted' WHEN 1 THEN 'review' ELSE 'accepted' END").alias("status"))


def _registry(v) -> dict[str, DataFrame]:
    ids = lambda c: F.concat(F.lit("E"), c)
    records = v("companies").select(F.lit("companies").alias("registry"), "category", F.col("number").alias("external_id"), ids("number").alias("entity_id"), F.col("name").alias("canonical_name")).withColumnRenamed("category", "record_type")
    links = v("controllers").select(F.lit("companies").alias("registry"), F.lit("PSC_OF_COMPANY").alias("predicate"), F.col("name").alias("subject_id"), ids("company_number").alias("object_id"))
    return {"registry_records": records, "registry_relationships": links}


def _chain(v) -> DataFrame:
    items = v("published_facts").select(F.col("object_id").alias("item_id"), "fact_id")
    docs = v("supplier").select(F.concat(F.lit("D"), "s_suppkey").alias("document_id"), F.col("s_name").alias("url"))
    snaps = v("published_facts").select("snapshot_id").distinct().withColumn("sha256", F.sha2("snapshot_id", 256))
    return chain_of_links(items, v("published_facts"), docs, snaps)


def _manifests(v) -> Manifests:
    """Manifests of approved signals by the facts of their suppliers, which all signals of one share, in blocks of 10."""
    signals = through_files(v("signals").select("signal_id", "signal_type", "status", "subject_id"))
    return evidence_manifests(signals, _chain(v), 10, of=signals.select("signal_id", F.col("subject_id").alias("item_id")), sizes=key_sizes(v("published_facts"), ["object_id"]))


def _told(v) -> DataFrame:
    """Signals whose interpretation and amounts stand in their metadata only."""
    return with_metadata(v("signal_metadata"))


def _evidence(v) -> DataFrame:
    gated = publication_gate({"signals": v("signals")})[0]["signals"]
    links = v("signals").select("signal_id", F.concat(F.lit("f"), F.substring("fact_id", 2, 64)).alias("fact_id"))
    return _api(v, "signal_evidence", signals=gated, signal_evidence=links, facts=v("published_facts"))


def _expected(v) -> DataFrame:
    return v("runs").select("source_id").distinct().unionByName(v("region").select(F.col("r_name").alias("source_id"))).withColumns(
        {"cadence_days": F.expr("CASE WHEN source_id LIKE 'src1%' THEN 1 ELSE 30 END"), "grace_days": F.lit(5)})


def _health(v) -> DataFrame:
    from .ingest import latest_source_health

    return latest_source_health(v("runs"))


def _seen(v) -> DataFrame:
    return v("runs").filter("status = 'success' AND source_id <> 'src8'").select("source_id", F.col("started_at").alias("retrieved_at"))


AS_OF = "2024-03-01 00:00:00"
QUERIES = {
    "i1_auto_publish": _q(lambda v: auto_publish(v("signals")).select("signal_id", "status")),
    "i2_publication_gate": _q(lambda v: _gate(v)[0]["signals"].select("signal_id", "signal_type", "status")),
    "i2_withheld_counts": _q(lambda v: _gate(v)[1]),
    "i3_public_findings": _q(lambda v: public_findings(_gate(v)[0]["signals"])),
    "i3_finding_counts": _q(lambda v: finding_counts(public_findings(_gate(v)[0]["signals"]))),
    "i4_evidence_chain": _q(lambda v: _chain(v).select("item_id", "fact_id", "url", "sha256", "value_text")),
    "i5_evidence_manifests": _q(lambda v: _manifests(v).roots.select("signal_id", "evidence_count", "root_sha256")),
    "i5_evidence_blocks": _q(lambda v: _manifests(v).blocks.select("signal_id", "block_no", "block_sha256")),
    "i6_entity_index": _q(lambda v: entity_index(v("published_facts"))),
    "i7_entity_timelines": _q(lambda v: entity_timelines(v("published_facts"))),
    "i8_publication_status": _q(lambda v: publication_status(_expected(v), _health(v), _seen(v), AS_OF)),
    "i9_api_signals": _q(lambda v: api_tables({"signals": _gate(v)[0]["signals"]}, v("names"))["signals"]),
    "i9_api_signal_evidence": _q(_evidence),
    "d14_metadata_lookups": _q(lambda v: _told(v).select("signal_id", "interpretation", "linked_signal_id", "payment_total", "tracked_total")),
    "d14_public_findings": _q(lambda v: public_findings(publication_gate({"signals": _told(v)})[0]["signals"]).drop("label")),
    "i9_api_facts": _q(lambda v: api_tables({"facts": v("published_facts")}, v("names"))["facts"]),
    "i2_gate_claims": _q(lambda v: _claim_gate(v)[0]["claim_evidence"]),
    "i2_withheld_claims": _q(lambda v: _claim_gate(v)[1]),
    "i3_findings_with_claims": _q(lambda v: public_findings(_claim_gate(v)[0]["signals"], _claim_gate(v)[0]["claims"])),
    "i9_api_entities": _q(lambda v: _api(v, "entities", entities=v("entities"), members=v("entities").select("entity_id", F.when(F.col("entity_id") < "E1", F.concat(F.substring("entity_id", 1, 8), F.lit("0"))).otherwise(F.col("entity_id")).alias("canonical_id")))),
    "i9_api_matches": _q(lambda v: _api(v, "matches", matches=publication_gate({"matches": _entity_pairs(v)})[0]["matches"])),
    "i9_api_reviews": _q(lambda v: _api(v, "reviews", reviews=v("signal_reviews"))),
    "i9_api_source_health": _q(lambda v: _api(v, "health", health=_health(v))),
    "i9_api_registry_records": _q(lambda v: _api(v, "registry_records", **_registry(v))),
    "i9_api_registry_relationships": _q(lambda v: _api(v, "registry_relationships", **_registry(v))),
    "i10_verify_boundary": _q(lambda v: verify_boundary({"signals": v("signals"), "reviews": v("signal_reviews"), "matches": _matches(v)})),
}
_LISTED = " OR ".join(f"(signal_type = '{k}' AND interpretation = '{x}')" for k, x in AUTO_PUBLIC.items())
_AP = f"WITH ap AS (SELECT * REPLACE (CASE WHEN status = 'review' AND ({_LISTED}) THEN 'approved' ELSE status END AS status) FROM {{signals}}), pub AS (SELECT * FROM ap WHERE status = 'approved')"
_CAT = "CASE signal_type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in CATEGORIES.items()) + " ELSE 'other' END"
_LAB = "CASE category " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in LABELS.items()) + " END"
_FIND = _AP + f", fi AS (SELECT signal_id AS id, {_CAT} AS category, coalesce(payment_total, tracked_total)::DECIMAL(28,2) AS amount, score::DOUBLE AS score FROM pub), fl AS (SELECT *, {_LAB} AS label FROM fi)"
_NUMBER = "CASE WHEN json_type(j, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(j, '$.{0}') AS DECIMAL(28,2)) END AS {1}"
_META = f"""WITH m AS (SELECT * EXCLUDE (metadata), CASE WHEN json_valid(metadata) THEN metadata END AS j FROM {{signal_metadata}}), o AS (SELECT * REPLACE (CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j) FROM m),
 told AS (SELECT *, json_extract_string(j, '$.interpretation') AS interpretation, json_extract_string(j, '$.signal_id') AS linked_signal_id,
   {_NUMBER.format("payment_total_gbp", "payment_total")}, {_NUMBER.format("tracked_contract_value_gbp", "tracked_total")} FROM o)
"""
_CH = """WITH it AS (SELECT object_id AS item_id, unnest(list(DISTINCT fact_id)) AS fact_id FROM {published_facts} GROUP BY 1),
 ch AS (SELECT item_id, fact_id, s_name AS url, sha256(snapshot_id) AS sha256, value_text FROM it JOIN (SELECT DISTINCT * FROM {published_facts}) USING (fact_id) JOIN supplier ON document_id = 'D' || s_suppkey)"""
_ROW = sql_hashed(*SHOWN)
_LEVEL = "SELECT signal_id, no // 10 AS no, CASE WHEN count(*) = 1 THEN min(node) ELSE sha256(string_agg(node, ',' ORDER BY no)) END AS node FROM {0} GROUP BY 1, 2"
_TREE = f"""WITH it AS (SELECT DISTINCT object_id AS item_id, fact_id FROM {{published_facts}}),
 r AS (SELECT signal_id, {_ROW} AS digest, row_number() OVER (PARTITION BY signal_id ORDER BY fact_id, predicate, value_text, locator, url, sha256) - 1 AS place FROM
   (SELECT item_id, fact_id, predicate, value_text, locator, s_name AS url, sha256(snapshot_id) AS sha256 FROM it JOIN (SELECT DISTINCT * FROM {{published_facts}}) USING (fact_id) JOIN supplier ON document_id = 'D' || s_suppkey)
   JOIN (SELECT signal_id, subject_id AS item_id FROM {{signals}} WHERE status = 'approved') USING (item_id)),
 t0 AS (SELECT signal_id, place // 10 AS no, sha256(string_agg(digest, ',' ORDER BY place)) AS node FROM r GROUP BY 1, 2),
 t1 AS ({_LEVEL.format("t0")}), t2 AS ({_LEVEL.format("t1")}), t3 AS ({_LEVEL.format("t2")}), t4 AS ({_LEVEL.format("t3")})
"""
_MEN = "(SELECT subject_id AS entity_id, object_id AS other_id, * FROM {published_facts} UNION ALL SELECT object_id, subject_id, * FROM {published_facts} WHERE subject_id IS DISTINCT FROM object_id)"
_NM = lambda t: f"SELECT {t} LEFT JOIN {{names}} a ON a.entity_id = subject_id LEFT JOIN {{names}} b ON b.entity_id = object_id"
ORACLE = {k: with_views(q) for k, q in {
    "i1_auto_publish": _AP + "SELECT signal_id, status FROM ap",
    "i2_publication_gate": _AP + "SELECT signal_id, signal_type, status FROM pub",
    "i2_withheld_counts": _AP + """SELECT 'signals' AS "table", (SELECT count(*) FROM ap) - (SELECT count(*) FROM pub) AS withheld UNION ALL SELECT 'reviews', count(*) FROM {signal_reviews} UNION ALL SELECT 'matches', count(*) FROM part WHERE p_partkey % 3 = 1""",
    "i3_public_findings": _FIND + "SELECT * FROM fl",
    "i3_finding_counts": _FIND + "SELECT category, label, count(*) AS n, sum(amount)::DECIMAL(28,2) AS amount FROM fl GROUP BY 1, 2",
    "i4_evidence_chain": _CH + "SELECT * FROM ch",
    "i5_evidence_manifests": _TREE + """SELECT signal_id, coalesce(n, 0)::BIGINT AS evidence_count, coalesce(node, sha256('')) AS root_sha256
      FROM {signals} LEFT JOIN (SELECT signal_id, node FROM t4) USING (signal_id) LEFT JOIN (SELECT signal_id, count(*) AS n FROM r GROUP BY 1) USING (signal_id) WHERE status = 'approved'""",
    "i5_evidence_blocks": _TREE + "SELECT signal_id, no AS block_no, node AS block_sha256 FROM t0",
    "i6_entity_index": f"SELECT entity_id, count(DISTINCT fact_id) AS n_facts FROM {_MEN} GROUP BY 1",
    "i7_entity_timelines": f"SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY retrieved_at DESC, fact_id, other_id) AS place, retrieved_at AS at, fact_id, predicate, other_id FROM {_MEN}",
    "i8_publication_status": f"""WITH x AS (SELECT DISTINCT source_id FROM {{runs}} UNION ALL SELECT r_name FROM region),
      h AS (SELECT source_id, status FROM {{runs}} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1),
      o AS (SELECT source_id, max(started_at) AS last_snapshot FROM {{runs}} WHERE status = 'success' AND source_id <> 'src8' GROUP BY 1)
      SELECT source_id, last_snapshot, date_diff('day', CAST(last_snapshot AS DATE), DATE '2024-03-01') AS age_days, CASE WHEN h.status IS NULL THEN 'not_checked' WHEN h.status IN ('blocked', 'missing', 'partial') THEN h.status
        WHEN h.status IN ('rate_limited', 'http_error') THEN 'error' WHEN last_snapshot IS NULL THEN 'missing'
        WHEN date_diff('day', CAST(last_snapshot AS DATE), DATE '2024-03-01') > (CASE WHEN source_id LIKE 'src1%' THEN 1 ELSE 30 END) + 5 THEN 'stale' ELSE 'present' END AS status
      FROM x LEFT JOIN h USING (source_id) LEFT JOIN o USING (source_id)""",
    "i9_api_signals": _AP + _NM("signal_id, signal_type, score, subject_id, a.name AS subject_name, object_id, b.name AS object_name FROM pub"),
    "i9_api_signal_evidence": _AP + _NM("signal_id, f.fact_id, fact_type, predicate, a.name AS subject_name, b.name AS object_name, value_text, locator, document_id FROM (SELECT signal_id, 'f' || substring(fact_id, 2) AS fact_id FROM pub) JOIN {published_facts} f USING (fact_id)"),
    "d14_metadata_lookups": _META + "SELECT signal_id, interpretation, linked_signal_id, payment_total, tracked_total FROM told",
    "d14_public_findings": _META + f"""SELECT signal_id AS id, {_CAT} AS category, coalesce(payment_total, tracked_total)::DECIMAL(28,2) AS amount, score::DOUBLE AS score
      FROM told WHERE status = 'approved' OR (status = 'review' AND ({_LISTED}))""",
    "i9_api_facts": _NM("fact_id, fact_type, predicate, a.name AS subject_name, b.name AS object_name, value_text, locator, document_id FROM {published_facts}"),
    "i2_gate_claims": "SELECT 'c' || l_partkey AS claim_id, 'f' || l_orderkey || '-' || l_linenumber AS fact_id FROM lineitem WHERE l_partkey % 3 = 0",
    "i2_withheld_claims": _AP + """SELECT 'signals' AS "table", (SELECT count(*) FROM ap) - (SELECT count(*) FROM pub) AS withheld UNION ALL SELECT 'claims', count(*) FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'claim_evidence', count(*) FROM lineitem WHERE l_partkey % 3 <> 0""",
    "i3_findings_with_claims": _FIND + "SELECT * FROM fl UNION ALL SELECT 'c' || p_partkey, 'documented_finding', NULL, NULL, 'Documented findings' FROM part WHERE p_partkey % 3 = 0",
    "i9_api_entities": "SELECT entity_id, entity_type, canonical_name, CASE WHEN entity_id < 'E1' THEN substring(entity_id, 1, 8) || '0' ELSE entity_id END AS resolved_entity_id FROM {entities}",
    "i9_api_matches": """WITH m AS (SELECT p_partkey AS match_id, 'E' || lpad(p_partkey::VARCHAR, 8, '0') AS left_id, 'E' || lpad((p_partkey + 1)::VARCHAR, 8, '0') AS right_id, 'near_typo' AS match_method, p_size / 64 AS confidence,
      CASE p_partkey % 3 WHEN 0 THEN 'auto_accepted' ELSE 'accepted' END AS status FROM part WHERE p_partkey % 3 <> 1)
      SELECT m.*, a.canonical_name AS left_name, b.canonical_name AS right_name FROM m LEFT JOIN {entities} a ON a.entity_id = left_id LEFT JOIN {entities} b ON b.entity_id = right_id""",
    "i9_api_reviews": _NM("review_id, item_type, status, subject_id, a.name AS subject_name, object_id, b.name AS object_name FROM {signal_reviews}"),
    "i9_api_source_health": "SELECT source_id, status, record_count, fact_count, http_status, started_at FROM {runs} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1",
    "i9_api_registry_records": "SELECT 'companies' AS registry, category AS record_type, number AS external_id, 'E' || number AS entity_id, name AS canonical_name FROM {companies}",
    "i9_api_registry_relationships": """SELECT 'companies' AS registry, 'PSC_OF_COMPANY' AS predicate, c.name AS subject_id, a.canonical_name AS subject_name, 'E' || company_number AS object_id, b.canonical_name AS object_name
      FROM {controllers} c LEFT JOIN {entities} a ON a.entity_id = c.name LEFT JOIN {entities} b ON b.entity_id = 'E' || company_number""",
    "i10_verify_boundary": "SELECT * FROM (SELECT 'signal_not_approved' AS rule, count(*) AS violations FROM {signals} WHERE status <> 'approved' UNION ALL SELECT 'match_not_accepted', count(*) FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'review_present', count(*) FROM {signal_reviews}) WHERE violations > 0",
}.items()}

"""Ingest and provenance: observations of documents to snapshots, changes and source health.

Observations have observation_id, source_id, url, title, body, retrieved_at, published_at and
evidence_class.  All operators are one aggregate or window on the document or source key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.ids import hashed, sql_hashed
from evidentia.sources.staging import view, with_views

from .ordered import Scan, scanned

#: The domain of evidence classes.
EVIDENCE_CLASSES = (
    "OFFICIAL_RECORD", "REGULATORY_FINDING", "COURT_RECORD", "MEDIA_REPORT", "PUBLIC_ALLEGATION", "INFERENCE",
    "UNVERIFIED_LEAD",
)


def canonical_url(url) -> Column:
    """Scheme and host in lower case, query pairs decoded and sorted, no fragment."""
    u = url if isinstance(url, Column) else F.col(url)
    bare = F.regexp_replace(u, "#.*$", "")
    head = F.regexp_extract(bare, "^([^?]*)", 1)
    scheme, host = F.lower(F.regexp_extract(head, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(head, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(head, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pair = lambda p: F.struct(
        F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
        F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("v"),
    )
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    start = F.when(host != "", F.concat(scheme, F.lit("://"), host, path)).otherwise(head)
    return F.when(text != "", F.concat(start, F.lit("?"), text)).otherwise(start)


def snapshot_observations(obs: DataFrame) -> DataFrame:
    """Adds sha256, document_id, snapshot_id and observation_key."""
    out = obs.withColumn("sha256", F.sha2(F.coalesce("body", F.lit("")), 256))
    return out.withColumns({
        "document_id": hashed("source_id", "url"),
        "snapshot_id": hashed("source_id", "url", "sha256"),
    }).withColumn("observation_key", hashed("snapshot_id", "retrieved_at"))


def distinct_blobs(snapped: DataFrame) -> DataFrame:
    """One row for each content, whatever its url or date: first observation and how many."""
    return snapped.groupBy("sha256").agg(
        F.min_by("observation_id", F.struct("retrieved_at", "observation_id")).alias("first_observation"),
        F.count("*").alias("observations"), F.count_distinct("document_id").alias("documents"),
    )


def latest_documents(obs: DataFrame) -> DataFrame:
    """Newest values of each (source, url); published_at is the last that is not null."""
    at = F.struct("retrieved_at", "observation_id")
    dated = F.when(F.col("published_at").isNotNull(), at)
    return obs.groupBy("source_id", "url").agg(
        F.max_by("title", at).alias("title"), F.max_by("evidence_class", at).alias("evidence_class"),
        F.max_by("observation_id", at).alias("latest_observation"), F.max_by("published_at", dated).alias("published_at"),
        F.min("retrieved_at").alias("first_seen"), F.max("retrieved_at").alias("last_seen"), F.count("*").alias("observations"),
    )


def content_changes(snapped: DataFrame) -> DataFrame:
    """A row where a document's hash differs from the one before; repeats of old and new collapse to the first."""
    rows = snapped.select("document_id", "sha256", "retrieved_at", "observation_id")
    rows = scanned(rows, ["document_id"], [F.col("retrieved_at"), F.col("observation_id")], [Scan("before", "old_sha256", "sha256")])
    changed = rows.filter(F.col("old_sha256") != F.col("sha256"))
    changed = changed.withColumn("change_id", hashed("document_id", "old_sha256", "sha256", F.lit("CONTENT_CHANGED")))
    return changed.groupBy("change_id", "document_id", "old_sha256", F.col("sha256").alias("new_sha256")).agg(
        F.min("retrieved_at").alias("detected_at")
    )


def upsert_dimension(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, the incoming row stands whole."""
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming)


def link_orgs(existing: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, organisation_id): links of the given sources are replaced by their lists."""
    fresh = sources.select("source_id", F.explode("organisation_ids").alias("organisation_id")).distinct()
    return existing.join(sources.select("source_id"), "source_id", "left_anti").unionByName(fresh)


def check_evidence_class(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows within the domain, and the rejects."""
    ok = F.coalesce(F.col("evidence_class").isin(*EVIDENCE_CLASSES), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def coverage_audit(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources that expect facts and whose run has no records or fewer facts than the minimum."""
    counts = runs.groupBy("source_id").agg(F.sum("record_count").alias("records"), F.sum("fact_count").alias("facts"))
    rows = sources.filter("expect_facts").join(counts, "source_id", "left").withColumns(
        {"records": F.coalesce("records", F.lit(0)), "facts": F.coalesce("facts", F.lit(0))}
    )
    least = F.greatest(F.lit(1), F.coalesce("minimum_fact_count", F.lit(1)))
    return rows.filter((F.col("records") <= 0) | (F.col("facts") < least)).select("source_id", "records", "facts", least.alias("minimum"))


def error_class(http_status, transport) -> Column:
    """Class of a failed fetch from its HTTP status or its transport error."""
    s, t = F.col(http_status), F.col(transport)
    return (
        F.when(s.isin(401, 403), "blocked").when(s == 404, "missing").when(s == 429, "rate_limited")
        .when(s >= 400, "http_error").when(t == "permission", "blocked").when(t == "transport", "network_error")
        .when(t.isNotNull(), "error")
    )


def source_run_status(fetches: DataFrame) -> DataFrame:
    """Status of each source's run from its fetch log.

    Columns: source_id, http_status, transport, raised, extract_error, audit_failed, known_kind.
    """
    rows = fetches.withColumn("class", error_class("http_status", "transport"))
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    got = rows.groupBy("source_id").agg(
        any_(~F.col("known_kind")).alias("unknown"), F.min(F.when(F.col("raised"), F.coalesce("class", F.lit("error")))).alias("fatal"),
        any_(F.col("class") == "blocked").alias("blocked"), any_(F.col("class").isNotNull()).alias("failed"),
        any_(F.col("audit_failed")).alias("audit"), any_(F.col("extract_error")).alias("extract"),
    )
    return got.select("source_id", (
        F.when(F.col("unknown"), "configuration_error").when(F.col("fatal").isNotNull(), F.col("fatal"))
        .when(F.col("blocked"), "partial_blocked").when(F.col("failed"), "partial").when(F.col("audit"), "partial_extraction")
        .when(F.col("extract"), "partial").otherwise("success")
    ).alias("status"))


def latest_source_health(runs: DataFrame) -> DataFrame:
    """Newest run of each source."""
    order = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _snapped(v) -> DataFrame:
    return snapshot_observations(v("observations"))


def _dims(v, parity: int) -> DataFrame:
    return v("supplier").filter(f"s_suppkey % 3 <> {parity}").select("s_suppkey", F.concat(F.lit(f"{parity}"), "s_name").alias("s_name"))


def _sources(v) -> DataFrame:
    return v("runs").select("source_id").distinct().withColumns({
        "expect_facts": F.expr("cast(substring(source_id, 4) as int) % 2 = 0"),
        "minimum_fact_count": F.expr("cast(substring(source_id, 4) as int) * 17"),
    })


def _daily_fetches(v) -> DataFrame:
    """All events, as a run of each user and day."""
    return _fetch_log(v("events"), F.concat(F.lit("s"), "user_id", F.lit("/"), F.to_date("ts").cast("string")))


def _fetch_log(events: DataFrame, source_id: Column) -> DataFrame:
    return events.select(
        source_id.alias("source_id"),
        F.expr("CASE event_id % 11 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 200 END").alias("http_status"),
        F.expr("CASE WHEN event_id % 17 = 0 THEN 'transport' END").alias("transport"),
        F.expr("event_id % 29 = 0").alias("raised"), F.expr("event_id % 7 = 0").alias("extract_error"),
        F.expr("event_id % 19 = 0").alias("audit_failed"), F.expr("user_id % 23 <> 0").alias("known_kind"),
    )


QUERIES = {
    "a1_canonicalize_urls": _q(lambda v: v("pages").select("page_id", canonical_url("url").alias("url"))),
    "a2_snapshot_observations": _q(lambda v: _snapped(v).select("observation_id", "sha256", "document_id", "snapshot_id")),
    "a3_distinct_blobs": _q(lambda v: distinct_blobs(_snapped(v))),
    "a4_latest_documents": _q(lambda v: latest_documents(v("observations"))),
    "a5_content_changes": _q(lambda v: content_changes(_snapped(v))),
    "a6_upsert_dimension": _q(lambda v: upsert_dimension(_dims(v, 0), _dims(v, 1), "s_suppkey")),
    "a6_link_orgs": _q(lambda v: link_orgs(
        v("nation").select(F.col("n_regionkey").cast("string").alias("source_id"), F.col("n_nationkey").cast("string").alias("organisation_id")),
        v("region").filter("r_regionkey < 2").select(F.col("r_regionkey").cast("string").alias("source_id"), F.split("r_name", "").alias("organisation_ids")))),
    "a7_evidence_class_rejects": _q(lambda v: check_evidence_class(v("observations"))[1].select("observation_id", "evidence_class")),
    "a7_evidence_class_accepted": _q(lambda v: check_evidence_class(v("observations"))[0].select("observation_id", "evidence_class")),
    "a8_coverage_audit": _q(lambda v: coverage_audit(_sources(v), v("runs"))),
    "a9_source_run_status": _q(lambda v: source_run_status(_daily_fetches(v))),
    "a10_latest_source_health": _q(lambda v: latest_source_health(v("runs"))),
}

_SNAP = f"""SELECT *, {sql_hashed('source_id', 'url')} AS document_id, {sql_hashed('source_id', 'url', 'sha256')} AS snapshot_id
  FROM (SELECT *, sha256(coalesce(body, '')) AS sha256 FROM {{observations}})"""
ORACLE = {k: with_views(q) for k, q in {
    "a1_canonicalize_urls": """WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages),
      p AS (SELECT page_id, regexp_extract(b, '^([^?]*)', 1) AS h, list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda x: x <> '')) AS q FROM u)
      SELECT page_id, lower(regexp_extract(h, '^([A-Za-z]+://[^/]*)', 1)) || regexp_replace(h, '^[A-Za-z]+://[^/]*', '') ||
        CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM p""",
    "a2_snapshot_observations": f"SELECT observation_id, sha256, document_id, snapshot_id FROM ({_SNAP})",
    "a3_distinct_blobs": f"SELECT sha256, arg_min(observation_id, (retrieved_at, observation_id)) AS first_observation, count(*) AS observations, count(DISTINCT document_id) AS documents FROM ({_SNAP}) GROUP BY 1",
    "a4_latest_documents": """SELECT source_id, url, arg_max(title, (retrieved_at, observation_id)) AS title, arg_max(evidence_class, (retrieved_at, observation_id)) AS evidence_class,
      arg_max(observation_id, (retrieved_at, observation_id)) AS latest_observation, arg_max(published_at, (retrieved_at, observation_id)) FILTER (published_at IS NOT NULL) AS published_at,
      min(retrieved_at) AS first_seen, max(retrieved_at) AS last_seen, count(*) AS observations FROM {observations} GROUP BY 1, 2""",
    "a5_content_changes": f"""WITH c AS (SELECT *, lag(sha256) OVER (PARTITION BY document_id ORDER BY retrieved_at, observation_id) AS old FROM ({_SNAP}))
      SELECT {sql_hashed('document_id', 'old', 'sha256', "'CONTENT_CHANGED'")} AS change_id, document_id, old AS old_sha256, sha256 AS new_sha256, min(retrieved_at) AS detected_at
      FROM c WHERE old <> sha256 GROUP BY ALL""",
    "a6_upsert_dimension": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 1 THEN '1' ELSE '0' END || s_name AS s_name FROM supplier",
    "a6_link_orgs": """SELECT DISTINCT r_regionkey::VARCHAR AS source_id, unnest(string_split(r_name, '')) AS organisation_id FROM region WHERE r_regionkey < 2
      UNION ALL SELECT n_regionkey::VARCHAR, n_nationkey::VARCHAR FROM nation WHERE n_regionkey >= 2""",
    "a7_evidence_class_rejects": f"SELECT observation_id, evidence_class FROM {{observations}} WHERE evidence_class NOT IN {EVIDENCE_CLASSES}",
    "a7_evidence_class_accepted": f"SELECT observation_id, evidence_class FROM {{observations}} WHERE evidence_class IN {EVIDENCE_CLASSES}",
    "a8_coverage_audit": """SELECT source_id, sum(record_count)::BIGINT AS records, sum(fact_count)::BIGINT AS facts, greatest(1, CAST(substring(source_id, 4) AS INTEGER) * 17) AS minimum
      FROM {runs} WHERE CAST(substring(source_id, 4) AS INTEGER) % 2 = 0 GROUP BY 1
      HAVING sum(record_count) <= 0 OR sum(fact_count) < greatest(1, CAST(substring(source_id, 4) AS INTEGER) * 17)""",
    "a9_source_run_status": """WITH f AS (SELECT 's' || user_id || '/' || CAST(ts AS DATE) AS source_id, CASE WHEN event_id % 11 = 0 THEN 'blocked' WHEN event_id % 11 = 1 THEN 'missing' WHEN event_id % 11 = 2 THEN 'http_error'
        WHEN event_id % 17 = 0 THEN 'network_error' END AS class, event_id % 29 = 0 AS raised, event_id % 7 = 0 AS ex, event_id % 19 = 0 AS au, user_id % 23 <> 0 AS known FROM events)
      SELECT source_id, CASE WHEN bool_or(NOT known) THEN 'configuration_error' WHEN bool_or(raised) THEN min(coalesce(class, 'error')) FILTER (raised)
        WHEN bool_or(coalesce(class, '') = 'blocked') THEN 'partial_blocked' WHEN bool_or(class IS NOT NULL) THEN 'partial' WHEN bool_or(au) THEN 'partial_extraction'
        WHEN bool_or(ex) THEN 'partial' ELSE 'success' END AS status FROM f GROUP BY 1""",
    "a10_latest_source_health": "SELECT * FROM {runs} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1",
}.items()}

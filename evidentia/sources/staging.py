"""Model tables derived from the driver's tables.

The driver's tables hold no public records, so payments, contracts, observations and so on are
derived from them.  A derivation is one SQL text that Spark and DuckDB both read, so that the
oracles start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans.storage import through_files

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "payments": """
SELECT 'p' || l_orderkey || '-' || l_linenumber AS fact_id, 'C' || c_nationkey AS payer_id, 'S' || l_suppkey AS supplier_id,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
  CAST(l_shipdate AS DATE) AS payment_date
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey""",
    "contracts": """
SELECT 'K' || o_orderkey AS contract_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'C' || c_nationkey END AS buyer_id,
  'S' || min(l_suppkey) AS supplier_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS start_day,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL '365' DAY AS DATE) AS end_day
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {customer} ON c_custkey = o_custkey
WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey, c_nationkey, o_totalprice, o_orderdate""",
    "contract_suppliers": "SELECT 'r' || contract_id AS fact_id, supplier_id, contract_id FROM {contracts}",
    "contract_buyers": "SELECT buyer_id, contract_id FROM {contracts} WHERE buyer_id IS NOT NULL",
    "contract_values": """
SELECT 'v' || contract_id AS fact_id, contract_id, amount, CASE WHEN contract_id LIKE '%7' THEN 'EUR' ELSE 'GBP' END AS currency FROM {contracts}""",
    "contract_periods": """
SELECT 's' || contract_id AS fact_id, contract_id, 'STARTS_ON' AS predicate, start_day AS day FROM {contracts}
UNION ALL SELECT 'e' || contract_id, contract_id, 'ENDS_ON', end_day FROM {contracts} WHERE contract_id NOT LIKE '%9'""",
    "evidence_facts": """
SELECT fact_id, 'payments/' || payer_id AS document_id, 'file of ' || payer_id AS snapshot_id, 'PAYMENT_TO_SUPPLIER' AS predicate, CAST(amount AS STRING) AS value_text, fact_id AS locator, 'OFFICIAL_RECORD' AS evidence_class FROM {payments}
UNION ALL SELECT fact_id, 'contracts/' || supplier_id, contract_id, 'SUPPLIER_TO_CONTRACT', contract_id, NULL, 'OFFICIAL_RECORD' FROM {contract_suppliers}
UNION ALL SELECT fact_id, 'notices/' || substring(contract_id, 1, 3), contract_id, 'HAS_VALUE', CAST(amount AS STRING), NULL, 'OFFICIAL_RECORD' FROM {contract_values}
UNION ALL SELECT fact_id, 'notices/' || substring(contract_id, 1, 3), contract_id, predicate, CAST(day AS STRING), NULL, 'OFFICIAL_RECORD' FROM {contract_periods}""",
    "names": """
SELECT 'S' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 17 = 0 THEN s_name || ' Borough Council'
  WHEN s_suppkey % 23 = 0 THEN 'HM Revenue & Customs' WHEN s_suppkey % 19 = 0 THEN 'FRANCE' ELSE s_name || ' Ltd' END AS name FROM {supplier}
UNION ALL SELECT 'C' || n_nationkey, n_name FROM {nation}""",
    "organisations": """
SELECT 'C' || n_nationkey AS organisation_id, n_name || CASE n_regionkey % 3 WHEN 0 THEN ' Borough Council' WHEN 1 THEN ' Town Council' ELSE ' Trust' END AS name,
  CASE n_regionkey % 3 WHEN 0 THEN 'borough_council' WHEN 1 THEN 'town_council' ELSE 'charity' END AS organisation_type,
  CASE WHEN n_nationkey % 2 = 0 THEN 'legacy' ELSE 'current' END AS status FROM {nation}""",
    "outside_bodies": "SELECT 'o' || o_orderkey AS fact_id, 'P' || o_custkey AS person_id, 'B' || (o_orderkey % 97) AS body_id FROM {orders} WHERE o_orderpriority = '2-HIGH'",
    "observations": """
SELECT event_id AS observation_id, event_type AS source_id, 'u/' || user_id AS url, 'title ' || user_id AS title, props AS body, ts AS retrieved_at,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END AS published_at,
  CASE WHEN event_id % 11 = 0 THEN 'rumour' ELSE 'OFFICIAL_RECORD' END AS evidence_class FROM {events}""",
    "arrivals": """
SELECT event_id AS observation_id, event_type AS source_id, 'u/' || user_id AS url, ts AS retrieved_at,
  CAST(floor((extract(DAY FROM ts) - 1) / 8.0) AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS part FROM {events}
UNION ALL SELECT event_id, event_type, 'u/' || user_id, ts, CAST(floor((extract(DAY FROM ts) - 1) / 8.0) AS BIGINT) + CAST(event_id % 2 AS BIGINT) FROM {events} WHERE event_id % 7 = 0""",
    "entities": """
SELECT 'E' || lpad(CAST(p.p_partkey AS STRING), 8, '0') AS entity_id,
  CASE p.p_partkey % 6 WHEN 5 THEN 'PERSON' WHEN 0 THEN 'COMPANY' WHEN 1 THEN 'SUPPLIER' WHEN 2 THEN 'ORGANISATION' WHEN 3 THEN 'SUPPLIER' ELSE 'COUNCIL' END AS raw_type,
  CASE p.p_partkey % 5 WHEN 0 THEN 'COMPANY' WHEN 1 THEN 'SUPPLIER' WHEN 2 THEN 'ORGANISATION' WHEN 3 THEN 'CHARITY' ELSE 'COUNCIL' END AS entity_type,
  'grp' || CAST(floor(p.p_partkey / 30.0) AS BIGINT) || ' ' || b.p_name || ' ' ||
  CASE WHEN p.p_partkey % 6 = 4 THEN substring(lower(b.p_type), 1, length(b.p_type) - 1) ELSE lower(b.p_type) END ||
  CASE WHEN p.p_partkey % 6 = 5 THEN '' ELSE ' ' END || replace(lower(b.p_brand), '#', ' ') ||
  CASE p.p_partkey % 6 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Limited' WHEN 2 THEN '' WHEN 3 THEN ' (CHAPS)' WHEN 4 THEN ' Ltd' ELSE ' PLC' END AS canonical_name,
  CASE WHEN p.p_partkey % 3 = 0 THEN 'contracts finder' ELSE 'council spending' END AS source_system,
  CASE WHEN p.p_partkey % 4 = 0 THEN 'GB-COH' END AS scheme,
  CASE WHEN p.p_partkey % 4 = 0 THEN 'sc ' || (p.p_partkey - p.p_partkey % 8) END AS identifier
FROM {part} p JOIN {part} b ON b.p_partkey = p.p_partkey - p.p_partkey % 6
UNION ALL SELECT 'Z' || p_partkey, 'SUPPLIER', 'SUPPLIER', CASE p_partkey % 3 WHEN 0 THEN '01/02/2024' WHEN 1 THEN 'Various' ELSE '12345' END, 'council spending', NULL, NULL
FROM {part} WHERE p_partkey % 50 = 7""",
    "runs": """
SELECT event_id AS run_id, 'src' || (user_id % 40) AS source_id, ts AS started_at, event_id % 7 AS record_count, event_id % 5 AS fact_count,
  CASE event_id % 9 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 500 ELSE 200 END AS http_status,
  CASE event_id % 9 WHEN 0 THEN 'blocked' WHEN 1 THEN 'missing' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'http_error' WHEN 4 THEN 'partial' ELSE 'success' END AS status FROM {events}""",
    "companies": """
SELECT lpad(CAST(p_partkey AS STRING), 8, '0') AS number, upper('grp' || CAST(floor(p_partkey / 30.0) AS BIGINT) || ' ' || p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ' ')) || ' LIMITED' AS name,
  CASE WHEN p_partkey % 24 = 0 THEN 'grp' || CAST(floor(p_partkey / 30.0) AS BIGINT) || ' ' || p_name || ' ' || substring(p_type, 1, length(p_type) - 1) || ' ' || replace(p_brand, '#', ' ') END AS previous_name,
  CASE WHEN p_partkey % 36 = 0 THEN 'Dissolved' ELSE 'Active' END AS status, 'Private Limited Company' AS category, '62012 - ' || p_brand AS sic FROM {part} WHERE p_partkey % 12 = 0
UNION ALL SELECT 'X' || c_custkey, c_name, NULL, 'Active', 'Private Limited Company', NULL FROM {customer}""",
    "controllers": """
SELECT number AS company_number, CASE WHEN length(name) % 3 = 0 THEN 'corporate-entity-person-with-significant-control' WHEN length(name) % 3 = 1 THEN 'individual-person-with-significant-control' ELSE 'super-secure' END AS kind,
  'Person ' || number AS name, 'ownership-of-shares-75-to-100-percent' AS nature FROM {companies}""",
    "signals": """
SELECT supplier_id || '/' || payer_id AS signal_id, CASE count(*) % 5 WHEN 0 THEN 'SUPPLIER_PAYMENT_CONTRACT_OVERLAP' WHEN 1 THEN 'PAYMENT_STREAM_WITHOUT_TRACKED_PROCUREMENT_LINK'
    WHEN 2 THEN 'PAYMENTS_OUTSIDE_TRACKED_CONTRACT_PERIODS' WHEN 3 THEN 'PAYMENTS_EXCEED_TRACKED_CONTRACT_VALUE' ELSE 'SHARED_OUTSIDE_BODY' END AS signal_type,
  CASE count(*) % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'approved' WHEN 2 THEN 'stale' ELSE 'withheld' END AS status, 0.25 AS score, supplier_id AS subject_id,
  CASE WHEN count(*) % 7 = 0 THEN NULL ELSE 'P' || (count(*) % 3) END AS object_id, CASE count(*) % 5 WHEN 0 THEN 'documented_cross_source_link_not_a_finding' WHEN 1 THEN 'source_discovery_review_not_a_finding' ELSE 'review_required_not_a_finding' END AS interpretation,
  CASE WHEN count(*) % 6 = 0 THEN NULL ELSE sum(amount) END AS payment_total, CASE WHEN count(*) % 2 = 0 THEN max(amount) END AS tracked_total, min(fact_id) AS fact_id FROM {payments} GROUP BY supplier_id, payer_id""",
    "signal_metadata": """
SELECT signal_id, signal_type, status, score, CASE WHEN signal_id LIKE '%3' THEN '["interpretation"]' WHEN signal_id LIKE '%4' THEN NULL WHEN signal_id LIKE '%5' THEN 'none' ELSE
  chr(123) || '"interpretation":"' || interpretation || '","payment_total_gbp":' || coalesce(CAST(payment_total AS STRING), 'null') || ',"tracked_contract_value_gbp":' || coalesce(CAST(tracked_total AS STRING), '"7"')
  || ',"signal_id":"' || signal_id || '"' || CASE WHEN signal_id LIKE '%6' THEN '' ELSE chr(125) END END AS metadata FROM {signals}""",
    "signal_reviews": """
SELECT 'v' || signal_id AS review_id, 'SIGNAL_REVIEW' AS item_type, CASE WHEN status = 'stale' THEN 'stale' ELSE 'open' END AS status, subject_id, object_id, signal_id, score FROM {signals}""",
    "published_facts": """
SELECT 'f' || l_orderkey || '-' || l_linenumber AS fact_id, 'D' || l_suppkey AS document_id, 'N' || l_suppkey || '-' || (l_partkey % 3) AS snapshot_id, 'PAYMENT' AS fact_type, 'PAYMENT_TO_SUPPLIER' AS predicate,
  'C' || (l_orderkey % 25) AS subject_id, 'S' || l_suppkey AS object_id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS value_text, 'row ' || l_linenumber AS locator, 'OFFICIAL_RECORD' AS evidence_class, l_shipdate AS retrieved_at FROM {lineitem}""",
    "phrases": "SELECT 'B' || item_id AS entity_id, text AS name FROM {benchmark}",
    "aliases": "SELECT CASE WHEN item_id % 5 = 4 THEN 'Z' ELSE 'S' END || (item_id * 3 + 1) AS entity_id, text AS name FROM {benchmark}",
    "control": """
SELECT 'Q' || c_custkey AS psc_id, replace(c_name, '#', ' ') AS psc_name, 'S' || (c_custkey % 100) AS company_id FROM {customer}
UNION ALL SELECT 'Q' || c_custkey, replace(c_name, '#', ' '), 'S' || (c_custkey % 7) FROM {customer} WHERE c_custkey % 9 = 0""",
    "office": """
SELECT 'h' || c_custkey AS fact_id, 'P' || c_custkey AS person_id, upper(replace(c_name, '#', '  ')) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'OWNER_OF' ELSE 'MEMBER_OF' END AS predicate FROM {customer}
UNION ALL SELECT 'w' || c_custkey, 'P' || c_custkey, replace(c_name, '#', ' '), 'REPRESENTS_WARD' FROM {customer} WHERE c_custkey % 2 = 0""",
    "declared": """
SELECT 'd' || c_custkey AS fact_id, 'P' || (c_custkey % 50) AS person_id,
  CASE WHEN c_custkey % 10 = 3 THEN '[REDACTED_FROM_STRUCTURED_DATA]' ELSE 'My wife and ' || replace(c_name, '#', ' ') || ' hold shares' END AS value_text FROM {customer}""",
    "connected_facts": """
SELECT fact_id, document_id, predicate FROM {evidence_facts} UNION ALL SELECT fact_id, 'registers/' || person_id, 'REGISTER_ENTRY' FROM {texts}
UNION ALL SELECT fact_id, 'offices/' || person_id, predicate FROM {office} UNION ALL SELECT fact_id, 'interests/' || person_id, 'DECLARED_INTEREST' FROM {declared}
UNION ALL SELECT fact_id, 'bodies/' || body_id, 'APPOINTED_TO_OUTSIDE_BODY' FROM {outside_bodies}""",
    "texts": "SELECT 'D' || doc_id AS fact_id, 'P' || (doc_id % 100) AS person_id, text AS value_text FROM {documents}",
}

_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """A base table or a model table; ``stored`` has model tables that stand ready."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if stored and name in stored:
        return stored[name]
    sql = VIEWS[name]
    return spark.sql(sql, **{d: view(spark, sf_dir, d, stored) for d in sorted(set(_NAME.findall(sql)))})


def stored_views(spark: SparkSession, sf_dir: str, *names: str) -> Callable[[str], DataFrame]:
    """``view`` with the named model tables written when they are first asked for; all that derives from them reads these."""
    stored: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        for n in names:
            if n not in stored and n in _needed(name):
                stored[n] = through_files(view(spark, sf_dir, n, stored))
        return view(spark, sf_dir, name, stored)

    return get


def _needed(name: str) -> set[str]:
    """The model table and those it derives from."""
    return {name} | {x for d in _NAME.findall(VIEWS.get(name, "")) for x in _needed(d)}


def with_views(query: str) -> str:
    """DuckDB SQL: the query (model tables in braces) behind the derivations that it needs."""
    order: list[str] = []

    def need(sql: str) -> None:
        for d in _NAME.findall(sql):
            if d in VIEWS and d not in order:
                need(VIEWS[d])
                order.append(d)

    need(query)
    plain = lambda s: _NAME.sub(lambda m: "stg_" + m[1] if m[1] in VIEWS else m[1], s)
    ctes = ", ".join(f"stg_{d} AS ({plain(VIEWS[d])})" for d in order)
    query = plain(query.strip())
    if not ctes:
        return query
    for head in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(head):
            return f"{head}{ctes}, {query[len(head):]}"
    return f"WITH {ctes} {query}"

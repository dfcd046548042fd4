"""Detectors: aggregates and joins over payments, contracts, registries and declarations.

Inputs are typed views of facts: payments (fact_id, payer_id, supplier_id, amount,
payment_date), contract_suppliers (fact_id, supplier_id, contract_id), contract_buyers
(buyer_id, contract_id), contract_values (fact_id, contract_id, amount, currency) and
contract_periods (fact_id, contract_id, predicate, day).  Ids are already canonical
(``resolve.canonicalise``).  A contract without a buyer has a null scope and meets only
payments without a payer.  Payments are summed before any join, so a payer or supplier with a
large share of all rows is combined per task; evidence is rows of facts (``signals``), never arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.plans.storage import through_files
from evidentia.sources.staging import view, with_views

DISCOVERY_THRESHOLD = 30000
OVERRUN_FACTOR, OVERRUN_LEAST = "1.10", 1000
OFFICE_PREDICATES = (
    "MEMBER_OF", "REPRESENTS_WARD", "MEMBER_OF_PARTY", "APPOINTED_TO_OUTSIDE_BODY", "DECLARED_INTEREST",
    "DECLARED_INTEREST_AT", "ATTENDANCE_RECORDED_FOR",
)
REDACTED = "[REDACTED_FROM_STRUCTURED_DATA]"
LEGACY_TYPES = ("district_council", "county_council", "borough_council", "city_council")


def contract_scopes(contract_suppliers: DataFrame, contract_buyers: DataFrame) -> DataFrame:
    """(buyer_id, supplier_id, contract_id, fact_id): a null buyer where a contract has none."""
    return contract_suppliers.join(contract_buyers.distinct(), "contract_id", "left").select(
        "buyer_id", "supplier_id", "contract_id", "fact_id"
    )


def supplier_facts(payments: DataFrame, contract_suppliers: DataFrame) -> DataFrame:
    """(supplier_id, fact_id): the payments and contracts of each supplier, a row each."""
    facts = payments.select("supplier_id", "fact_id").unionByName(contract_suppliers.select("supplier_id", "fact_id"))
    return facts.filter("supplier_id IS NOT NULL").distinct()


def shared_outside_bodies(appointments: DataFrame) -> DataFrame:
    """Bodies to which two or more people are appointed: (body_id, n, n_facts, score)."""
    rows = appointments.filter("person_id IS NOT NULL AND body_id IS NOT NULL")
    each = rows.select("body_id", "person_id", "fact_id").distinct().groupBy("body_id", "person_id").agg(F.count("*").alias("k"))
    people = each.groupBy("body_id").agg(F.count("*").alias("n")).filter("n >= 2")
    facts = rows.select("body_id", "fact_id").distinct().groupBy("body_id").agg(F.count("*").alias("n_facts"))
    return people.join(facts, "body_id").withColumn("score", F.least(F.lit(0.55), F.lit(0.25) + F.lit(0.08) * (F.col("n") - 2)))


def shared_body_evidence(appointments: DataFrame) -> DataFrame:
    """The people and facts of ``shared_outside_bodies``, a row each: (body_id, n, n_facts, score, person_id, fact_id)."""
    rows = appointments.filter("person_id IS NOT NULL AND body_id IS NOT NULL").select("body_id", "person_id", "fact_id").distinct()
    return rows.join(shared_outside_bodies(appointments), "body_id").select("body_id", "n", "n_facts", "score", "person_id", "fact_id")


def payment_contract_overlap(payments: DataFrame, contract_suppliers: DataFrame) -> DataFrame:
    """Suppliers with payments and contracts: counts, total and contract ids."""
    paid = payments.filter("supplier_id IS NOT NULL").groupBy("supplier_id").agg(
        F.count("*").alias("payment_count"), F.sum("amount").cast("decimal(28,2)").alias("payment_total")
    )
    held = contract_suppliers.filter("supplier_id IS NOT NULL").groupBy("supplier_id").agg(
        F.count("*").alias("contract_facts"), F.array_sort(F.collect_set("contract_id")).alias("contract_ids")
    )
    return paid.join(held, "supplier_id")


def payment_streams(payments: DataFrame) -> DataFrame:
    """Net, gross and credit totals of each (payer_id, supplier_id)."""
    credit = F.when(F.col("amount") < 0, F.col("amount"))
    positive = F.when(F.col("amount") > 0, F.col("amount"))
    zero = F.lit(0).cast("decimal(28,2)")
    return payments.filter("supplier_id IS NOT NULL AND amount IS NOT NULL").groupBy("payer_id", "supplier_id").agg(
        F.sum("amount").cast("decimal(28,2)").alias("net_total"),
        F.coalesce(F.sum(positive).cast("decimal(28,2)"), zero).alias("gross_total"),
        F.coalesce(F.sum(credit).cast("decimal(28,2)"), zero).alias("credit_total"),
        F.count("*").alias("payment_count"),
        F.count(credit).alias("credit_count"),
    )


def payments_exceed_contract_value(
    payments: DataFrame, contract_suppliers: DataFrame, contract_buyers: DataFrame, contract_values: DataFrame
) -> DataFrame:
    """Streams whose net payments are over 1.10 times, and 1000 over, the tracked value of their contracts.

    A contract counts once with its largest GBP value.
    """
    best = contract_values.filter("upper(coalesce(currency, 'GBP')) = 'GBP' AND amount >= 0").groupBy("contract_id").agg(F.max("amount").alias("value"))
    scopes = contract_scopes(contract_suppliers, contract_buyers).select("buyer_id", "supplier_id", "contract_id").distinct()
    tracked = scopes.join(best, "contract_id", "left").groupBy("buyer_id", "supplier_id").agg(
        F.sum("value").cast("decimal(28,2)").alias("tracked_total"), F.count("*").alias("contract_count")
    )
    p, t = payment_streams(payments).alias("p"), tracked.filter("tracked_total > 0").alias("t")
    joined = p.join(t, F.col("p.payer_id").eqNullSafe(F.col("t.buyer_id")) & (F.col("p.supplier_id") == F.col("t.supplier_id")))
    over = F.col("net_total") - F.col("tracked_total")
    return joined.filter((F.col("net_total") > F.col("tracked_total") * F.lit(OVERRUN_FACTOR).cast("decimal(4,2)")) & (over >= OVERRUN_LEAST)).select(
        "p.payer_id", "p.supplier_id", "net_total", "gross_total", "credit_total", "tracked_total",
        over.cast("decimal(28,2)").alias("difference"), "contract_count",
    )


def complete_periods(contract_suppliers: DataFrame, contract_buyers: DataFrame, contract_periods: DataFrame) -> DataFrame:
    """(buyer_id, supplier_id, contract_id, first_day, last_day) of contracts with both ends in order."""
    days = contract_periods.filter("day IS NOT NULL").groupBy("contract_id").agg(
        F.min(F.when(F.col("predicate") == "STARTS_ON", F.col("day"))).alias("first_day"),
        F.max(F.when(F.col("predicate") == "ENDS_ON", F.col("day"))).alias("last_day"),
    ).filter("first_day <= last_day")
    scopes = contract_scopes(contract_suppliers, contract_buyers).select("buyer_id", "supplier_id", "contract_id").distinct()
    return scopes.join(days, "contract_id")


def days_outside_periods(
    payments: DataFrame, contract_suppliers: DataFrame, contract_buyers: DataFrame, contract_periods: DataFrame
) -> DataFrame:
    """(payer_id, supplier_id, payment_date, n, amount, period_count): days with positive payments in none of a stream's complete periods.

    Payments and periods are first summed by day, so a stream has a row for each day at most.  A
    sweep in the order of days tells a day within some period: the latest end of the periods that
    have begun is not before it.
    """
    periods = complete_periods(contract_suppliers, contract_buyers, contract_periods)
    stream = ["payer_id", "supplier_id"]
    begun = periods.select(F.col("buyer_id").alias("payer_id"), "supplier_id", F.col("first_day").alias("day"), "last_day")
    begun = begun.groupBy(*stream, "day").agg(F.max("last_day").alias("last_day"), F.count("*").alias("k"))
    p = payments.filter("amount > 0 AND payment_date IS NOT NULL AND supplier_id IS NOT NULL")
    paid = p.groupBy(*stream, F.col("payment_date").alias("day")).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,2)").alias("amount"))
    both = begun.withColumns({"n": F.lit(None).cast("long"), "amount": F.lit(None).cast("decimal(28,2)")}).unionByName(
        paid.withColumns({"last_day": F.lit(None).cast("date"), "k": F.lit(0).cast("long")}))
    whole = Window.partitionBy(*stream)
    swept = both.withColumns({
        "reached": F.max("last_day").over(whole.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)), "period_count": F.sum("k").over(whole)})
    return swept.filter("n IS NOT NULL AND period_count > 0 AND coalesce(reached < day, true)").select(*stream, F.col("day").alias("payment_date"), "n", "amount", "period_count")


def payments_outside_periods(
    payments: DataFrame, contract_suppliers: DataFrame, contract_buyers: DataFrame, contract_periods: DataFrame
) -> DataFrame:
    """Positive dated payments in none of the complete periods of their buyer and supplier, by stream."""
    return streams_outside_periods(days_outside_periods(payments, contract_suppliers, contract_buyers, contract_periods))


def streams_outside_periods(days: DataFrame) -> DataFrame:
    """``payments_outside_periods`` of ``days_outside_periods``."""
    return days.groupBy("payer_id", "supplier_id").agg(
        F.sum("n").alias("outside_count"), F.max("period_count").alias("period_count"), F.sum("amount").cast("decimal(28,2)").alias("outside_total"),
    )


def public_authority_aliases(organisations: DataFrame) -> DataFrame:
    """(alias): keys of councils, and the bare places of legacy district to city councils."""
    kind, key = F.lower(F.coalesce("organisation_type", F.lit(""))), text.basic_org_key("name")
    councils = organisations.filter((kind.contains("council") | kind.isin("unitary_authority", "combined_authority")) & (key != ""))
    place = text.authority_alias("name")
    legacy = councils.filter((F.lower("status") == "legacy") & kind.isin(*LEGACY_TYPES) & (F.length(place) >= 5))
    return councils.select(key.alias("alias")).unionByName(legacy.select(place.alias("alias"))).distinct()


def unmatched_payment_streams(
    payments: DataFrame, contract_suppliers: DataFrame, contract_buyers: DataFrame, names: DataFrame,
    organisations: DataFrame, threshold: int = DISCOVERY_THRESHOLD,
) -> DataFrame:
    """Net payment streams of ``threshold`` or more without a contract of the same buyer.

    Payers that pay themselves, public authorities and other non-commercial payees are left out.
    """
    streams = payment_streams(payments.filter("amount <> 0"))
    streams = streams.filter((F.col("net_total") >= threshold) & ~F.coalesce(F.col("payer_id") == F.col("supplier_id"), F.lit(False))).alias("p")
    scopes = contract_scopes(contract_suppliers, contract_buyers).alias("c")
    rest = streams.join(
        scopes, F.col("p.payer_id").eqNullSafe(F.col("c.buyer_id")) & (F.col("p.supplier_id") == F.col("c.supplier_id")), "left_anti"
    )
    named = rest.join(names.select(F.col("entity_id").alias("supplier_id"), "name"), "supplier_id", "left")
    named = named.withColumn("supplier_name", F.coalesce("name", "supplier_id"))
    named = named.filter(text.payee_class("supplier_name").isNull()).withColumn("alias", text.basic_org_key("supplier_name"))
    return named.join(public_authority_aliases(organisations), "alias", "left_anti").select(
        "payer_id", "supplier_id", "supplier_name", "net_total", "gross_total", "credit_total", "payment_count", "credit_count"
    )


def phrase_mentions(texts: DataFrame, phrases: DataFrame, normal, min_length: int = 6, min_single: int = 9) -> DataFrame:
    """(fact_id, person_id, entity_id, phrase): phrases that occur in texts as whole words in a row.

    ``texts`` has fact_id, person_id and value_text, which ``normal`` (a function of a column)
    makes words with single spaces; ``phrases`` has entity_id and key, such words.  Texts are
    exploded to words with the number of the text; those that begin a phrase equi-join, alone and
    with the next word, the beginnings of phrases, and what is found is confirmed in the text.
    """
    wanted = phrases.filter(F.length("key") >= min_length).filter((F.instr("key", " ") > 0) | (F.length("key") >= min_single))
    wanted = wanted.select("entity_id", F.col("key").alias("phrase")).withColumn("w", F.split("phrase", " "))
    wanted = wanted.withColumn("n", F.size("w")).withColumn("start", F.array_join(F.slice("w", 1, 2), " "))
    own = texts.select("fact_id", "person_id", "value_text").withColumn("text_id", F.xxhash64("fact_id", "person_id", "value_text"))
    # only the text's number, the place and one or two words are exploded: the text itself is joined to hits.
    # Words that begin no phrase go before anything is shuffled, if the list of such words is small enough to be sent
    words = own.select("text_id", F.explode(F.array(F.split(normal("value_text"), " "))).alias("a"))
    words = words.select("text_id", "a", F.slice("a", F.lit(2), F.size("a")).alias("b"))
    at = words.select("text_id", F.explode_outer(F.arrays_zip("a", "b")).alias("p")).select(
        "text_id", F.col("p.a").alias("one"), F.when(F.col("p.b").isNotNull(), F.concat_ws(" ", "p.a", "p.b")).alias("two")).filter("one <> ''")
    at = at.join(wanted.select(F.col("w")[0].alias("one")).distinct(), "one", "left_semi")
    at = at.select("text_id", F.explode(F.array("one", "two")).alias("start")).filter("start IS NOT NULL")
    maybe = at.distinct().join(wanted.select("start", "phrase", "entity_id"), "start").select("text_id", "phrase", "entity_id").distinct()
    # the phrase is made of the words of ``key`` and single spaces, so words in a row are a part of the text
    inside = F.contains(F.concat(F.lit(" "), "key", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" ")))
    told = own.join(maybe.select("text_id").distinct(), "text_id", "left_semi").select("text_id", "fact_id", "person_id", F.explode(F.array(normal("value_text"))).alias("key"))
    hits = maybe.join(told, "text_id").filter(inside)
    return hits.select("fact_id", "person_id", "entity_id", "phrase").distinct()


def interest_mentions(declarations: DataFrame, aliases: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Declarations that name one of ``suppliers`` (supplier_id): those of contracts, or those of payments.

    ``aliases`` has entity_id and name; ``declarations`` fact_id, person_id and value_text.
    """
    rows = declarations.filter(F.col("value_text").isNotNull() & (F.col("value_text") != REDACTED))
    known = suppliers.filter("supplier_id IS NOT NULL").select(F.col("supplier_id").alias("entity_id")).distinct()
    named = aliases.join(known, "entity_id", "left_semi").select("entity_id", text.normalize_org_name("name").alias("key")).distinct()
    return phrase_mentions(rows, named, text.normalize_org_name)


def _person_keys(df: DataFrame, name: str) -> DataFrame:
    key = text.normalize_name(name)
    return df.withColumn("key", key).filter((F.size(F.split("key", " ")) >= 2) & (F.length("key") >= 6))


def supplier_controllers(control: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Controllers (psc_id, psc_name, company_id, key) of companies that are ``suppliers`` (supplier_id)."""
    return _person_keys(control, "psc_name").join(suppliers.select(F.col("supplier_id").alias("company_id")).distinct(), "company_id", "left_semi")


def office_facts(office: DataFrame) -> DataFrame:
    """(key, fact_id): the facts of office-holders by their normalised name; ``office`` (fact_id, person_id, name, predicate)."""
    return _person_keys(office.filter(F.col("predicate").isin(*OFFICE_PREDICATES)), "name").select("key", "fact_id").distinct()


def control_person_officeholder(controllers: DataFrame, held: DataFrame) -> DataFrame:
    """(psc_id, company_id, key): controllers of suppliers whose name is an office-holder's (``office_facts``)."""
    return controllers.join(held.select("key").distinct(), "key", "left_semi").select("psc_id", "company_id", "key").distinct()


def control_person_declared_interest(controllers: DataFrame, declarations: DataFrame) -> DataFrame:
    """Controllers of suppliers whose full name occurs in a declaration, with the kin words there."""
    rows = declarations.filter(F.col("value_text").isNotNull() & (F.col("value_text") != REDACTED))
    hits = phrase_mentions(rows, controllers.select(F.col("psc_id").alias("entity_id"), "key").distinct(), text.normalize_name).withColumnRenamed("entity_id", "psc_id")
    return hits.join(controllers.select("psc_id", "company_id").distinct(), "psc_id").join(rows.select("fact_id", "value_text"), "fact_id").select(
        "psc_id", "company_id", "fact_id", "person_id", text.kin_terms("value_text").alias("kin"))


def _counts(facts: DataFrame, key: str, name: str) -> DataFrame:
    return facts.select(key, "fact_id").distinct().groupBy(key).agg(F.count("*").alias(name))


def officeholder_evidence(found: DataFrame, suppliers: DataFrame, held: DataFrame) -> DataFrame:
    """``control_person_officeholder`` with score and n_evidence: distinct facts of the supplier and the office-holder.

    Both are counted for themselves, and facts that are in both once: evidence is not multiplied by controllers.
    """
    both = suppliers.join(held, "fact_id").groupBy(F.col("supplier_id").alias("company_id"), "key").agg(F.count_distinct("fact_id").alias("_b"))
    rows = found.join(_counts(suppliers, "supplier_id", "_s").withColumnRenamed("supplier_id", "company_id"), "company_id").join(_counts(held, "key", "_h"), "key")
    n = F.col("_s") + F.col("_h") - F.coalesce("_b", F.lit(0))
    return rows.join(both, ["company_id", "key"], "left").select("psc_id", "company_id", "key", n.alias("n_evidence"), F.lit(0.76).alias("score"))


def declared_evidence(found: DataFrame, suppliers: DataFrame) -> DataFrame:
    """``control_person_declared_interest`` with score and n_evidence: distinct facts of the supplier, and the declaration."""
    own = suppliers.select(F.col("supplier_id").alias("company_id"), "fact_id", F.lit(1).alias("_b")).distinct()
    rows = found.join(_counts(suppliers, "supplier_id", "_s").withColumnRenamed("supplier_id", "company_id"), "company_id").join(own, ["company_id", "fact_id"], "left")
    n = F.col("_s") + 1 - F.coalesce("_b", F.lit(0))
    return rows.select("psc_id", "company_id", "fact_id", "person_id", "kin", n.alias("n_evidence"), F.lit(0.84).alias("score"))


# Queries over the driver's tables -----------------------------------------------------------


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _suppliers(v) -> DataFrame:
    return supplier_facts(v("payments"), v("contract_suppliers"))


def _officeholders(v) -> DataFrame:
    suppliers, held = through_files(_suppliers(v)), office_facts(v("office"))
    return officeholder_evidence(control_person_officeholder(supplier_controllers(v("control"), suppliers), held), suppliers, held)


def _declared_control(v) -> DataFrame:
    suppliers = through_files(_suppliers(v))
    found = control_person_declared_interest(supplier_controllers(v("control"), suppliers), v("declared"))
    return declared_evidence(found, suppliers).withColumn("kin", F.array_join("kin", ","))


QUERIES = {
    "g1_shared_outside_bodies": _q(lambda v: shared_body_evidence(v("outside_bodies"))),
    "g5_payment_contract_overlap": _q(lambda v: payment_contract_overlap(v("payments"), v("contract_suppliers")).withColumn("contract_ids", F.size("contract_ids"))),
    "g6_payments_exceed_contract_value": _q(lambda v: payments_exceed_contract_value(v("payments"), v("contract_suppliers"), v("contract_buyers"), v("contract_values"))),
    "g7_payments_outside_periods": _q(lambda v: payments_outside_periods(v("payments"), v("contract_suppliers"), v("contract_buyers"), v("contract_periods"))),
    "g8_unmatched_payment_streams": _q(lambda v: unmatched_payment_streams(v("payments"), v("contract_suppliers"), v("contract_buyers"), v("names"), v("organisations"))),
    "g9_public_authority_aliases": _q(lambda v: public_authority_aliases(v("organisations"))),
    "g2_interest_mentions_contract_supplier": _q(lambda v: interest_mentions(v("texts"), v("aliases"), v("contract_suppliers"))),
    "g3_interest_mentions_payment_supplier": _q(lambda v: interest_mentions(v("texts"), v("aliases"), v("payments"))),
    "g_phrase_mentions": _q(lambda v: phrase_mentions(v("texts"), v("phrases").select("entity_id", text.normalize_org_name("name").alias("key")), text.normalize_org_name)),
    "g10_control_person_officeholder": _q(_officeholders),
    "g11_control_person_declared_interest": _q(_declared_control),
    "g12_supplier_evidence": _q(lambda v: _suppliers(v).groupBy("supplier_id").agg(F.count("*").alias("n_facts"), F.min("fact_id").alias("first_fact"))),
}

_SCOPES = "SELECT DISTINCT b.buyer_id, s.supplier_id, s.contract_id FROM {contract_suppliers} s LEFT JOIN {contract_buyers} b USING (contract_id)"
_STREAMS = """SELECT payer_id, supplier_id, sum(amount)::DECIMAL(28,2) AS net_total, coalesce(sum(amount) FILTER (amount > 0), 0)::DECIMAL(28,2) AS gross_total,
  coalesce(sum(amount) FILTER (amount < 0), 0)::DECIMAL(28,2) AS credit_total, count(*) AS payment_count, count(*) FILTER (amount < 0) AS credit_count
  FROM {payments} WHERE amount <> 0 GROUP BY ALL"""
_ALIASES = f"""SELECT DISTINCT alias FROM (
  SELECT {text.sql_basic_key('name')} AS alias FROM {{organisations}} WHERE organisation_type LIKE '%council%'
  UNION ALL SELECT trim(regexp_replace({text.sql_basic_key('name')}, '({"|".join(text.AUTHORITY_NAME_SUFFIXES)})$', '')) FROM {{organisations}}
  WHERE status = 'legacy' AND organisation_type IN {LEGACY_TYPES}) WHERE length(alias) >= 5 OR alias IN (
  SELECT {text.sql_basic_key('name')} FROM {{organisations}})"""
UNMATCHED = f"""SELECT p.payer_id, p.supplier_id, coalesce(name, p.supplier_id) AS supplier_name, net_total, gross_total, credit_total, payment_count, credit_count
      FROM ({_STREAMS}) p LEFT JOIN {{names}} n ON n.entity_id = p.supplier_id
      WHERE net_total >= {DISCOVERY_THRESHOLD} AND p.payer_id <> p.supplier_id
      AND NOT EXISTS (SELECT 1 FROM ({_SCOPES}) c WHERE c.buyer_id IS NOT DISTINCT FROM p.payer_id AND c.supplier_id = p.supplier_id)
      AND {text.sql_payee_class("coalesce(name, p.supplier_id)")} IS NULL AND {text.sql_basic_key("coalesce(name, p.supplier_id)")} NOT IN (SELECT alias FROM ({_ALIASES}))"""
def mentions_sql(phrases: str) -> str:
    return f"""SELECT DISTINCT t.fact_id, t.person_id, p.entity_id, p.key AS phrase
  FROM (SELECT fact_id, person_id, ' ' || {text.sql_normalize_org('value_text')} || ' ' AS k FROM {{texts}}) t
  JOIN (SELECT entity_id, {text.sql_normalize_org('name')} AS key FROM {phrases}) p ON contains(t.k, ' ' || p.key || ' ')
  WHERE length(p.key) >= 6 AND (contains(p.key, ' ') OR length(p.key) >= 9)"""


OF_SUPPLIERS = "(SELECT * FROM {{aliases}} WHERE entity_id IN (SELECT supplier_id FROM {{{0}}}))"
CONTROLLERS = "(SELECT * FROM {control} WHERE company_id IN (SELECT supplier_id FROM {payments} UNION ALL SELECT supplier_id FROM {contract_suppliers}))"
_FACTS_OF = """e AS (SELECT DISTINCT supplier_id, fact_id FROM (SELECT supplier_id, fact_id FROM {payments} UNION ALL SELECT supplier_id, fact_id FROM {contract_suppliers})),
 en AS (SELECT supplier_id, count(*) AS n FROM e GROUP BY 1)"""
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"

ORACLE = {k: with_views(q) for k, q in {
    "g1_shared_outside_bodies": """SELECT DISTINCT body_id, n, n_facts, score, person_id, fact_id FROM {outside_bodies} JOIN
      (SELECT body_id, count(DISTINCT person_id) AS n, count(DISTINCT fact_id) AS n_facts, least(0.55, 0.25 + 0.08 * (count(DISTINCT person_id) - 2))::DOUBLE AS score
      FROM {outside_bodies} GROUP BY body_id HAVING count(DISTINCT person_id) >= 2) USING (body_id)""",
    "g5_payment_contract_overlap": """SELECT * FROM (SELECT supplier_id, count(*) AS payment_count, sum(amount)::DECIMAL(28,2) AS payment_total FROM {payments} GROUP BY 1)
      JOIN (SELECT supplier_id, count(*) AS contract_facts, count(DISTINCT contract_id)::INTEGER AS contract_ids FROM {contract_suppliers} GROUP BY 1) USING (supplier_id)""",
    "g6_payments_exceed_contract_value": f"""WITH best AS (SELECT contract_id, max(amount) AS value FROM {{contract_values}} WHERE currency = 'GBP' AND amount >= 0 GROUP BY 1),
      t AS (SELECT buyer_id, supplier_id, sum(value)::DECIMAL(28,2) AS tracked_total, count(*) AS contract_count FROM ({_SCOPES}) LEFT JOIN best USING (contract_id) GROUP BY 1, 2)
      SELECT p.payer_id, p.supplier_id, net_total, gross_total, credit_total, tracked_total, net_total - tracked_total AS difference, contract_count
      FROM ({_STREAMS}) p JOIN t ON p.payer_id IS NOT DISTINCT FROM t.buyer_id AND p.supplier_id = t.supplier_id
      WHERE tracked_total > 0 AND net_total > tracked_total * 1.10 AND net_total - tracked_total >= 1000""",
    "g7_payments_outside_periods": f"""WITH d AS (SELECT contract_id, min(day) FILTER (predicate = 'STARTS_ON') AS a, max(day) FILTER (predicate = 'ENDS_ON') AS z FROM {{contract_periods}} GROUP BY 1),
      c AS (SELECT * FROM ({_SCOPES}) JOIN d USING (contract_id) WHERE a <= z),
      s AS (SELECT buyer_id, supplier_id, count(*) AS period_count FROM c GROUP BY 1, 2)
      SELECT p.payer_id, p.supplier_id, count(*) AS outside_count, max(period_count) AS period_count, sum(amount)::DECIMAL(28,2) AS outside_total
      FROM {{payments}} p JOIN s ON p.payer_id IS NOT DISTINCT FROM s.buyer_id AND p.supplier_id = s.supplier_id
      WHERE amount > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.buyer_id IS NOT DISTINCT FROM p.payer_id AND c.supplier_id = p.supplier_id AND p.payment_date BETWEEN a AND z)
      GROUP BY 1, 2""",
    "g8_unmatched_payment_streams": UNMATCHED,
    "g9_public_authority_aliases": _ALIASES,
    "g2_interest_mentions_contract_supplier": mentions_sql(OF_SUPPLIERS.format("contract_suppliers")),
    "g3_interest_mentions_payment_supplier": mentions_sql(OF_SUPPLIERS.format("payments")),
    "g_phrase_mentions": mentions_sql("{phrases}"),
    "g10_control_person_officeholder": f"""WITH {_FACTS_OF}, h AS (SELECT DISTINCT {_KEY.format('name')} AS key, fact_id FROM {{office}} WHERE predicate IN {OFFICE_PREDICATES}),
      hn AS (SELECT key, count(*) AS h FROM h GROUP BY 1), bn AS (SELECT supplier_id, key, count(DISTINCT fact_id) AS b FROM e JOIN h USING (fact_id) GROUP BY 1, 2),
      f AS (SELECT DISTINCT psc_id, company_id, {_KEY.format('psc_name')} AS key FROM {CONTROLLERS})
      SELECT psc_id, company_id, f.key, n + h - coalesce(b, 0) AS n_evidence, 0.76::DOUBLE AS score FROM f JOIN hn ON hn.key = f.key JOIN en ON en.supplier_id = company_id LEFT JOIN bn ON bn.supplier_id = company_id AND bn.key = f.key""",
    "g11_control_person_declared_interest": f"""WITH {_FACTS_OF}, f AS (SELECT DISTINCT psc_id, company_id, fact_id, person_id, 'wife' AS kin FROM {CONTROLLERS} c
      JOIN {{declared}} d ON contains(' ' || {_KEY.format('value_text')} || ' ', ' ' || {_KEY.format('psc_name')} || ' '))
      SELECT psc_id, company_id, f.fact_id, person_id, kin, n + CASE WHEN e.fact_id IS NULL THEN 1 ELSE 0 END AS n_evidence, 0.84::DOUBLE AS score
      FROM f JOIN en ON en.supplier_id = company_id LEFT JOIN e ON e.supplier_id = company_id AND e.fact_id = f.fact_id""",
    "g12_supplier_evidence": """SELECT supplier_id, count(DISTINCT fact_id) AS n_facts, min(fact_id) AS first_fact FROM
      (SELECT supplier_id, fact_id FROM {payments} UNION ALL SELECT supplier_id, fact_id FROM {contract_suppliers}) GROUP BY 1""",
}.items()}

"""Registry enrichment: national registers narrowed to known names before anything else is done.

Register rows are scanned once, their names normalised and semi-joined to the aliases; nothing
else of a register is kept.  Address, birth and contact fields are not in the schemas, so they
are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.functions.ids import hashed, sql_hashed
from evidentia.sources.staging import view, with_views

from evidentia.plans.storage import shared_dir

from .resolve import _N, canonical_aliases, standardise_names

CONTROL_SCHEMA = "company_number string, data struct<kind:string,name:string,natures_of_control:array<string>>"


def read_register(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",") -> DataFrame:
    """A delimited register with text columns chosen by header, compared by letters and digits only.

    ``columns`` maps output names to headers.  Cells beyond the header are ignored and missing
    ones are null; headers that the file lacks give null columns.
    """
    raw = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE", multiLine=False)
    bare = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    have = {bare(c): c for c in reversed(raw.columns)}
    pick = lambda h: F.trim(F.col(f"`{have[bare(h)]}`")) if bare(h) in have else F.lit(None).cast("string")
    return raw.select(*(pick(h).alias(out) for out, h in columns.items()))


def known_names(aliases: DataFrame) -> DataFrame:
    return aliases.filter(F.length("normalized_alias") >= 5).select(F.col("normalized_alias").alias("key")).distinct()


def import_companies(register: DataFrame, aliases: DataFrame) -> DataFrame:
    """Companies (number, name, previous_names, status, category, sic) with a name or previous name that is known.

    Adds record_id, entity_id, the matched keys and the identifier gb-coh.
    """
    names = F.array_compact(F.concat(F.array("name"), F.coalesce("previous_names", F.array().cast("array<string>"))))
    rows = register.withColumn("number", F.upper(F.trim("number"))).withColumn("key", F.explode(F.transform(names, lambda n: text.normalize_org_name(n))))
    hits = rows.join(known_names(aliases), "key", "left_semi").groupBy("number").agg(
        F.array_sort(F.collect_set("key")).alias("keys"), *(F.min(c).alias(c) for c in ("name", "status", "category", "sic"))
    )
    return _identified(hits, "gb-coh", "companies")


def import_charities(register: DataFrame, aliases: DataFrame) -> DataFrame:
    """Charities (number, name, company_number) whose name is known, with their second identifier if any."""
    rows = register.withColumn("key", text.normalize_org_name("name"))
    hits = rows.join(known_names(aliases), "key", "left_semi").groupBy("number").agg(
        F.array_sort(F.collect_set("key")).alias("keys"), F.min("name").alias("name"), F.min("company_number").alias("company_number"))
    return _identified(hits, "gb-chc", "charities")


def _identified(rows: DataFrame, scheme: str, registry: str) -> DataFrame:
    return rows.withColumns({
        "record_id": hashed(F.lit(registry), "number"), "entity_id": hashed(F.lit("registry"), F.lit(scheme), "number"), "scheme": F.lit(scheme),
    })


def register_identifiers(records: DataFrame, second: str | None = None) -> DataFrame:
    """(entity_id, scheme, identifier) of imported records; ``second`` is a column of gb-coh numbers."""
    one = records.select("entity_id", "scheme", F.col("number").alias("identifier"))
    if second is None:
        return one
    return one.unionByName(records.filter(F.coalesce(second, F.lit("")) != "").select("entity_id", F.lit("gb-coh").alias("scheme"), F.upper(second).alias("identifier")))


def import_other_names(names: DataFrame, records: DataFrame) -> DataFrame:
    """(entity_id, alias_text, normalized_alias) of other names (number, name) of imported records."""
    key = text.normalize_org_name("name")
    return names.join(records.select("number", "entity_id"), "number").filter(key != "").select("entity_id", F.col("name").alias("alias_text"), key.alias("normalized_alias")).distinct()


def read_control_persons(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of controllers; bad lines are skipped and only the named fields are read."""
    raw = spark.read.schema(CONTROL_SCHEMA).json(path, mode="DROPMALFORMED")
    return raw.select("company_number", "data.kind", "data.name", "data.natures_of_control")


def import_control_persons(control: DataFrame, records: DataFrame) -> DataFrame:
    """PSC_OF_COMPANY edges (company_number, kind, name, natures_of_control) of imported companies."""
    kind = F.when(F.contains("kind", F.lit("individual")), "PERSON").when(F.contains("kind", F.lit("corporate")) | F.contains("kind", F.lit("legal")), "ORGANISATION")
    rows = control.withColumns({"number": F.upper(F.trim("company_number")), "entity_type": kind}).filter("entity_type IS NOT NULL AND name IS NOT NULL")
    edges = rows.join(records.select("number", F.col("entity_id").alias("object_id")), "number")
    edges = edges.withColumn("subject_id", hashed("entity_type", F.concat(F.lit("psc:"), "number"), text.normalize_name("name")))
    return edges.select(
        hashed(F.lit("companies"), "subject_id", F.lit("PSC_OF_COMPANY"), "object_id").alias("relationship_id"), "subject_id", "object_id",
        F.lit("PSC_OF_COMPANY").alias("predicate"), "entity_type", "name", "natures_of_control",
    )


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _companies(v) -> DataFrame:
    reg = v("companies").withColumn("previous_names", F.array_compact(F.array("previous_name")))
    return import_companies(reg, canonical_aliases(standardise_names(v("entities"))))


def _charities(v) -> DataFrame:
    reg = v("companies").select(F.concat(F.lit("9"), "number").alias("number"), "name", F.expr("CASE WHEN status = 'Active' THEN number END").alias("company_number"))
    return import_charities(reg, canonical_aliases(standardise_names(v("entities"))))


def f5_read_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies written as a delimited file with other headers and surplus columns, and read again."""
    folder = shared_dir(spark)
    view(spark, sf_dir, "companies").select(
        F.col("number").alias("Company Number"), F.col("name").alias(" companyNAME"), F.lit("1 High St").alias("Reg. Address"), F.col("status").alias("Company_Status"),
    ).write.csv(folder, header=True, sep="|")
    return read_register(spark, folder, {"number": "CompanyNumber", "name": "CompanyName", "status": "CompanyStatus", "sic": "SICCode"}, "|")


def f4_read_control_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controllers written as JSON lines with fields that are not read and lines that cannot be, and read again."""
    folder = shared_dir(spark)
    c = view(spark, sf_dir, "controllers")
    data = F.struct("kind", "name", F.array("nature").alias("natures_of_control"), F.lit("1970").alias("date_of_birth"))
    lines = c.select(F.to_json(F.struct("company_number", data.alias("data"))).alias("value"))
    lines.unionByName(c.select(F.concat(F.lit('{"company_number": "'), "company_number").alias("value"))).write.text(folder)
    return read_control_persons(spark, folder).select("company_number", "kind", "name", F.array_join("natures_of_control", "|").alias("natures"))


QUERIES = {
    "f4_read_control_persons": f4_read_control_persons,
    "f5_read_register": f5_read_register,
    "f1_import_companies": _q(lambda v: _companies(v).withColumn("keys", F.array_join("keys", "|"))),
    "f2_import_charities": _q(lambda v: register_identifiers(_charities(v), "company_number")),
    "f3_import_other_names": _q(lambda v: import_other_names(v("companies").filter("previous_name IS NOT NULL").select("number", F.col("previous_name").alias("name")), _companies(v))),
    "f4_import_control_persons": _q(lambda v: import_control_persons(v("controllers").withColumn("natures_of_control", F.array("nature")), _companies(v)).drop("natures_of_control")),
}
_C = _N.rstrip() + f""", kn AS (SELECT DISTINCT normalized_alias AS key FROM al WHERE length(normalized_alias) >= 5),
 cn AS (SELECT *, {text.sql_normalize_org('name')} AS key FROM {{companies}} UNION ALL SELECT *, {text.sql_normalize_org('previous_name')} FROM {{companies}} WHERE previous_name IS NOT NULL),
 co AS (SELECT number, array_to_string(list_sort(list(DISTINCT key)), '|') AS keys, min(name) AS name, min(status) AS status, min(category) AS category, min(sic) AS sic FROM cn
   WHERE key IN (SELECT key FROM kn) GROUP BY 1),
 c AS (SELECT *, {sql_hashed("'companies'", 'number')} AS record_id, {sql_hashed("'registry'", "'gb-coh'", 'number')} AS entity_id, 'gb-coh' AS scheme FROM co)
"""
ORACLE = {k: with_views(q) for k, q in {
    "f4_read_control_persons": "SELECT company_number, kind, name, nature AS natures FROM {controllers}",
    "f5_read_register": "SELECT trim(number) AS number, trim(name) AS name, trim(status) AS status, NULL AS sic FROM {companies}",
    "f1_import_companies": _C + "SELECT * FROM c",
    "f2_import_charities": _C + f""", h AS (SELECT DISTINCT '9' || number AS number, CASE WHEN status = 'Active' THEN number END AS company_number FROM cn
        WHERE key IN (SELECT key FROM kn) AND key = {text.sql_normalize_org('name')}),
      i AS (SELECT *, {sql_hashed("'registry'", "'gb-chc'", 'number')} AS entity_id FROM h)
      SELECT entity_id, 'gb-chc' AS scheme, number AS identifier FROM i UNION ALL SELECT entity_id, 'gb-coh', company_number FROM i WHERE company_number IS NOT NULL""",
    "f3_import_other_names": _C + f"SELECT DISTINCT c.entity_id, p.previous_name AS alias_text, {text.sql_normalize_org('p.previous_name')} AS normalized_alias FROM c JOIN {{companies}} p USING (number) WHERE p.previous_name IS NOT NULL",
    "f4_import_control_persons": _C + f""", x AS (SELECT c.entity_id AS object_id, p.name, CASE WHEN contains(kind, 'individual') THEN 'PERSON' ELSE 'ORGANISATION' END AS entity_type, number
        FROM {{controllers}} p JOIN c ON c.number = p.company_number WHERE kind <> 'super-secure'),
      y AS (SELECT *, {sql_hashed('entity_type', "'psc:' || number", 'lower(name)')} AS subject_id FROM x)
      SELECT {sql_hashed("'companies'", 'subject_id', "'PSC_OF_COMPANY'", 'object_id')} AS relationship_id, subject_id, object_id, 'PSC_OF_COMPANY' AS predicate, entity_type, name FROM y""",
}.items()}

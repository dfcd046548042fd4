"""Extraction: landed tables, releases, pages and feeds to facts.

Files are read by Spark; the work here is mapping columns, exploding and joining.  Row numbers
come from the data.  Contact fields, addresses and redacted answers are never selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.functions import text
from evidentia.functions.ids import hashed, sql_hashed
from evidentia.sources.pages import html_blocks
from evidentia.sources.staging import view, with_views

from .facts import first_rule

# Header aliases and terms that select files, columns and suppliers.
PAYMENT_HEADERS = {
    "supplier": (
        "supplier", "suppliername", "suppliervendorname", "vendor", "vendorname", "payee", "payee name", "creditor",
        "creditorname", "supplier/payee", "supplier/payee name", "supplier or payee", "supplier or payee name",
    ),
    "amount": (
        "amount", "transactionamount", "netamount", "paymentamount", "value", "amountexcludingvat", "amountgbp",
        "grossamount", "invoiceamount", "net value", "gross value",
    ),
    "date": (
        "date", "paymentdate", "transactiondate", "invoicedate", "paiddate", "payment date", "transaction date", "invoice date",
    ),
    "description": (
        "description", "transactiondescription", "narrative", "purpose", "expensetype", "expendituretype", "transaction description",
    ),
    "department": (
        "department", "directorate", "service", "servicearea", "costcentre", "costcenter", "costcentrename", "service area", "cost centre",
    ),
    "reference": (
        "transactionnumber", "transactionid", "documentnumber", "reference", "invoicenumber", "paymentreference",
        "transaction number", "invoice number",
    ),
}
CONTRACT_HEADERS = {
    "reference": ("contract reference", "contract ref", "contract reference number", "reference", "reference no", "number", "contract number"),
    "title": ("contract name", "contract title", "title", "short description"),
    "description": ("description", "contract description", "scope", "scope of contract"),
    "supplier": ("supplier", "supplier name", "vendor", "awarded supplier", "contractor", "current supplier", "current supplier s", "current supplier(s)"),
    "company_number": ("company number", "company no", "company reg number", "company registration number", "companies house number"),
    "method": ("procurement method", "procurement route", "process used", "procurement regime"),
    "start": ("start date", "contract start date", "starts", "commencement date"),
    "end": ("end date", "contract end date", "ends", "expiry date"),
    "review": ("contract review date", "review date", "renewal extension end date", "renewal/extension end date"),
    "value_ex_vat": (
        "contract value ex vat", "contract value excluding vat", "contract value (ex vat)", "total contract value ex vat",
        "total contract value (ex vat)", "awarded value ex vat",
    ),
    "value_inc_vat": (
        "contract value incl vat", "contract value including vat", "contract value (incl vat)", "total contract value incl vat",
        "total contract value (incl vat)",
    ),
}
ALLOW_TERMS = ("trade supplier", "trade-supplier", "spending over", "spend over", "payments over", "expenditure over", "supplier payments")
DENY_TERMS = ("private home", "private-home", "support related", "support-related", "supported individual", "supported individuals", "personal payment")
GENERIC_SUPPLIERS = ("various", "multiple award", "multiple suppliers", "framework suppliers", "n a", "na", "not applicable")
REDACTION = "[REDACTED_FROM_STRUCTURED_DATA]"
# Patterns of meeting pages.
GENERIC_TITLE = r"(?i)^(Agenda and (?:draft )?minutes|Agenda)$"
AGENDA_NUMBER = r"(?i)^[A-Z0-9][A-Z0-9./-]{0,19}\.?$"
DECLARATION_ITEM = r"(?i)\b(?:declaration|disclosure)s?\b.*\binterest"
NO_DECLARATION = r"(?i)\bno declarations? (?:of interest )?(?:were|was)? ?(?:received|made)?\b"
PERSON_DECLARED = r"\bCouncillor\s+(?:(?:Dr|Mr|Mrs|Ms|Miss)\s+)?([A-Z][A-Za-z'’.-]+(?:\s+[A-Z][A-Za-z'’.-]+){0,3})\s+declared\b"
DECISION = r"(?i)\b(?:RESOLVED|DECIDED|AGREED|RECOMMENDED)\b"
VOTE = r"(?i)\b(?:for|against|abstain(?:ed|tion|tions)?)\b"
VOTE_WORD = r"(?i)\b(?:vote|voting|for:|against:)\b"

PARTY = "struct<id:string,name:string,roles:array<string>,identifier:struct<scheme:string,id:string>,additionalIdentifiers:array<struct<scheme:string,id:string>>>"
PERIOD = "struct<startDate:string,endDate:string>"
RELEASE_SCHEMA = (
    f"struct<ocid:string,id:string,date:string,buyer:struct<name:string,identifier:struct<scheme:string,id:string>>,parties:array<{PARTY}>,"
    f"tender:struct<title:string,contractPeriod:{PERIOD}>,awards:array<struct<id:string,title:string,date:string,suppliers:array<struct<id:string,name:string>>,"
    f"value:struct<amount:decimal(18,2),currency:string>,contractPeriod:{PERIOD}>>>"
)


def _bare(header: str) -> str:
    return "".join(ch for ch in header.lower() if ch.isalnum())


def map_headers(df: DataFrame, aliases: dict[str, tuple], keep: tuple = ()) -> DataFrame:
    """Text columns by alias (the first header that fits), the ``keep`` columns, and no rows that are all empty."""
    wanted = {k: {_bare(a) for a in v} for k, v in aliases.items()}
    out = {}
    for name, names in wanted.items():
        found = next((c for c in df.columns if c not in keep and _bare(c) in names), None)
        out[name] = F.trim(F.col(f"`{found}`").cast("string")) if found else F.lit(None).cast("string")
    rows = df.select(*keep, *(c.alias(n) for n, c in out.items()))
    return rows.filter(F.coalesce(*(F.nullif(n, F.lit("")) for n in out)).isNotNull())


def select_payment_files(files: DataFrame, deny: tuple = DENY_TERMS, allow: tuple = ALLOW_TERMS) -> DataFrame:
    """Files (file_text, headers array, by_header boolean) that are supplier payments.

    A denied term always wins; a named file needs a supplier and an amount header; other files
    count by their headers only where their source opts in.
    """
    x = F.lower("file_text")
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t))
    bare = F.transform("headers", lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))
    header = lambda k: F.arrays_overlap(bare, F.array(*(F.lit(_bare(a)) for a in PAYMENT_HEADERS[k])))
    return files.filter(~has(deny) & header("supplier") & header("amount") & (has(allow) | F.col("by_header")))


def assign_payer(docs: DataFrame, rules: DataFrame, default_org: str | None) -> DataFrame:
    """Adds payer_org: the first rule whose term is in the text, else the default, else the document's first organisation."""
    found = first_rule(docs, rules, "doc_text")
    return docs.join(found, "document_id", "left").withColumn(
        "payer_org", F.coalesce("organisation_id", F.lit(default_org).cast("string"), F.get("organisation_ids", F.lit(0)))
    ).drop("organisation_id")


def extract_payments(rows: DataFrame, source_id: str) -> DataFrame:
    """One PAYMENT fact a row with a supplier and an amount; columns as ``map_headers`` gives, with row_number and payer_org."""
    full = rows.withColumns({"name": text.without_channel("supplier"), "value": text.money("amount")}).filter("name <> '' AND value IS NOT NULL")
    supplier = hashed(F.lit("SUPPLIER"), F.lit(f"supplier:{source_id}"), text.normalize_name("name"))
    return full.select(
        F.lit("PAYMENT").alias("fact_type"), F.lit("PAYMENT_TO_SUPPLIER").alias("predicate"), F.col("payer_org").alias("subject_id"), supplier.alias("object_id"),
        F.col("name").alias("supplier_name"), F.col("value").alias("amount"), F.concat(F.lit("CSV row "), "row_number").alias("locator"),
        text.iso_or_raw("date").alias("payment_date"), "description", "department", "reference", text.payment_channel("supplier").alias("channel"),
    )


def supplier_list(cell) -> Column:
    """Array of (name, key) of a cell: split at new lines and semicolons, generic names dropped, first of each key kept."""

    def kept(all_: Column) -> Column:
        real = F.filter(all_, lambda p: (p["key"] != "") & ~p["key"].isin(*GENERIC_SUPPLIERS))
        return text.let(real, lambda r: text.let(F.transform(r, lambda p: p["key"]), lambda keys: F.filter(
            r, lambda p, i: F.array_position(keys, p["key"]) == i + 1)))

    each = F.transform(F.split(cell, r"[\n;]"), lambda one: text.let(
        text.without_channel(one), lambda name: F.struct(name.alias("name"), text.basic_org_key(name).alias("key"))))
    return text.let(each, kept)


def split_suppliers(df: DataFrame, alias_map: DataFrame | None = None) -> DataFrame:
    """One row for each supplier of a cell: split at new lines and semicolons, aliased, generic names dropped, first of each key kept."""
    if alias_map is None:
        rows = df.select("*", F.posexplode(supplier_list("supplier")).alias("place", "one"))
        return rows.select(*df.columns, "place", F.col("one.name").alias("supplier_name"), F.col("one.key").alias("supplier_key"))
    cut = df.withColumn("_all", F.split("supplier", r"[\n;]"))
    rows = cut.select("*", F.posexplode("_all").alias("place", "one")).drop("_all")
    rows = rows.withColumn("supplier_name", text.without_channel("one"))
    a = alias_map.select(text.basic_org_key("alias").alias("_k"), F.col("canonical").alias("_c"))
    rows = rows.withColumn("_k", text.basic_org_key("supplier_name")).join(a, "_k", "left").withColumn("supplier_name", F.coalesce("_c", "supplier_name")).drop("_k", "_c")
    rows = rows.withColumn("supplier_key", text.basic_org_key("supplier_name")).filter((F.col("supplier_key") != "") & ~F.col("supplier_key").isin(*GENERIC_SUPPLIERS))
    first = Window.partitionBy("row_id", "supplier_key").orderBy("place")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "one")


def extract_contract_register(rows: DataFrame, source_id: str, buyer_id: str) -> DataFrame:
    """Facts of a register (columns as ``map_headers`` gives, with row_id): wide to long, suppliers split.

    A row needs a title, a supplier and a start or an end.  The value without VAT comes before
    the one with it; a company number counts only for a single supplier.
    """
    is_row = F.coalesce(F.col("title"), F.lit("")) != ""
    dated = (F.coalesce("start", F.lit("")) != "") | (F.coalesce("end", F.lit("")) != "")
    rows = rows.filter(is_row & (F.coalesce("supplier", F.lit("")) != "") & dated)
    key = F.when(F.coalesce("reference", F.lit("")) != "", F.col("reference")).otherwise(hashed("title", "supplier", "start", "end"))
    rows = rows.withColumn("contract_id", hashed(F.lit("CONTRACT"), F.lit(f"contract:{source_id}"), key))
    none = F.lit(None).cast("string")

    def fact(t: str, p: str, x, subject=F.col("contract_id"), object_=none) -> Column:
        return F.struct(
            F.lit(t).alias("fact_type"), F.lit(p).alias("predicate"), subject.cast("string").alias("subject_id"),
            object_.cast("string").alias("object_id"), x.cast("string").alias("value_text"))

    supplier = lambda name: hashed(F.lit("SUPPLIER"), F.lit(f"supplier:{source_id}"), text.normalize_name(name))
    own = F.filter(F.array(
        fact("CONTRACT_TITLE", "HAS_TITLE", F.col("title")), fact("CONTRACT_DESCRIPTION", "HAS_DESCRIPTION", F.col("description")),
        fact("CONTRACT_VALUE", "HAS_VALUE", F.coalesce(text.money("value_ex_vat"), text.money("value_inc_vat"))),
        fact("CONTRACT_START", "STARTS_ON", text.iso_or_raw("start")), fact("CONTRACT_END", "ENDS_ON", text.iso_or_raw("end")),
        fact("CONTRACT_REVIEW", "REVIEW_ON", text.iso_or_raw("review")), fact("CONTRACT_METHOD", "PROCURED_BY", F.col("method")),
    ), lambda f: f["value_text"] != "")
    number = F.upper(F.regexp_replace("company_number", r"\s+", ""))

    def linked(found: Column) -> Column:
        links = F.transform(found, lambda p: fact("CONTRACT_SUPPLIER", "SUPPLIER_TO_CONTRACT", p["name"], supplier(p["name"]), F.col("contract_id")))
        numbered = F.transform(found, lambda p: fact("IDENTIFIER", "HAS_IDENTIFIER", F.concat(F.lit("gb-coh:"), number), supplier(p["name"])))
        single = (F.size(found) == 1) & (F.coalesce("company_number", F.lit("")) != "")
        return F.concat(links, F.when(single, numbered).otherwise(F.slice(numbered, 1, 0)))

    buyer = F.array(fact("CONTRACT_BUYER", "BUYER_OF_CONTRACT", none, F.lit(buyer_id), F.col("contract_id")))
    each = F.concat(own, text.let(supplier_list("supplier"), linked), buyer)
    return rows.select("row_id", F.explode(each).alias("f")).select("row_id", "f.subject_id", "f.object_id", "f.fact_type", "f.predicate", "f.value_text")


def parse_releases(df: DataFrame, column: str = "json") -> DataFrame:
    """Adds r, the release of a JSON text; text that cannot be read gives null."""
    # the explode keeps the planner from reading the text once for each field and filter
    return df.select("*", F.explode(F.array(F.from_json(column, RELEASE_SCHEMA))).alias("r"))


def filter_buyers(releases: DataFrame, terms: list[str]) -> DataFrame:
    """Releases with a buyer's or buying party's name that contains a term; all, without terms."""
    if not terms:
        return releases
    buyers = F.filter("r.parties", lambda p: F.array_contains(p["roles"], "buyer"))
    names = F.concat(F.array("r.buyer.name"), F.transform(F.coalesce(buyers, F.array().cast(f"array<{PARTY}>")), lambda p: p["name"]))
    return releases.filter(F.exists(F.array_compact(names), lambda n: F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(F.lower(n), t))))


def extract_ocds(releases: DataFrame) -> DataFrame:
    """(ocid, award_id, predicate, party, value_text, currency): titles, buyers, suppliers, values and dates of
    awards, and the identifiers (scheme:id) of the parties and buyers that they name.

    A release without awards has one, named notice.
    """
    award = StructType.fromDDL(f"r {RELEASE_SCHEMA}")["r"].dataType["awards"].dataType.elementType
    notice = F.array(F.struct(*[(F.lit("notice") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in award]))
    awards = F.when(F.coalesce(F.size("r.awards"), F.lit(0)) > 0, F.col("r.awards")).otherwise(notice)
    ids = "array<struct<scheme:string,id:string>>"
    given = lambda name, main, more: F.transform(
        F.filter(F.concat(F.array(main), F.coalesce(more, F.array().cast(ids))), lambda i: F.coalesce(i["id"], F.lit("")) != ""),
        lambda i: F.struct(name.alias("name"), F.concat(F.coalesce(i["scheme"], F.lit("unknown")), F.lit(":"), i["id"]).alias("value")))
    parties = F.transform(F.coalesce("r.parties", F.array().cast(f"array<{PARTY}>")), lambda p: given(p["name"], p["identifier"], p["additionalIdentifiers"]))
    identified = F.array_distinct(F.concat(F.flatten(parties), given(F.col("r.buyer.name"), F.col("r.buyer.identifier"), F.array().cast(ids))))
    # identifiers are those of the release: worked out before its awards are exploded
    rows = releases.filter("r IS NOT NULL").select("r", identified.alias("identified"), awards.alias("awards"))
    rows = rows.select("r.ocid", "r.buyer", "r.parties", F.col("r.tender.title").alias("tender_title"), "identified", F.explode_outer("awards").alias("a"))
    by_role = lambda role: F.transform(F.filter(F.coalesce("parties", F.array().cast(f"array<{PARTY}>")), lambda p: F.array_contains(p["roles"], role)), lambda p: p["name"])
    has_buyer = F.array_compact(F.array_union(by_role("buyer"), F.array("buyer.name")))
    own = F.transform(F.coalesce("a.suppliers", F.array().cast("array<struct<id:string,name:string>>")), lambda s: s["name"])
    suppliers = F.when(F.size(own) > 0, own).otherwise(F.when(F.col("a.id") == "notice", F.array().cast("array<string>")).otherwise(by_role("supplier")))
    fact = lambda p, party, x, cur=None: F.struct(F.lit(p).alias("predicate"), party.cast("string").alias("party"), x.cast("string").alias("value_text"), (cur if cur is not None else F.lit(None)).cast("string").alias("currency"))
    none = F.lit(None)
    each = F.concat(
        F.array(fact("HAS_TITLE", none, F.coalesce("a.title", "tender_title")), fact("HAS_VALUE", none, F.col("a.value.amount"), F.coalesce("a.value.currency", F.lit("GBP"))), fact("AWARDED_ON", none, F.substring("a.date", 1, 10))),
        F.transform(has_buyer, lambda n: fact("BUYER_OF_CONTRACT", n, n)), F.transform(F.array_distinct(F.array_compact(suppliers)), lambda n: fact("SUPPLIER_TO_CONTRACT", n, n)),
        text.let(F.array_distinct(F.array_compact(F.concat(has_buyer, suppliers))), lambda named: F.transform(
            F.filter("identified", lambda i: F.array_contains(named, i["name"])), lambda i: fact("HAS_IDENTIFIER", i["name"], i["value"]))),
    )
    # never empty; for explode the planner would work it all out once more in a filter on its size
    return rows.select("ocid", F.col("a.id").alias("award_id"), F.explode_outer(each).alias("f")).select("ocid", "award_id", "f.*").filter("value_text IS NOT NULL")


def extract_contract_periods(releases: DataFrame) -> DataFrame:
    """(ocid, award_id, predicate, value_text, period_source): an award's period, else the tender's as a whole pair."""
    rows = releases.filter("r IS NOT NULL").select("r.ocid", F.col("r.tender.contractPeriod").alias("t"), F.explode_outer("r.awards").alias("a"))
    own = F.col("a.contractPeriod.startDate").isNotNull() | F.col("a.contractPeriod.endDate").isNotNull()
    p = rows.select("ocid", F.coalesce("a.id", F.lit("notice")).alias("award_id"), F.when(own, F.col("a.contractPeriod")).otherwise(F.col("t")).alias("p"),
                    F.when(own, "award").otherwise("tender").alias("period_source"))
    pair = F.array(F.struct(F.lit("STARTS_ON").alias("predicate"), F.substring("p.startDate", 1, 10).alias("value_text")), F.struct(F.lit("ENDS_ON").alias("predicate"), F.substring("p.endDate", 1, 10).alias("value_text")))
    return p.select("ocid", "award_id", "period_source", F.explode(pair).alias("f")).select("ocid", "award_id", "f.*", "period_source").filter("value_text IS NOT NULL")


def unflatten_release_csv(df: DataFrame, row_id: str, terms: list[str] | None = None) -> DataFrame:
    """Columns releases/<i>/<field> to one row a release (release_no, id, buyer_name, date); the first row of each id."""
    cells = [c for c in df.columns if c.startswith("releases/")]
    long = df.select(row_id, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("x")) for c in cells))).alias("e"))
    long = long.select(row_id, F.regexp_extract("e.c", r"^releases/(\d+)/", 1).cast("int").alias("release_no"), F.regexp_extract("e.c", r"^releases/\d+/(.*)$", 1).alias("field"), "e.x")
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("x")))
    rows = long.groupBy(row_id, "release_no").agg(pick("id").alias("id"), pick("buyer/name").alias("buyer_name"), pick("date").alias("date")).filter("id IS NOT NULL")
    if terms:
        rows = rows.filter(F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(F.lower("buyer_name"), t)))
    first = Window.partitionBy("id").orderBy(row_id, "release_no")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _resolved(rows: DataFrame, include: str | None, same_host: bool) -> DataFrame:
    """(page_id, url, link) of rows with an href: resolved against the page, fragments dropped, each once."""
    rows = rows.withColumn("href", F.regexp_replace(F.trim("href"), "#.*$", "")).filter("href <> ''")
    scheme, root = F.regexp_extract("url", "^([a-zA-Z]+):", 1), F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "^([a-zA-Z]+://.*/|[a-zA-Z]+://[^/]*$)", 1)
    link = (
        F.when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(scheme, F.lit(":"), "href"))
        .when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), "href"))
    )
    rows = rows.select("page_id", "url", link.alias("link")).filter(F.col("link").rlike("^https?://"))
    if include:
        rows = rows.filter(F.col("link").rlike(include))
    if same_host:
        rows = rows.filter(F.lower(F.regexp_extract("link", "^[a-zA-Z]+://([^/?#]*)", 1)) == F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)))
    return rows.distinct()


def extract_links(pages: DataFrame, include: str | None = None, same_host: bool = False) -> DataFrame:
    """(page_id, url, link) edges of pages."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1))
    return _resolved(pages.select("page_id", "url", href.alias("href")), include, same_host)


def links_by_text(blocks: DataFrame, filter_text: str, include: str | None = None, same_host: bool = False) -> DataFrame:
    """(page_id, url, link) of anchors whose own text, or that of the block around them, has the filter text."""
    anchors = blocks.filter("tag = 'a' AND href IS NOT NULL").alias("a")
    around = blocks.select("page_id", "seq", "text").alias("b")
    both = anchors.join(around, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.parent") == F.col("b.seq")), "left")
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(filter_text.lower()))
    return _resolved(both.filter(has(F.col("a.text")) | has(F.col("b.text"))).select("a.page_id", "a.url", "a.href"), include, same_host)


def with_heading(blocks: DataFrame) -> DataFrame:
    """Adds heading and heading_seq: the last heading at or before each row of its page."""
    so_far = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("tag").rlike("^h[1-6]$")
    return blocks.withColumns({
        "heading": F.last(F.when(is_head, F.col("text")), ignorenulls=True).over(so_far),
        "heading_seq": F.last(F.when(is_head, F.col("seq")), ignorenulls=True).over(so_far),
    })


def extract_grants(blocks: DataFrame) -> DataFrame:
    """(page_id, seq, recipient, purpose, amount) of top-level list items under a heading of successful grants."""
    rows = with_heading(blocks).filter((F.col("tag") == "li") & (F.col("level") == 1) & F.contains(F.lower("heading"), F.lit("successful grants")))
    pattern = r"^(.*?)\s+[-–—]\s+(.*?)[:,]?\s*£\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
    part = lambda k: F.trim(F.regexp_extract("text", pattern, k))
    return rows.filter(F.col("text").rlike(pattern)).select("page_id", "seq", part(1).alias("recipient"), part(2).alias("purpose"), text.money(part(3)).alias("amount"))


PAGE_KINDS = {"mgcommitteedetails": "committee", "mguserinfo": "member", "mgdeclarationsubmission": "register", "mgrofi": "register", "ielistdocuments": "meeting", "celistdocuments": "meeting", "mgmeetingattendance": "attendance"}


def page_kind(url) -> Column:
    """committee, member, register, meeting or attendance by the page's path, else null."""
    leaf = F.lower(F.regexp_extract(url, r"/([A-Za-z]+)\.aspx", 1))
    return F.create_map(*[F.lit(x) for kv in PAGE_KINDS.items() for x in kv])[leaf]


def extract_council_pages(blocks: DataFrame) -> DataFrame:
    """(page_id, predicate, subject, object, value_text) of council pages, by the kind of page.

    Committees give members with roles; members their party, ward and committees; registers the
    answers to numbered questions, with question 4 (land) redacted; meetings their committee, venue,
    agenda items, minutes, declarations, decisions and votes; attendance lists those who are named.  E-mail addresses are dropped before anything else.
    """
    rows = with_heading(blocks).withColumn("kind", page_kind("url")).filter("kind IS NOT NULL AND text <> ''").filter(~F.contains("text", F.lit("@")))
    h1 = rows.filter("tag IN ('h1', 'h2')").groupBy("page_id").agg(F.min_by("text", F.struct(F.col("tag"), F.col("seq"))).alias("page_title"))
    rows = rows.join(h1, "page_id", "left")
    out = lambda df, p, s, o, x: df.select("page_id", F.lit(p).alias("predicate") if isinstance(p, str) else p.alias("predicate"), s.cast("string").alias("subject"), o.cast("string").alias("object"), x.cast("string").alias("value_text"))
    none = F.lit(None)
    members = rows.filter("kind = 'committee' AND tag = 'li'")
    role = F.nullif(F.regexp_extract("text", r"\(([^)]*)\)\s*$", 1), F.lit(""))
    person = text.clean_person_name(F.regexp_replace("text", r"\s*\([^)]*\)\s*$", ""))
    found = out(members, "MEMBER_OF", person, F.col("page_title"), role)
    label = lambda k: F.trim(F.regexp_extract("text", rf"(?i)^{k}:\s*(.*)$", 1))
    info = rows.filter("kind = 'member' AND tag = 'p'")
    who = text.clean_person_name("page_title")
    found = found.unionByName(out(info.filter(label("party") != ""), "MEMBER_OF_PARTY", who, label("party"), none))
    found = found.unionByName(out(info.filter(label("ward") != ""), "REPRESENTS_WARD", who, label("ward"), none))
    seats = rows.filter("kind = 'member' AND tag = 'li'")
    place = F.when(F.contains(F.lower("heading"), F.lit("outside")), "APPOINTED_TO_OUTSIDE_BODY").otherwise("MEMBER_OF")
    found = found.unionByName(out(seats, place, who, F.col("text"), none))
    question = F.regexp_extract("heading", r"^\s*(\d+)\.", 1)
    answers = rows.filter((F.col("kind") == "register") & (F.col("tag") == "td") & (question != ""))
    found = found.unionByName(out(answers, "DECLARED_INTEREST", who, question, F.when(question == "4", REDACTION).otherwise(F.col("text"))))
    found = found.unionByName(_meeting_facts(rows.filter("kind = 'meeting'"), out))
    attended = rows.filter("kind = 'attendance' AND tag = 'a'").filter(F.contains(F.lower("href"), F.lit("mguserinfo.aspx")) & (F.col("text") != ""))
    around = blocks.select("page_id", F.col("seq").alias("parent"), F.col("text").alias("context"))
    attended = attended.join(around, ["page_id", "parent"], "left")
    return found.unionByName(out(attended, "ATTENDANCE_RECORDED_FOR", text.clean_person_name("text"), F.col("page_title"), F.coalesce("context", "text")))


def _meeting_facts(rows: DataFrame, out) -> DataFrame:
    """Facts of meeting pages: committee, venue, agenda items, minutes, declarations, decisions and votes."""
    heads = rows.filter("tag IN ('h1', 'h2')")
    plain = F.when(~F.col("text").rlike(GENERIC_TITLE), F.struct("seq", "text"))
    title = heads.groupBy("page_id").agg(F.coalesce(F.min(plain), F.min(F.struct("seq", "text")))["text"].alias("title"))
    none = F.lit(None)
    found = out(title, "MEETING_OF", F.col("title"), F.trim(F.split("title", " - ")[0]), none)
    order = Window.partitionBy("page_id").orderBy("seq")
    beside = F.regexp_extract("text", r"(?i)^venue:?\s+(\S.*)$", 1)
    below = F.when(F.col("text").rlike("(?i)^venue:*$"), F.lead("text").over(order))
    venue = rows.filter("tag IN ('p', 'td', 'th', 'li', 'dt', 'dd')").withColumn("venue", F.coalesce(F.nullif(beside, F.lit("")), below)).filter("venue IS NOT NULL")
    venue = venue.groupBy("page_id").agg(F.min_by("venue", "seq").alias("venue")).join(title, "page_id")
    found = found.unionByName(out(venue, "VENUE", F.col("title"), none, F.col("venue")))
    cell = lambda n: F.min(F.when(F.col("cell") == n, F.struct("seq", "text")))["text"]
    items = rows.filter("tag = 'td'").groupBy("page_id", "tr").agg(cell(1).alias("number"), cell(2).alias("body"))
    items = items.filter(F.col("number").rlike(AGENDA_NUMBER) & F.col("body").isNotNull()).join(title, "page_id")
    at = F.regexp_instr("body", F.lit(r"(?i)\bMinutes:\s*"))
    items = items.withColumns({
        "item": F.trim(F.when(at > 0, F.substring("body", F.lit(1), at - 1)).otherwise(F.col("body"))),
        "minutes": F.when(at > 0, F.trim(F.regexp_replace(F.substring("body", at, F.length("body")), r"(?i)^Minutes:\s*", ""))),
    })
    name = F.concat("title", F.lit(" :: "), "number", F.lit(" "), F.substring("item", 1, 180))
    found = found.unionByName(out(items, "AGENDA_ITEM_OF", name, F.col("title"), F.col("item")))
    said = items.filter("minutes <> ''")
    found = found.unionByName(out(said, "MINUTES_TEXT", name, none, F.col("minutes")))
    declared = said.filter(F.col("item").rlike(DECLARATION_ITEM))
    nothing = declared.filter(F.col("minutes").rlike(NO_DECLARATION))
    found = found.unionByName(out(nothing, "DECLARATION_STATUS", F.col("title"), none, F.lit("No declarations recorded in the minutes")))
    person = declared.withColumn("person", F.explode(F.regexp_extract_all("minutes", F.lit(PERSON_DECLARED), 1)))
    found = found.unionByName(out(person, "DECLARED_INTEREST_AT", F.trim("person"), F.col("title"), F.col("minutes")))
    found = found.unionByName(out(said.filter(F.col("minutes").rlike(DECISION)), "DECISION_TEXT", name, none, F.col("minutes")))
    voted = said.filter(F.col("minutes").rlike(VOTE) & F.col("minutes").rlike(VOTE_WORD))
    return found.unionByName(out(voted, "VOTE_TEXT", name, none, F.col("minutes")))


FEED = (
    "STRUCT<committees: STRUCT<committee: ARRAY<STRUCT<committeeid: STRING, committeetitle: STRING, committeedeleted: STRING, committeeexpired: STRING, committeecategory: STRING>>>, "
    "wards: STRUCT<ward: ARRAY<STRUCT<wardtitle: STRING, councillors: STRUCT<councillor: ARRAY<STRUCT<councillorid: STRING, fullusername: STRING, politicalpartytitle: STRING, keyposts: STRING, "
    "termsofoffice: STRUCT<termofoffice: ARRAY<STRUCT<startdate: STRING, enddate: STRING>>>>>>>>>, "
    "parishcouncils: STRUCT<parishcouncil: ARRAY<STRUCT<parishcouncilid: STRING, parishcounciltitle: STRING>>>, "
    "events: STRUCT<event: ARRAY<STRUCT<meetingid: STRING, meetingtitle: STRING, meetingdate: STRING, committeetitle: STRING, venue: STRING>>>>"
)


def extract_council_feeds(feeds: DataFrame) -> DataFrame:
    """(feed_id, predicate, subject, object, value_text) of XML feeds (feed_id, xml): committees, councillors
    with ward, party, posts and terms of office, parish councils, and meetings.

    The schema has no contact fields, so they are not read.  Deleted and expired committees are
    left out; meetings are told apart by id, else by title, date and committee, and the first of
    each stays.  A meeting without a title is named after its committee and date.
    """
    rows = feeds.select("feed_id", F.from_xml("xml", FEED).alias("x"))
    none = F.lit(None).cast("string")
    out = lambda df, p, s, o, x: df.select("feed_id", F.lit(p).alias("predicate"), s.alias("subject"), o.alias("object"), x.alias("value_text"))
    c = rows.select("feed_id", F.explode("x.committees.committee").alias("c")).filter("lower(coalesce(c.committeedeleted, 'false')) <> 'true' AND lower(coalesce(c.committeeexpired, 'false')) <> 'true'")
    found = out(c, "COMMITTEE", F.col("c.committeeid"), none, F.col("c.committeetitle"))
    m = rows.select("feed_id", F.explode("x.wards.ward").alias("w")).select("feed_id", "w.wardtitle", F.explode("w.councillors.councillor").alias("m"))
    name = text.clean_person_name("m.fullusername")
    for p, o in (("REPRESENTS_WARD", F.col("wardtitle")), ("MEMBER_OF_PARTY", F.col("m.politicalpartytitle"))):
        found = found.unionByName(out(m, p, name, o, none).filter("coalesce(object, '') <> ''"))
    found = found.unionByName(out(m, "PUBLIC_ROLE_TEXT", name, none, F.col("m.keyposts")).filter("coalesce(value_text, '') <> ''"))
    terms = m.select("feed_id", name.alias("name"), F.explode("m.termsofoffice.termofoffice").alias("t")).filter("coalesce(t.startdate, '') <> '' OR coalesce(t.enddate, '') <> ''")
    day = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("unspecified"))
    found = found.unionByName(out(terms, "TERM_OF_OFFICE", F.col("name"), none, F.concat(day("t.startdate"), F.lit(" to "), day("t.enddate"))))
    parishes = rows.select("feed_id", F.explode("x.parishcouncils.parishcouncil").alias("p")).filter("coalesce(p.parishcounciltitle, '') <> ''")
    found = found.unionByName(out(parishes, "PARISH_COUNCIL_LISTED", F.col("p.parishcouncilid"), none, F.col("p.parishcounciltitle")))
    e = rows.select("feed_id", F.posexplode("x.events.event").alias("place", "e"))
    key = F.coalesce(F.nullif("e.meetingid", F.lit("")), F.concat_ws("|", "e.meetingtitle", "e.meetingdate", "e.committeetitle"))
    e = e.withColumn("key", key).groupBy("feed_id", "key").agg(F.min_by("e", "place").alias("e"))
    shown = F.coalesce(F.nullif("e.meetingtitle", F.lit("")), F.nullif(F.concat_ws(" - ", F.nullif("e.committeetitle", F.lit("")), F.nullif("e.meetingdate", F.lit(""))), F.lit("")))
    e = e.withColumn("shown", shown).filter("shown IS NOT NULL")
    of = F.coalesce("e.committeetitle", F.lit("")) != ""
    found = found.unionByName(out(e.filter(of), "MEETING_OF", F.col("shown"), F.col("e.committeetitle"), none))
    found = found.unionByName(out(e.filter(~of), "MEETING_LISTED", F.col("shown"), none, F.col("shown")))
    for p, x in (("MEETING_DATE", F.col("e.meetingdate")), ("VENUE", F.col("e.venue"))):
        found = found.unionByName(out(e, p, F.col("shown"), none, x).filter("coalesce(value_text, '') <> ''"))
    return found


def resolve_recorded_person(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """Adds person_id to mentions (host, name): two words and more name a person of their own; a surname
    alone stands for the only person of that host with it, if there is just one."""
    full = mentions.withColumn("key", text.normalize_name("name"))
    own = hashed(F.lit("PERSON"), "host", "key")
    last = people.select("host", F.col("entity_id"), F.element_at(F.split(text.normalize_name("person_name"), " "), -1).alias("key"))
    only = last.groupBy("host", "key").agg(F.count("*").alias("_n"), F.min("entity_id").alias("_one")).filter("_n = 1").drop("_n")
    return full.join(only, ["host", "key"], "left").withColumn("person_id", F.when(F.instr("key", " ") > 0, own).otherwise(F.col("_one"))).drop("_one", "key")


def redact(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Values of facts that a rule names (fact_type, question, reason) become a fixed marker, with the reason."""
    joined = df.join(rules, ["fact_type", "question"], "left")
    return joined.withColumn("value_text", F.when(F.col("reason").isNotNull(), REDACTION).otherwise(F.col("value_text")))


# Queries over the driver's tables -----------------------------------------------------------


def _q(f):
    return lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))


def _payment_csv(v) -> DataFrame:
    """A landed payments table: all text, with odd headers."""
    return v("lineitem").join(v("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_number"),
        F.concat("p_name", F.when(F.col("l_linenumber") == 1, " (CHAPS)").otherwise("")).alias("Supplier Name"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN concat('(£', format_number(l_extendedprice, 2), ')') ELSE concat(' £', format_number(l_extendedprice, 2)) END").alias("Net Amount"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("Payment Date"), F.col("l_linestatus").alias("Narrative"), F.lit("").alias("Unrelated"))


def _files(v) -> DataFrame:
    return v("part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('Spending over 500 ', p_name) WHEN 1 THEN concat('Private home spend over ', p_name) ELSE p_name END").alias("file_text"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN array('Vendor', 'Notes') ELSE array('Payee Name', 'Net Value') END").alias("headers"), F.expr("p_partkey % 5 = 0").alias("by_header"))


def _docs(v) -> DataFrame:
    return v("customer").select(F.col("c_custkey").alias("document_id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("doc_text"), F.array(F.concat(F.lit("o"), "c_nationkey")).alias("organisation_ids"))


def _rules(v) -> DataFrame:
    return v("region").select(F.col("r_regionkey").alias("rule_no"), F.concat(F.lit("org"), "r_regionkey").alias("organisation_id"), F.expr("CASE r_regionkey WHEN 0 THEN 'build' WHEN 1 THEN 'mach' WHEN 2 THEN '9' WHEN 3 THEN 'auto' ELSE 'zzz' END").alias("term"))


def _register(v) -> DataFrame:
    return v("orders").select(
        F.col("o_orderkey").alias("row_id"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('REF', o_orderkey) END").alias("Contract Ref"), F.concat(F.lit("Job "), "o_orderkey").alias("Contract Title"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('Firm ', o_custkey, ' Ltd; Firm ', o_custkey, ' LTD; Various') WHEN 1 THEN concat('Firm ', o_custkey) ELSE 'n/a' END").alias("Supplier"),
        F.expr("concat('0', o_custkey)").alias("Company Number"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Start Date"), F.lit("").alias("End Date"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN cast(o_totalprice as decimal(18,2)) END").cast("string").alias("Contract Value (ex VAT)"), F.expr("cast(cast(o_totalprice as decimal(18,2)) + 1 as string)").alias("Contract Value (incl VAT)"))


def _supplier_aliases(v) -> DataFrame:
    """Names that some firms go by: those of every second customer, in capitals, with or without their legal form."""
    rows = v("customer").select(F.expr("concat('FIRM ', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ' LTD' ELSE '' END)").alias("alias"), F.col("c_name").alias("canonical"), "c_custkey")
    return rows.withColumn("alias", F.when(F.col("c_custkey") % 2 == 0, F.col("alias")).otherwise(F.concat(F.lit("none "), F.col("alias")))).drop("c_custkey")


def _releases(v) -> DataFrame:
    """Releases of orders: every fifth without awards, periods on the award or on the tender."""
    s = F.struct
    period = s(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00").alias("startDate"), F.lit(None).cast("string").alias("endDate"))
    tender_period = s(F.lit("2020-01-01").alias("startDate"), F.lit("2021-01-01").alias("endDate"))
    award = s(F.lit("a1").alias("id"), F.lit(None).cast("string").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.array(s(F.lit("x").alias("id"), F.concat(F.lit("Firm "), "o_custkey").alias("name"))).alias("suppliers"),
              s(F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lit("GBP").alias("currency")).alias("value"), F.when(F.col("o_orderkey") % 2 == 0, period).alias("contractPeriod"))
    party = lambda name, role, main, *more: s(name.alias("name"), F.array(F.lit(role)).alias("roles"), main.alias("identifier"), F.array(*more).alias("additionalIdentifiers"))
    ident = lambda scheme, i: s(F.lit(scheme).alias("scheme"), i.cast("string").alias("id"))
    parties = F.array(
        party(F.concat(F.lit("Firm "), "o_custkey"), "supplier", ident("GB-COH", F.col("o_custkey")), ident("GB-VAT", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 7)), ident(None, F.lit("x9"))),
        party(F.lit("Someone else"), "tenderer", ident("GB-COH", F.lit("1"))))
    buyer = s(F.col("o_orderpriority").alias("name"), ident("GB-LAC", F.substring("o_orderpriority", 1, 1)).alias("identifier"))
    r = s(F.concat(F.lit("ocds-"), "o_orderkey").alias("ocid"), buyer.alias("buyer"), parties.alias("parties"), s(F.concat(F.lit("Tender "), "o_orderkey").alias("title"), tender_period.alias("contractPeriod")).alias("tender"),
          F.when(F.col("o_orderkey") % 5 != 0, F.array(award)).alias("awards"))
    return parse_releases(v("orders").select(F.to_json(r).alias("json")))


def _flat(v) -> DataFrame:
    return v("nation").select(F.col("n_nationkey").alias("row"), F.col("n_nationkey").alias("releases/0/id"), F.col("n_name").alias("releases/0/buyer/name"), F.lit("2024").alias("releases/0/date"),
        (F.col("n_nationkey") + 1).alias("releases/1/id"), F.lower("n_name").alias("releases/1/buyer/name"), F.lit("2025").alias("releases/1/date"))


def _made_pages(v, html: Column, url: Column | None = None) -> DataFrame:
    return v("customer").select(F.col("c_custkey").alias("page_id"), (url if url is not None else F.lit("https://x.example/")).alias("url"), html.alias("html"))


def _grant_pages(v) -> DataFrame:
    head = F.when(F.col("c_custkey") % 2 == 0, "Successful grants 2024").otherwise("Other news")
    return _made_pages(v, F.concat(F.lit("<h3>"), head, F.lit("</h3><ul><li>"), "c_name", F.lit(" - "), "c_mktsegment", F.lit(": £1,"), F.lpad(F.col("c_custkey") % 1000, 3, "0"), F.lit("<ul><li>inner - x: £5</li></ul></li></ul><h3>Next</h3><ul><li>a - b: £7</li></ul>")))


def _linked_pages(v) -> DataFrame:
    """Anchors with the text in themselves, around them or nowhere, to files of this and another host."""
    return _made_pages(v, F.concat(
        F.lit("<p>Spending of "), "c_name", F.lit(' <a href="a/'), "c_custkey", F.lit('.csv#x">here</a></p><p><a href="/b'), "c_custkey",
        F.lit('.csv">SPEND file</a></p><p><a href="c.csv">notes</a></p><p>spend <a href="https://y.example/d.csv">away</a> <a href="e.pdf">e</a></p>')))


def _council_pages(v) -> DataFrame:
    url = F.concat(F.lit("https://c.example/"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'mgCommitteeDetails' WHEN 1 THEN 'mgUserInfo' WHEN 2 THEN 'mgDeclarationSubmission' ELSE 'ieListDocuments' END"), F.lit(".aspx?ID="), "c_custkey")
    html = F.expr("""CASE c_custkey % 4
      WHEN 0 THEN concat('<h1>Audit ', c_nationkey, '</h1><ul><li>Councillor Mrs A ', c_mktsegment, ' (Chair)</li></ul><p>mail: a@b.example</p>')
      WHEN 1 THEN concat('<h1>Cllr B ', c_mktsegment, '</h1><p>Party: P', c_nationkey, '</p><p>Ward: W</p><p>Email: x@y.example</p><h2>Outside bodies</h2><ul><li>Body ', c_nationkey, '</li></ul>')
      WHEN 2 THEN concat('<h1>Cllr C</h1><h2>1. Employment</h2><table><tr><td>Works at ', c_mktsegment, '</td></tr></table><h2>4. Land</h2><table><tr><td>12 High St</td></tr></table>')
      ELSE concat('<h1>Meeting ', c_custkey, '</h1><table><tr><td>1.</td><td>Budget Minutes: RESOLVED that it pass</td></tr></table>') END""")
    return _made_pages(v, html, url)


def _meeting_pages(v) -> DataFrame:
    """Meetings with a venue, declarations and a vote, and attendance lists."""
    url = F.concat(F.lit("https://c.example/"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'ieListDocuments' ELSE 'mgMeetingAttendance' END"), F.lit(".aspx?ID="), "c_custkey")
    html = F.expr("""CASE WHEN c_custkey % 2 = 0 THEN concat('<h1>Agenda and minutes</h1><h2>Audit ', c_nationkey, ' - May</h2><p><b>Venue:</b> Hall ', c_mktsegment, '</p><table>',
      '<tr><td>1.</td><td>Declarations of interest Minutes: No declarations were received</td></tr>',
      '<tr><td>2</td><td>Disclosures of interests Minutes: Councillor Ms Ann Lee declared a thing and Councillor Bo declared too</td></tr>',
      '<tr><td>no number</td><td>Nothing</td></tr><tr><td>3</td><td>Budget ', c_custkey, ' minutes: on a vote for:12 it was agreed</td></tr><tr><td>4</td><td>Close</td></tr></table>')
      ELSE concat('<h1>Attendance ', c_custkey, '</h1><ul><li><a href="mgUserInfo.aspx?UID=3">Councillor Mr ', c_mktsegment, '</a> Present</li><li><a href="other.aspx">Guest</a></li></ul>') END""")
    return _made_pages(v, html, url)


def _event_feeds(v) -> DataFrame:
    """Feeds of events, parishes and terms of office."""
    return v("nation").select(F.col("n_nationkey").alias("feed_id"), F.expr("""concat('<feed><wards><ward><wardtitle>W</wardtitle><councillors><councillor><fullusername>Cllr ', n_name, '</fullusername><keyposts>Chair</keyposts>',
      '<termsofoffice><termofoffice><startdate>2020</startdate><enddate></enddate></termofoffice><termofoffice></termofoffice></termsofoffice></councillor></councillors></ward></wards>',
      '<parishcouncils><parishcouncil><parishcouncilid>', n_nationkey, '</parishcouncilid><parishcounciltitle>Parish ', n_name, '</parishcounciltitle></parishcouncil></parishcouncils>',
      '<events><event><meetingid>1</meetingid><meetingtitle>M ', n_name, '</meetingtitle><meetingdate>1 May</meetingdate><committeetitle>Audit</committeetitle><venue>Hall</venue></event>',
      '<event><meetingid>1</meetingid><meetingtitle>Again</meetingtitle></event><event><meetingdate>2 May</meetingdate></event></events></feed>')""").alias("xml"))


def _feeds(v) -> DataFrame:
    return v("nation").select(F.col("n_nationkey").alias("feed_id"), F.expr("""concat('<feed><committees><committee><committeeid>', n_nationkey, '</committeeid><committeetitle>T ', n_name, '</committeetitle><committeedeleted>',
      CASE WHEN n_nationkey % 3 = 0 THEN 'True' ELSE 'False' END, '</committeedeleted></committee></committees><wards><ward><wardtitle>W', n_regionkey, '</wardtitle><councillors><councillor><fullusername>Councillor ', n_name,
      '</fullusername><politicalpartytitle>P</politicalpartytitle><email>e@x.example</email></councillor></councillors></ward></wards></feed>')""").alias("xml"))


def _people(v) -> DataFrame:
    return v("customer").select(F.concat(F.lit("h"), F.col("c_nationkey")).alias("host"), F.concat(F.lit("E"), "c_custkey").alias("entity_id"), F.concat(F.lit("Ann "), F.regexp_replace("c_name", "#", "")).alias("person_name"))


def _heard(v) -> DataFrame:
    return v("orders").select("o_orderkey", F.concat(F.lit("h"), F.col("o_orderkey") % 25).alias("host"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN concat('Bob Q', o_orderkey % 9) ELSE concat('Customer', lpad(o_custkey, 9, '0')) END").alias("name"))


QUERIES = {
    "c1_map_headers": _q(lambda v: map_headers(_payment_csv(v), PAYMENT_HEADERS, ("row_number",))),
    "c2_select_payment_files": _q(lambda v: select_payment_files(_files(v)).select("p_partkey")),
    "c3_money_and_dates": _q(lambda v: _payment_csv(v).select("row_number", text.money("Net Amount").alias("amount"), text.day_first_date("Payment Date").alias("day"))),
    "c4_assign_payer": _q(lambda v: assign_payer(_docs(v), _rules(v), None).select("document_id", "payer_org")),
    "c5_extract_payments": _q(lambda v: extract_payments(map_headers(_payment_csv(v), PAYMENT_HEADERS, ("row_number",)).withColumn("payer_org", F.lit("o1")), "s1").select("locator", "supplier_name", "amount", "payment_date", "channel")),
    "c6_split_suppliers": _q(lambda v: split_suppliers(map_headers(_register(v), CONTRACT_HEADERS, ("row_id",))).select("row_id", "supplier_name", "supplier_key")),
    "c6_split_suppliers_aliased": _q(lambda v: split_suppliers(map_headers(_register(v), CONTRACT_HEADERS, ("row_id",)), _supplier_aliases(v)).select("row_id", "supplier_name", "supplier_key")),
    "c7_extract_contract_register": _q(lambda v: extract_contract_register(map_headers(_register(v), CONTRACT_HEADERS, ("row_id",)), "s1", "b1").select("row_id", "predicate", "value_text")),
    "c8_extract_ocds": _q(lambda v: extract_ocds(_releases(v))),
    "c9_extract_contract_periods": _q(lambda v: extract_contract_periods(_releases(v))),
    "c10_unflatten_release_csv": _q(lambda v: unflatten_release_csv(_flat(v), "row").select("id", "buyer_name", "date")),
    "c11_filter_buyers": _q(lambda v: filter_buyers(_releases(v), ["URGENT", "low"]).select("r.ocid")),
    "c12_extract_links": _q(lambda v: extract_links(v("pages"))),
    "c12_links_by_text": _q(lambda v: links_by_text(html_blocks(_linked_pages(v)), "Spend", r"\.csv$", True)),
    "c13_made_blocks": _q(lambda v: html_blocks(_grant_pages(v)).select("page_id", "seq", "tag", "level", "text", "parent")),
    "c17_meeting_pages": _q(lambda v: extract_council_pages(html_blocks(_meeting_pages(v)))),
    "c18_event_feeds": _q(lambda v: extract_council_feeds(_event_feeds(v))),
    "c13_html_blocks": _q(lambda v: html_blocks(v("pages"))),
    "c14_extract_grants": _q(lambda v: extract_grants(html_blocks(_grant_pages(v))).select("page_id", "recipient", "purpose", "amount")),
    "c17_extract_council_pages": _q(lambda v: extract_council_pages(html_blocks(_council_pages(v)))),
    "c18_extract_council_feeds": _q(lambda v: extract_council_feeds(_feeds(v))),
    "c19_resolve_recorded_person": _q(lambda v: resolve_recorded_person(_heard(v), _people(v)).select("o_orderkey", "person_id")),
    "c20_redact": _q(lambda v: redact(v("lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("fact_type"), F.col("l_linenumber").alias("question"), F.col("l_linestatus").alias("value_text")),
        v("region").filter("r_regionkey = 1").select(F.lit("R").alias("fact_type"), F.lit(4).alias("question"), F.lit("land").alias("reason")))),
}
_L = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_ONE = "SELECT o_orderkey AS row_id, 'Firm ' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN ' Ltd' ELSE '' END AS supplier_name FROM orders WHERE o_orderkey % 3 < 2"
ORACLE = {k: with_views(q) for k, q in {
    "c2_select_payment_files": "SELECT p_partkey FROM part WHERE p_partkey % 4 <> 1 AND p_partkey % 3 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 5 = 0)",
    "c3_money_and_dates": f"SELECT {_L} AS row_number, CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS day FROM lineitem",
    "c4_assign_payer": """SELECT c_custkey AS document_id, CASE WHEN contains(lower(c_mktsegment || ' ' || c_name), 'build') THEN 'org0' WHEN contains(lower(c_mktsegment || ' ' || c_name), 'mach') THEN 'org1' WHEN contains(c_name, '9') THEN 'org2'
      WHEN contains(lower(c_mktsegment || ' ' || c_name), 'auto') THEN 'org3' ELSE 'o' || c_nationkey END AS payer_org FROM customer""",
    "c5_extract_payments": f"""SELECT 'CSV row ' || {_L} AS locator, p_name AS supplier_name, CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
      strftime(l_shipdate, '%Y-%m-%d') AS payment_date, CASE WHEN l_linenumber = 1 THEN 'CHAPS' END AS channel FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "c6_split_suppliers": f"SELECT row_id, supplier_name, lower(supplier_name) AS supplier_key FROM ({_ONE})",
    "c6_split_suppliers_aliased": f"""WITH s AS (SELECT row_id, supplier_name, CAST(substring(split_part(supplier_name, ' Ltd', 1), 6) AS BIGINT) AS c FROM ({_ONE}))
      SELECT row_id, coalesce(c_name, supplier_name) AS supplier_name, lower(replace(coalesce(c_name, supplier_name), '#', ' ')) AS supplier_key FROM s
      LEFT JOIN customer ON c_custkey = c AND c % 2 = 0 AND supplier_name = CASE WHEN c % 4 = 0 THEN 'Firm ' || c || ' Ltd' ELSE 'Firm ' || c END""",
    "c7_extract_contract_register": f"""SELECT o_orderkey AS row_id, 'HAS_TITLE' AS predicate, 'Job ' || o_orderkey AS value_text FROM orders
      UNION ALL SELECT o_orderkey, 'HAS_VALUE', CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS VARCHAR) FROM orders
      UNION ALL SELECT o_orderkey, 'STARTS_ON', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT o_orderkey, 'BUYER_OF_CONTRACT', NULL FROM orders
      UNION ALL SELECT row_id, 'SUPPLIER_TO_CONTRACT', supplier_name FROM ({_ONE}) UNION ALL SELECT o_orderkey, 'HAS_IDENTIFIER', 'gb-coh:0' || o_custkey FROM orders WHERE o_orderkey % 3 < 2""",
    "c8_extract_ocds": """WITH a AS (SELECT *, 'ocds-' || o_orderkey AS ocid, CASE WHEN o_orderkey % 5 <> 0 THEN 'a1' ELSE 'notice' END AS award_id FROM orders)
      SELECT ocid, award_id, 'HAS_TITLE' AS predicate, NULL AS party, 'Tender ' || o_orderkey AS value_text, NULL AS currency FROM a UNION ALL SELECT ocid, award_id, 'BUYER_OF_CONTRACT', o_orderpriority, o_orderpriority, NULL FROM a
      UNION ALL SELECT ocid, award_id, 'SUPPLIER_TO_CONTRACT', 'Firm ' || o_custkey, 'Firm ' || o_custkey, NULL FROM a WHERE award_id = 'a1' UNION ALL SELECT ocid, award_id, 'HAS_VALUE', NULL, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'GBP' FROM a WHERE award_id = 'a1'
      UNION ALL SELECT ocid, award_id, 'AWARDED_ON', NULL, strftime(o_orderdate, '%Y-%m-%d'), NULL FROM a WHERE award_id = 'a1'
      UNION ALL SELECT ocid, award_id, 'HAS_IDENTIFIER', o_orderpriority, 'GB-LAC:' || substring(o_orderpriority, 1, 1), NULL FROM a
      UNION ALL SELECT ocid, award_id, 'HAS_IDENTIFIER', 'Firm ' || o_custkey, 'GB-COH:' || o_custkey, NULL FROM a WHERE award_id = 'a1'
      UNION ALL SELECT ocid, award_id, 'HAS_IDENTIFIER', 'Firm ' || o_custkey, 'GB-VAT:' || (o_custkey + 7), NULL FROM a WHERE award_id = 'a1' AND o_orderkey % 3 = 0
      UNION ALL SELECT ocid, award_id, 'HAS_IDENTIFIER', 'Firm ' || o_custkey, 'unknown:x9', NULL FROM a WHERE award_id = 'a1'""",
    "c9_extract_contract_periods": """WITH a AS (SELECT 'ocds-' || o_orderkey AS ocid, CASE WHEN o_orderkey % 5 <> 0 THEN 'a1' ELSE 'notice' END AS award_id, o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS own, o_orderdate FROM orders)
      SELECT ocid, award_id, 'STARTS_ON' AS predicate, CASE WHEN own THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2020-01-01' END AS value_text, CASE WHEN own THEN 'award' ELSE 'tender' END AS period_source FROM a
      UNION ALL SELECT ocid, award_id, 'ENDS_ON', '2021-01-01', 'tender' FROM a WHERE NOT own""",
    "c10_unflatten_release_csv": "SELECT n_nationkey::VARCHAR AS id, n_name AS buyer_name, '2024' AS date FROM nation WHERE n_nationkey = 0 UNION ALL SELECT (n_nationkey + 1)::VARCHAR, lower(n_name), '2025' FROM nation",
    "c11_filter_buyers": "SELECT 'ocds-' || o_orderkey AS ocid FROM orders WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'low')",
    "c12_extract_links": r"""WITH h AS (SELECT page_id, url, regexp_replace(trim(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1))), '#.*$', '') AS href FROM pages),
      p AS (SELECT *, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS folder FROM h WHERE href <> ''),
      l AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z]+):', 1) || ':' || href
        WHEN starts_with(href, '/') THEN root || href ELSE folder || href END AS link FROM p)
      SELECT DISTINCT page_id, url, link FROM l WHERE regexp_matches(link, '^https?://')""",
    "c14_extract_grants": "SELECT c_custkey AS page_id, c_name AS recipient, c_mktsegment AS purpose, CAST('1' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS DECIMAL(18,2)) AS amount FROM customer WHERE c_custkey % 2 = 0",
    "c17_extract_council_pages": """WITH c AS (SELECT c_custkey AS page_id, c_mktsegment AS m, c_nationkey AS n FROM customer)
      SELECT page_id, 'MEMBER_OF' AS predicate, 'A ' || m AS subject, 'Audit ' || n AS object, 'Chair' AS value_text FROM c WHERE page_id % 4 = 0
      UNION ALL SELECT page_id, 'MEMBER_OF_PARTY', 'B ' || m, 'P' || n, NULL FROM c WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 'REPRESENTS_WARD', 'B ' || m, 'W', NULL FROM c WHERE page_id % 4 = 1
      UNION ALL SELECT page_id, 'APPOINTED_TO_OUTSIDE_BODY', 'B ' || m, 'Body ' || n, NULL FROM c WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 'DECLARED_INTEREST', 'C', '1', 'Works at ' || m FROM c WHERE page_id % 4 = 2
      UNION ALL SELECT page_id, 'DECLARED_INTEREST', 'C', '4', '[REDACTED_FROM_STRUCTURED_DATA]' FROM c WHERE page_id % 4 = 2
      UNION ALL SELECT page_id, 'MEETING_OF', 'Meeting ' || page_id, 'Meeting ' || page_id, NULL FROM c WHERE page_id % 4 = 3
      UNION ALL SELECT page_id, 'AGENDA_ITEM_OF', 'Meeting ' || page_id || ' :: 1. Budget', 'Meeting ' || page_id, 'Budget' FROM c WHERE page_id % 4 = 3
      UNION ALL SELECT page_id, p, 'Meeting ' || page_id || ' :: 1. Budget', NULL, 'RESOLVED that it pass' FROM c, (VALUES ('MINUTES_TEXT'), ('DECISION_TEXT')) t(p) WHERE page_id % 4 = 3""",
    "c17_meeting_pages": """WITH c AS (SELECT c_custkey AS page_id, c_mktsegment AS m, 'Audit ' || c_nationkey || ' - May' AS t, 'Audit ' || c_nationkey AS a FROM customer),
      x AS (SELECT page_id, t, a, m, '1.' AS n, 'Declarations of interest' AS item, 'No declarations were received' AS mi FROM c UNION ALL SELECT page_id, t, a, m, '2', 'Disclosures of interests', 'Councillor Ms Ann Lee declared a thing and Councillor Bo declared too' FROM c
        UNION ALL SELECT page_id, t, a, m, '3', 'Budget ' || page_id, 'on a vote for:12 it was agreed' FROM c UNION ALL SELECT page_id, t, a, m, '4', 'Close', NULL FROM c)
      SELECT page_id, 'MEETING_OF' AS predicate, t AS subject, a AS object, NULL AS value_text FROM c WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'VENUE', t, NULL, 'Hall ' || m FROM c WHERE page_id % 2 = 0
      UNION ALL SELECT page_id, 'AGENDA_ITEM_OF', t || ' :: ' || n || ' ' || item, t, item FROM x WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'MINUTES_TEXT', t || ' :: ' || n || ' ' || item, NULL, mi FROM x WHERE page_id % 2 = 0 AND mi IS NOT NULL
      UNION ALL SELECT page_id, 'DECLARATION_STATUS', t, NULL, 'No declarations recorded in the minutes' FROM c WHERE page_id % 2 = 0
      UNION ALL SELECT page_id, 'DECLARED_INTEREST_AT', p, t, mi FROM x, (VALUES ('Ann Lee'), ('Bo')) v(p) WHERE page_id % 2 = 0 AND n = '2'
      UNION ALL SELECT page_id, p, t || ' :: ' || n || ' ' || item, NULL, mi FROM x, (VALUES ('DECISION_TEXT'), ('VOTE_TEXT')) v(p) WHERE page_id % 2 = 0 AND n = '3'
      UNION ALL SELECT page_id, 'ATTENDANCE_RECORDED_FOR', m, 'Attendance ' || page_id, 'Councillor Mr ' || m || ' Present' FROM c WHERE page_id % 2 = 1""",
    "c12_links_by_text": """SELECT c_custkey AS page_id, 'https://x.example/' AS url, 'https://x.example/' || p || c_custkey || '.csv' AS link FROM customer, (VALUES ('a/'), ('b')) t(p)""",
    "c13_made_blocks": """WITH c AS (SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN 'Successful grants 2024' ELSE 'Other news' END AS h, c_name || ' - ' || c_mktsegment || ': £1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || 'inner - x: £5' AS t FROM customer)
      SELECT page_id, 0 AS seq, 'h3' AS tag, 0 AS level, h AS text, -1 AS parent FROM c UNION ALL SELECT page_id, 1, 'li', 1, t, -1 FROM c UNION ALL SELECT page_id, 2, 'li', 2, 'inner - x: £5', 1 FROM c
      UNION ALL SELECT page_id, 3, 'h3', 0, 'Next', -1 FROM c UNION ALL SELECT page_id, 4, 'li', 1, 'a - b: £7', -1 FROM c""",
    "c18_event_feeds": """WITH f AS (SELECT n_nationkey AS feed_id, n_name FROM nation)
      SELECT feed_id, 'REPRESENTS_WARD' AS predicate, n_name AS subject, 'W' AS object, NULL AS value_text FROM f UNION ALL SELECT feed_id, 'PUBLIC_ROLE_TEXT', n_name, NULL, 'Chair' FROM f
      UNION ALL SELECT feed_id, 'TERM_OF_OFFICE', n_name, NULL, '2020 to unspecified' FROM f UNION ALL SELECT feed_id, 'PARISH_COUNCIL_LISTED', feed_id::VARCHAR, NULL, 'Parish ' || n_name FROM f
      UNION ALL SELECT feed_id, 'MEETING_OF', 'M ' || n_name, 'Audit', NULL FROM f UNION ALL SELECT feed_id, 'MEETING_LISTED', '2 May', NULL, '2 May' FROM f
      UNION ALL SELECT feed_id, 'MEETING_DATE', 'M ' || n_name, NULL, '1 May' FROM f UNION ALL SELECT feed_id, 'MEETING_DATE', '2 May', NULL, '2 May' FROM f UNION ALL SELECT feed_id, 'VENUE', 'M ' || n_name, NULL, 'Hall' FROM f""",
    "c18_extract_council_feeds": """SELECT n_nationkey AS feed_id, 'COMMITTEE' AS predicate, n_nationkey::VARCHAR AS subject, NULL AS object, 'T ' || n_name AS value_text FROM nation WHERE n_nationkey % 3 <> 0
      UNION ALL SELECT n_nationkey, 'REPRESENTS_WARD', n_name, 'W' || n_regionkey, NULL FROM nation UNION ALL SELECT n_nationkey, 'MEMBER_OF_PARTY', n_name, 'P', NULL FROM nation""",
    "c19_resolve_recorded_person": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN {sql_hashed("'PERSON'", "'h' || (o_orderkey % 25)", "'bob q' || (o_orderkey % 9)")}
      WHEN c_custkey IS NOT NULL THEN 'E' || c_custkey END AS person_id FROM orders LEFT JOIN customer ON c_nationkey = o_orderkey % 25 AND replace(c_name, '#', '') = 'Customer' || lpad(o_custkey::VARCHAR, 9, '0')""",
    "c20_redact": "SELECT l_orderkey, l_partkey, l_returnflag AS fact_type, l_linenumber AS question, CASE WHEN l_returnflag = 'R' AND l_linenumber = 4 THEN '[REDACTED_FROM_STRUCTURED_DATA]' ELSE l_linestatus END AS value_text, CASE WHEN l_returnflag = 'R' AND l_linenumber = 4 THEN 'land' END AS reason FROM lineitem",
}.items()}
ORACLE["c1_map_headers"] = f"""SELECT {_L} AS row_number, trim(p_name || CASE WHEN l_linenumber = 1 THEN ' (CHAPS)' ELSE '' END) AS supplier, CASE WHEN l_returnflag = 'R' THEN '(£' || format('{{:,.2f}}', l_extendedprice) || ')'
  ELSE '£' || format('{{:,.2f}}', l_extendedprice) END AS amount, strftime(l_shipdate, '%d/%m/%Y') AS date, l_linestatus AS description, NULL AS department, NULL AS reference FROM lineitem JOIN part ON p_partkey = l_partkey"""

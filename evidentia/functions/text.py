"""Names, money and dates as column expressions.

All stay on the JVM.  Spark has no NFKC or full case folding: ``lower`` with ss for the sharp s
is exact for ASCII and for precomposed Latin; ``nfkc_names`` treats other rows apart.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists that results depend on.
LEGAL_SUFFIXES = (
    "limited liability partnership", "charitable incorporated organisation", "community interest company",
    "public limited company", "company limited by guarantee", "limited", "ltd", "plc", "llp", "cic", "cio",
)
PLACEHOLDER_NAMES = (
    "99999", "unknown", "not known", "not applicable", "n a", "na", "miscellaneous", "various",
)
REVENUE_AUTHORITIES = (
    "hmrc", "hm revenue and customs", "hm revenue customs", "her majestys revenue and customs",
    "his majestys revenue and customs",
)
PUBLIC_AUTHORITY_SUFFIXES = (
    " council", " combined authority", " police and crime commissioner", " fire and rescue authority",
)
AUTHORITY_NAME_SUFFIXES = (
    " borough council", " district council", " county council", " city council", " town council",
    " parish council", " council",
)
KIN_TERMS = (
    "wife", "husband", "spouse", "civil partner", "partner", "son", "daughter", "brother", "sister",
    "mother", "father", "parent", "relative", "family",
)
ORG_TYPES = ("ORGANISATION", "COMPANY", "CHARITY", "SUPPLIER", "OUTSIDE_BODY", "COUNCIL")
TYPE_RANK = {"COUNCIL": 5, "COMPANY": 4, "CHARITY": 4, "ORGANISATION": 3, "SUPPLIER": 2, "OUTSIDE_BODY": 1}
PROCUREMENT_SOURCES = ("contracts finder", "find a tender", "ocds", "procurement")
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd MMM yyyy", "dd MMMM yyyy")

SUFFIX_PATTERN = "( (" + "|".join(LEGAL_SUFFIXES) + "))+$"
CHANNEL_PATTERN = r"(?i)\s*\((CHAPS|NCR)\)\s*$"
DATE_PATTERN = r"^(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, wherever the planner puts the expression."""
    return F.transform(F.array(value), body)[0]


def fold(c) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c) -> Column:
    """Case-folded, white space collapsed."""
    return fold(squeeze(c))


def word_key(c) -> Column:
    """Case-folded words of letters and digits, & read as and, apostrophes dropped."""
    x = F.regexp_replace(F.replace(fold(c), F.lit("&"), F.lit(" and ")), "[’'`]", "")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def normalize_org_name(c) -> Column:
    """Word key without a leading the and without legal suffixes (never to nothing)."""
    return F.regexp_replace(F.regexp_replace(word_key(c), "^the ", ""), SUFFIX_PATTERN, "")


def payment_channel(c) -> Column:
    found = F.upper(F.regexp_extract(_raw(c), CHANNEL_PATTERN, 1))
    return F.when((found != "") & ~_raw(c).rlike(DATE_PATTERN), found)


def _raw(c) -> Column:
    return squeeze(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))


def without_channel(c) -> Column:
    """Name without a trailing payment channel; text like a date gives nothing."""

    def clean(raw: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(raw, CHANNEL_PATTERN, ""), "[ –—-]+$", "")
        named = F.when(raw.rlike(CHANNEL_PATTERN), let(cut, lambda x: F.when(x != "", x).otherwise(raw))).otherwise(raw)
        return F.when(raw.rlike(DATE_PATTERN), "").otherwise(named)

    return let(_raw(c), clean)


def basic_org_key(c) -> Column:
    return word_key(without_channel(c))


def analysis_org_key(c) -> Column:
    return normalize_org_name(without_channel(c))


def is_plausible_org_name(c) -> Column:
    key = basic_org_key(c)
    return (key != "") & ~key.isin(*PLACEHOLDER_NAMES) & ~F.replace(key, F.lit(" "), F.lit("")).rlike("^[0-9]+$") & key.rlike("[a-z]")


def payee_class(c) -> Column:
    """Class of obviously non-commercial payees, else null."""
    raw, key = without_channel(c), basic_org_key(c)
    ends = key.rlike("(" + "|".join(PUBLIC_AUTHORITY_SUFFIXES) + ")$")
    return (
        F.when(raw.rlike(r"(?i)(^|\s)(T\s*\.\s*C\s*\.|P\s*\.\s*C\s*\.)\s*$"), "public_authority")
        .when((key == "") | F.replace(key, F.lit(" "), F.lit("")).rlike("^[0-9]+$") | key.isin(*PLACEHOLDER_NAMES), "placeholder_or_accounting_code")
        .when(key.isin(*REVENUE_AUTHORITIES) | key.startswith("hm revenue and customs "), "tax_or_revenue_authority")
        .when(ends, "public_authority")
    )


def raw_legal_suffix(c) -> Column:
    found = F.regexp_extract(word_key(c), " (" + "|".join(LEGAL_SUFFIXES) + ")$", 1)
    return F.when(found != "", found)


def within_one_edit(a, b) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def authority_alias(c) -> Column:
    return F.trim(F.regexp_replace(basic_org_key(c), "(" + "|".join(AUTHORITY_NAME_SUFFIXES) + ")$", ""))


def clean_person_name(c) -> Column:
    return squeeze(F.regexp_replace(squeeze(c), r"(?i)^(councillor|cllr)\s+((dr|mr|mrs|ms|miss)\s+)?", ""))


def dataset_date(url) -> Column:
    found = F.regexp_extract(url, r"20\d\d-\d\d-\d\d", 0)
    return F.when(found != "", found)


def kin_terms(c) -> Column:
    """Kin words that occur as whole words, sorted."""
    text = fold(c)
    return F.array_sort(F.filter(F.array(*map(F.lit, KIN_TERMS)), lambda t: F.regexp_like(text, F.concat(F.lit(r"\b"), t, F.lit(r"\b")))))


def money(c) -> Column:
    """Decimal with two places, rounded half-even; (x) is negative, pounds and commas are ignored."""
    x = F.regexp_replace(F.trim(c), r"[£,]", "")
    negative = x.startswith("(") & x.endswith(")")
    x = F.regexp_replace(F.regexp_replace(x, r"^\((.*)\)$", "$1"), r"\s+", "")
    value = F.bround(x.try_cast("decimal(30,6)"), 2)
    return F.when(negative, -value).otherwise(value).cast("decimal(18,2)")


def plain_decimal(c) -> Column:
    return F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("decimal(18,2)")


def day_first_date(c) -> Column:
    """Date by the known formats, day first.  The shape of the text tells which may fit, so none is tried in vain."""
    read = lambda x, f: F.try_to_timestamp(x, F.lit(f)).cast("date")
    year = r"\+?\d{4,}"

    def dated(x: Column) -> Column:
        out = F.when(x.rlike(rf"^{year}-\d\d-\d\d$"), read(x, DATE_FORMATS[0]))
        for mark, f in zip(("/", "-", r"\."), DATE_FORMATS[1:4]):
            out = out.when(x.rlike(rf"^\d\d{mark}\d\d{mark}{year}$"), read(x, f))
        return out.when(x.rlike(rf"^\d\d \S+ {year}$"), F.coalesce(*(read(x, f) for f in DATE_FORMATS[4:])))

    return let(F.trim(c), dated)


def iso_or_raw(c) -> Column:
    """ISO text of a date that can be read, else the text itself."""
    return F.coalesce(day_first_date(c).cast("string"), F.trim(c))


def nfkc_names(df: DataFrame, column: str) -> DataFrame:
    """NFKC and full case folding for the rows that are not ASCII; only those go through Python."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    ascii_only = F.coalesce(F.col(column).rlike(r"^[\x00-\x7F]*$"), F.lit(True))
    plain = df.filter(ascii_only).withColumn(column, F.lower(column))
    return plain.unionByName(df.filter(~ascii_only).withColumn(column, folded(column)))


# The same functions as DuckDB SQL, for the oracles.
def sql_word_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(replace(lower({x}), 'ß', 'ss'), '&', ' and '), '[’''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_without_channel(x: str) -> str:
    raw = sql_squeeze(f"coalesce({x}, '')")
    cut = rf"regexp_replace(regexp_replace({raw}, '{CHANNEL_PATTERN}', ''), '[ –—-]+$', '')"
    return (
        f"CASE WHEN regexp_matches({raw}, '{DATE_PATTERN}') THEN '' "
        f"WHEN regexp_matches({raw}, '{CHANNEL_PATTERN}') AND {cut} <> '' THEN {cut} ELSE {raw} END"
    )


def sql_channel(x: str) -> str:
    return f"nullif(upper(regexp_extract({sql_squeeze(x)}, '{CHANNEL_PATTERN}', 1)), '')"


def sql_normalize_org(x: str) -> str:
    return f"regexp_replace(regexp_replace({sql_word_key(x)}, '^the ', ''), '{SUFFIX_PATTERN}', '')"


def sql_basic_key(x: str) -> str:
    return sql_word_key(sql_without_channel(x))


def sql_plausible(x: str) -> str:
    k = sql_basic_key(x)
    names = ", ".join(f"'{n}'" for n in PLACEHOLDER_NAMES)
    return f"({k} <> '' AND {k} NOT IN ({names}) AND NOT regexp_matches(replace({k}, ' ', ''), '^[0-9]+$') AND regexp_matches({k}, '[a-z]'))"


def sql_payee_class(x: str) -> str:
    k = sql_basic_key(x)
    q = lambda v: ", ".join(f"'{n}'" for n in v)
    return rf"""CASE WHEN regexp_matches({sql_without_channel(x)}, '(?i)(^|\s)(T\s*\.\s*C\s*\.|P\s*\.\s*C\s*\.)\s*$') THEN 'public_authority'
      WHEN {k} = '' OR regexp_matches(replace({k}, ' ', ''), '^[0-9]+$') OR {k} IN ({q(PLACEHOLDER_NAMES)}) THEN 'placeholder_or_accounting_code'
      WHEN {k} IN ({q(REVENUE_AUTHORITIES)}) OR starts_with({k}, 'hm revenue and customs ') THEN 'tax_or_revenue_authority'
      WHEN regexp_matches({k}, '({"|".join(PUBLIC_AUTHORITY_SUFFIXES)})$') THEN 'public_authority' END"""


def sql_raw_suffix(x: str) -> str:
    return f"nullif(regexp_extract({sql_word_key(x)}, ' ({'|'.join(LEGAL_SUFFIXES)})$', 1), '')"

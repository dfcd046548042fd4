"""Quality rules: a ledger of rule bits and measurements, judged later by policies.

``rule_ledger`` evaluates every rule once per document and stores one bit per failed rule
(``fail_bits``) beside the measurements.  A policy is a version with a mask of the rules that
count; ``apply_policy`` and ``ablation`` read only the ledger, so a new policy or an ablation
is a bitwise pass over one long column (``ledger_ablation`` stores a ledger and reads it for
two policies).  All is SQL functions on the row: no shuffle but for
the final sums of ``ablation``, which are combined per task.

Words are runs of characters other than \\x20 and \\x09-\\x0D; lines are split at \\n.

Defined results: null text counts as empty (all measurements 0, fails ``few_words``); rows
stand one for one, repeats and null ids included; an empty table gives an empty ledger; input
columns other than doc_id and text are not read.  Windows are compared by 64-bit digests
within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, table, through_files

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    """Array of words, empty strings left out."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose digest is there twice or more, from window digests by position.

    Sorting (digest, position) puts equal windows side by side; the positions of those are
    sorted again and their union is summed: each adds min(WINDOW, distance to the next).
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        at = lambda k: F.get(s, k)["h"]
        marked = F.transform(
            s, lambda x, k: F.when((at(k - 1) == x["h"]) | (at(k + 1) == x["h"]), x["i"])
        )
        starts = F.array_sort(F.array_compact(marked))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(
            i.alias("last"),
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"),
        )
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, covered))


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: str


#: The rules, bit by bit.  A rule keeps its bit for ever; new ones are appended.
RULES = [
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words * 3"),
    Rule("repeated_lines", "n_lines > 3 AND 2 * n_dup_lines > n_lines"),
    Rule("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
]

#: Policies by version: names of the rules that count.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in POLICIES[policy])


def rule_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements, fail_bits for each row of (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    blanks = F.translate("t", SPACES, "")
    base = docs.select("doc_id", text.alias("t"))
    base = base.select(
        "doc_id", "t", words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
    )
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))
    )
    hashes = F.when(F.size("w") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))
    measured = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(blanks).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(hashes, repeated_words).alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: str, name: str) -> DataFrame:
    """Adds a boolean column: no rule of the policy failed."""
    return ledger.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows failing it, and rows that only it removes."""
    m = mask(policy)
    masked = ledger.select(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("b"))
    rules = [(i, r.name) for i, r in enumerate(RULES) if m >> i & 1]
    sums = [F.coalesce(F.sum((F.col("b").bitwiseAND(F.lit(1 << i)) != 0).cast("long")), F.lit(0)).alias(f"f{i}") for i, _ in rules]
    sums += [F.coalesce(F.sum((F.col("b") == (1 << i)).cast("long")), F.lit(0)).alias(f"o{i}") for i, _ in rules]
    rows = [F.struct(F.lit(n).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only")) for i, n in rules]
    return masked.agg(*sums).select(F.inline(F.array(*rows)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, with the base and the v1 policy's verdicts."""
    ledger = rule_ledger(table(spark, sf_dir, "documents"))
    ledger = apply_policy(apply_policy(ledger, "base", "base_kept"), "v1", "kept")
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "n_lines", "fail_bits",
    )


def ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablations of both policies, read from one stored ledger of all documents."""
    ledger = through_files(rule_ledger(table(spark, sf_dir, "documents")).select("doc_id", "fail_bits"))
    parts = [ablation(ledger, p).select(F.lit(p).alias("policy"), "rule", "n_failed", "n_only") for p in POLICIES]
    return parts[0].unionByName(parts[1])


_W = r"[^\x20\x09-\x0D]+"
QUERIES = {"op6_quality_rules": op6_quality_rules, "ledger_ablation": ledger_ablation}
_LEDGER = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM t),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}),
win2 AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win2) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, {WINDOW}) r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))})::BIGINT AS fail_bits FROM m)"""
ORACLE = {
    "op6_quality_rules": _LEDGER + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {mask("base")}) <> 0 AS base_failed, (fail_bits & {mask("v1")}) = 0 AS kept, n_lines, fail_bits FROM f""",
    "ledger_ablation": _LEDGER + "\n" + "\nUNION ALL ".join(
        f"""SELECT '{p}' AS policy, '{r.name}' AS rule, count(*) FILTER (WHERE fail_bits & {1 << i} <> 0)::BIGINT AS n_failed,
  count(*) FILTER (WHERE fail_bits & {mask(p)} = {1 << i})::BIGINT AS n_only FROM f"""
        for p in POLICIES for i, r in enumerate(RULES) if r.name in POLICIES[p]
    ),
}

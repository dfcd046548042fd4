"""Many terms in many texts: an index of grams joined by equality, then confirmed.

A term goes by one of its grams of ``GRAM`` characters (or by itself, where it is shorter): the
one that the fewest terms have.  Texts are cut into their distinct grams, and those that stand for
a term are joined to it; only then is the term looked for in the text.  So no text meets a
term that it shares no gram with, at any number of terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.plans.storage import through_files

#: Characters of a gram.
GRAM = 6


def _grams(chars: Column, size: Column) -> Column:
    """All stretches of ``size`` among characters."""
    n = F.size(chars) - size
    starts = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(chars, i + 1, size), ""))


def indexed_terms(rules: DataFrame) -> DataFrame:
    """rule_no, term (lower-cased), size and gram of each rule whose term is not empty."""
    terms = rules.select("rule_no", F.lower("term").alias("term")).filter("term <> ''").distinct()
    terms = terms.withColumn("size", F.least(F.length("term"), F.lit(GRAM)))
    each = terms.select("term", "size").distinct().withColumn("chars", F.split("term", ""))
    each = each.select("term", "size", F.explode(F.array_distinct(_grams(F.col("chars"), F.col("size")))).alias("gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("n"))
    best = each.join(shared, "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return terms.join(best, "term")


def term_hits(docs: DataFrame, rules: DataFrame, text_col: str) -> DataFrame:
    """(document_id, rule_no, term): the rules (rule_no, term) whose term, lower-cased, is in a document's text, whatever the case.

    Null texts and empty terms hit nothing.  Of the rows of one document_id each text counts.
    """
    # written, so its size is known: an index that is small is sent to the texts, whose grams are then not shuffled
    index = through_files(indexed_terms(rules))
    # at most GRAM numbers
    sizes = sorted(r[0] for r in index.select("size").distinct().collect())
    # few files would be few tasks, and cutting is the work here
    texts = docs.select("document_id", F.lower(text_col).alias("_t")).filter("_t IS NOT NULL").repartition("document_id")
    cut = [_grams(F.col("_chars"), F.lit(n)) for n in sizes]
    grams = F.concat(*cut) if cut else F.array().cast("array<string>")
    parts = texts.select("document_id", F.split("_t", "").alias("_chars")).select("document_id", F.explode(F.array_distinct(grams)).alias("gram"))
    maybe = parts.join(index.select("gram", "rule_no", "term"), "gram").select("document_id", "rule_no", "term").distinct()
    return maybe.join(texts, "document_id").filter(F.contains("_t", "term")).select("document_id", "rule_no", "term").distinct()

"""Corpus pipeline: from the documents table to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents,
and each works on all that its predecessor kept.

Defined results: rows whose text is null, empty or without a letter go at the first stage.
Repeated rows and copies meet at the near-duplicate stage, which also drops rows without an
id, as it names documents by id.  Documents of which the repeats stage leaves nothing go with
it.  Extra columns are dropped; empty tables pass through all stages.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import jaccard_join, language_id, packing, suffix_dedup, toxicity
from evidentia.llm.common import table, through_files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: five-word shingles and a similarity of 0.8.
NGRAM, SIMILARITY = 5, Fraction(80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: lang becomes the predicted language; unidentifiable documents go."""
    trees = language_id.fit(docs, F.lit(True))
    found = language_id.identify(docs, trees, COLUMNS).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score THRESHOLD or more go."""
    model = toxicity.fit(toxicity.learning_rows(docs, table(spark, sf_dir, "labels"), F.lit(True)))
    scored = toxicity.score_texts(docs, model, COLUMNS)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the document with the least id stays."""
    groups = jaccard_join.similarity_components(docs, NGRAM, SIMILARITY)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(first, "doc_id", "left_semi")
    one = Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")
    return kept.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: 50-byte strings of earlier documents are cut out."""
    cut = suffix_dedup.remove_repeats(docs, ("doc_id", "lang", "source"), as_text=True).filter("kept <> ''")
    return cut.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source",
        F.length("kept").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars"),
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row for each piece of a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", pack),
]
#: SQL has neither the classifiers nor the tokenizer; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = through_files(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

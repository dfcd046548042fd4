"""The corpus pipeline: what each stage keeps, against plain versions."""

from fractions import Fraction

from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import toxicity
from evidentia.llm.common import through_files

from .test_operators import SF, brute_components, removed

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = through_files(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == COLUMNS
            after = {r.doc_id: r.text for r in docs.collect()}
            seen.append((name, before, after))
    kept = dict((n, (b, a)) for n, b, a in seen)
    before, after = kept["language"]
    assert set(after) == {i for i, t in before if t and any(c.isalpha() for c in t)}
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    named = spark.createDataFrame(before, "doc_id long, text string")
    model = toxicity.fit(toxicity.learning_rows(named, labels, F.lit(True)))
    assert set(after) == {i for i, t in before if model.score(t) < 0.7} and len(after) < len(before)
    before, after = kept["near_duplicates"]
    assert set(after) == {c for _, _, c in brute_components(before, 5, Fraction(4, 5))}
    before, after = kept["repeats"]
    want = {i: k.decode("utf-8", "ignore") for i, _, _, _, k in removed(before)}
    assert after == {i: t for i, t in want.items() if t}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(after)


def test_empty_and_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema.simpleString()[7:-1].replace(":", " ")
    for rows in ([], [(1, None, None, None, None), (None, "some words here", "en", "s", 1), (2, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = through_files(stage(spark, docs, SF))
        assert docs.count() == 0


def test_repeated_ids_ties_long_texts_and_clashing_columns(spark):
    """Odd rows among the documents of the smallest scale: each stage gives its columns and keeps what it should."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    (text,) = docs.filter("lang = 'en' AND length(text) BETWEEN 400 AND 900").orderBy("doc_id").limit(1).select("text").first()
    long = " ".join(f"{w}{i % 97}" for i, w in enumerate(text.split() * 400))
    extra = [(90001, text, "en", "s", 1), (90001, text, "en", "s", 1), (90002, text, "en", "s", 1), (90003, long, "en", "s", 1), (None, text, "en", "s", 1), (90004, None, None, None, None)]
    both = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("score", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("lang_pred", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        both = through_files(stage(spark, both, SF))
        assert both.columns == COLUMNS
        ids = [r.doc_id for r in both.select("doc_id").collect()]
        assert 90004 not in ids
        if name == "near_duplicates":
            assert len(ids) == len(set(ids)) and None not in ids
            assert not {90001, 90002} & set(ids) and 90003 in ids  # copies of an earlier document go, the long one stays
    assert corpus_pipeline.STAGES[-1][1](spark, both, SF).select("doc_id").distinct().count() == both.count()

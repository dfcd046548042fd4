"""Stored state: versions, the buckets that a change writes, and changes that break off."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import lifecycle
from evidentia.plans.state import StateTable
from evidentia.plans.storage import shared_dir

SIGNAL = "signal_id string, signal_type string, status string, score double, subject_id string, object_id string, interpretation string"
REVIEW = "review_id string, item_type string, status string, signal_id string"


def signals(spark, ids, status="review", kind="T", score=0.5):
    return spark.createDataFrame([(f"s{i}", kind, status, score, f"x{i}", None, "i") for i in ids], SIGNAL)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_and_touched_buckets(spark):
    table = StateTable(spark, shared_dir(spark), "signal_id", SIGNAL)
    assert table.latest() is None and table.read().count() == 0
    first = signals(spark, range(500))
    assert table.commit(first) == 0
    assert table.commit(first) == 1 and set(table._parts(1).values()) == {0}  # nothing changed, nothing written
    second = first.withColumn("score", F.when(F.col("signal_id").isin("s1", "s2"), 0.9).otherwise(F.col("score"))).filter("signal_id <> 's3'")
    assert table.commit(second) == 2
    assert 1 <= sum(n == 2 for n in table._parts(2).values()) <= 3
    assert rows(table.read()) == rows(second) and rows(table.read(0)) == rows(first)
    assert table.commit(first.limit(0)) == 3 and table.read().count() == 0
    table.vacuum(2)
    assert table.versions() == [2, 3] and rows(table.read(2)) == rows(second)


def test_a_cycle_that_breaks_off_leaves_the_old_version(spark, monkeypatch):
    folder = shared_dir(spark)
    state = StateTable(spark, f"{folder}/signals", "signal_id", SIGNAL)
    reviews = StateTable(spark, f"{folder}/reviews", "review_id", REVIEW)
    state.commit(signals(spark, range(40), "approved"))
    reviews.commit(spark.createDataFrame([(f"r{i}", "SIGNAL_REVIEW", "open", f"s{i}") for i in range(40)], REVIEW))
    new = signals(spark, range(20, 60), score=0.7)
    found = spark.createDataFrame([(f"r{i}", "SIGNAL_REVIEW", "open", f"s{i}") for i in range(20, 60)], REVIEW)
    before = rows(state.read()), rows(reviews.read())
    whole = StateTable.bucket

    def broken(self):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(StateTable, "bucket", broken)
    with pytest.raises(RuntimeError):
        lifecycle.stored_cycle(state, reviews, new, found)
    monkeypatch.setattr(StateTable, "bucket", whole)
    # files of a version that was never completed are no version
    state.read().withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{state.folder}/data/1")
    assert (rows(state.read()), rows(reviews.read())) == before and state.versions() == [0]
    assert lifecycle.stored_cycle(state, reviews, new, found) == (1, 1)
    status = {r.signal_id: r.status for r in state.read().collect()}
    assert len(status) == 60 and status["s5"] == "stale" and status["s25"] == "approved" and status["s50"] == "review"
    assert {r.review_id: r.status for r in reviews.read().collect()}["r5"] == "stale"
    after = rows(state.read())
    lifecycle.stored_cycle(state, reviews, new, found)  # once more: the same
    assert rows(state.read()) == after and rows(state.read(0)) == before[0]

"""Streams on shuffled, late and repeated input, in several runs, against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators.ingest import content_changes
from evidentia.operators.publish import publication_status
from evidentia.plans.storage import shared_dir
from evidentia.streaming import streams

START = dt.datetime(2024, 3, 1, 7, 30)


def observed(spark, rows):
    return spark.createDataFrame(rows, "document_id string, sha256 string, retrieved_at timestamp, observation_id long")


def write_part(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def parts():
    """Five parts, each shuffled within the delay of two hours and with repeats; a third of all rows are of one document."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.34 else f"d{rng.randrange(9)}", f"s{rng.randrange(3)}", START + dt.timedelta(minutes=i, microseconds=rng.randrange(10**6)), i) for i in range(900)]
    out = [rows[i * 180 : (i + 1) * 180] for i in range(5)]
    for i in range(1, 5):
        recent = [r for r in out[i - 1] if r[3] >= i * 180 - 90]  # less than two hours behind
        moved = [r for r in recent if rng.random() < 0.4]
        out[i - 1] = [r for r in out[i - 1] if r not in moved]
        out[i] = out[i] + moved + rng.sample(recent, 9)
        rng.shuffle(out[i])
    return out


def test_changes_equal_the_batch_up_to_the_watermark_and_go_on_from_a_checkpoint(spark, parts):
    folder, told = shared_dir(spark), shared_dir(spark)
    for k, part in enumerate(parts):
        write_part(observed(spark, part), folder)
        stream = spark.readStream.schema(observed(spark, part).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        if k != 2:  # the third run takes two parts
            got = streams.run_to_end(streams.stream_content_changes(stream, "2 hours"), folder=told)
    every = observed(spark, [r for p in parts for r in p]).dropDuplicates(["observation_id"])
    last = every.agg(F.max("retrieved_at")).first()[0] - dt.timedelta(hours=2)
    last = last.replace(microsecond=last.microsecond // 1000 * 1000)
    every_change = every.filter(F.col("retrieved_at") <= F.lit(last))
    want = content_changes(every_change)
    key = lambda r: (r.document_id, r.old_sha256, r.new_sha256, r.detected_at)
    order = Window.partitionBy("document_id").orderBy("retrieved_at", "observation_id")
    each = every_change.select("document_id", F.lag("sha256").over(order).alias("old_sha256"), F.col("sha256").alias("new_sha256"), F.col("retrieved_at").alias("detected_at"))
    assert sorted(map(key, got.collect())) == sorted(map(key, each.filter("old_sha256 <> new_sha256").collect()))
    first = got.groupBy("document_id", "old_sha256", "new_sha256").agg(F.min("detected_at").alias("detected_at"))
    assert sorted(map(key, first.collect())) == sorted(map(key, want.collect()))
    assert got.count() == got.distinct().count() > 100
    # rows that come behind the watermark change nothing
    write_part(observed(spark, [("hot", "sx", START, -1), ("d1", "sx", START + dt.timedelta(minutes=3), -2)]), folder)
    again = streams.run_to_end(streams.stream_content_changes(spark.readStream.schema(every.schema).parquet(folder), "2 hours"), folder=told)
    assert again.count() == got.count()


def test_ledger_accounts_for_every_row(spark, parts):
    folder, source = shared_dir(spark), shared_dir(spark)
    late = [("d1", "sx", START + dt.timedelta(minutes=k), 5000 + k) for k in range(4)]
    for part in [*parts, late + parts[4][:5]]:
        write_part(observed(spark, part), source)
        stream = spark.readStream.schema(observed(spark, part).schema).parquet(source)
        stream.writeStream.foreachBatch(streams.observation_ledger(folder, "2 hours")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    got = streams.read_ledger(spark, folder)
    n = {k: d.count() for k, d in got.items()} | {"repeated": got["repeated"].agg(F.sum("times")).first()[0]}
    assert n["kept"] + n["repeated"] + n["late"] == sum(map(len, parts)) + 9
    assert n["kept"] == 900 == got["kept"].select("observation_id").distinct().count()
    assert {r.observation_id for r in got["late"].collect()} >= {5000, 5001, 5002, 5003}
    # a batch that is run again gives the same
    before = sorted(map(str, got["kept"].drop("batch").collect()))
    streams.observation_ledger(folder, "2 hours")(observed(spark, late + parts[4][:5]), 5)
    assert sorted(map(str, streams.read_ledger(spark, folder)["kept"].drop("batch").collect())) == before


def test_staleness_equals_the_publication_status(spark):
    day = lambda d, h=12: dt.datetime(2024, 3, 1, h) + dt.timedelta(days=d)
    seen = [
        [("a", day(0)), ("b", day(0, 23)), ("c", day(0)), ("c", day(1)), ("never expected", day(0))],
        [("d", day(9)), ("a", day(8, 1))],  # a and b become stale after this
        [("e", day(20)), ("b", day(19, 23)), ("d", day(10))],  # b is back
        [("f", day(24, 5))],
    ]
    expected = spark.createDataFrame([("a", 3, 1), ("b", 2, 0), ("c", 30, 5), ("d", 10, 3), ("e", 2, 1), ("f", 0, 0), ("unseen", 1, 1)], "source_id string, cadence_days int, grace_days int")
    folder, told = shared_dir(spark), shared_dir(spark)
    for part in seen:
        write_part(spark.createDataFrame(part, "source_id string, retrieved_at timestamp"), folder)
        stream = spark.readStream.schema("source_id string, retrieved_at timestamp").parquet(folder)
        statuses = streams.run_to_end(streams.stream_staleness(stream, expected), folder=told)
    every = spark.createDataFrame([r for p in seen for r in p], "source_id string, retrieved_at timestamp")
    health = expected.select("source_id", F.lit("success").alias("status"))
    as_of = (day(24, 5) - dt.timedelta(days=1)).isoformat(sep=" ")
    want = {r.source_id for r in publication_status(expected, health, every, as_of).filter("status = 'stale'").collect()}
    assert {r.source_id for r in streams.stale_sources(statuses).collect()} == want == {"a", "b"}
    told_b = [r.status for r in statuses.filter("source_id = 'b'").orderBy("at").collect()]
    assert told_b == ["stale", "present", "stale"]

"""Ordered scans, as-of lookups and sweeps: hot keys, ties, nulls and plans."""

import bisect
import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evidentia.operators import detect, facts, ordered
from evidentia.operators.ordered import Scan


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = [("hot" if rng.random() < 0.34 else rng.choice(["a", "b", None, f"k{rng.randrange(300)}"]), rng.randrange(4000), i, rng.choice([None, rng.randrange(100)])) for i in range(6000)]
    return spark.createDataFrame(out, "key string, t int, i int, v int").repartition(5)


SCANS = [Scan("before", "b", "v"), Scan("after", "f", "v"), Scan("last", "l", "v"), Scan("reached", "m", "v"), Scan("place", "n")]


@pytest.mark.parametrize("down", [False, True])
def test_blocks_give_what_windows_give(spark, rows, down):
    order = [F.desc("t") if down else F.col("t"), F.col("i")]
    whole = ordered.scanned(rows, ["key"], order, SCANS)
    cut = ordered.scanned(rows, ["key"], order, SCANS, limit=100)
    assert cut.columns == whole.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    empty = ordered.scanned(rows.limit(0), ["key"], order, SCANS)
    assert empty.count() == 0 and empty.columns == whole.columns


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"), F.hash("id").alias("t"), "id")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        sizes = lambda limit: sorted(r["c"] for r in ordered.scanned(df, ["key"], [F.col("t"), F.col("id")], [Scan("place", "n")], limit).groupBy(F.spark_partition_id()).agg(F.count("*").alias("c"), F.sum("n")).collect())
        assert sizes(10**9)[-1] > 5 * statistics.median(sizes(10**9))
        assert sizes(1000)[-1] <= 3 * statistics.median(sizes(1000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [None, 60])
def test_asof_equals_a_search(spark, limit):
    rng = random.Random(4)
    windows, probes = [], []
    for key in ("hot", "a", "b"):
        at = 0
        for i in range(400 if key == "hot" else 30):
            begin = at + rng.randrange(3)
            at = begin + rng.randrange(4)  # some are empty
            windows.append((key, begin, None if i == 399 else at, f"{key}{i}"))
        probes += [(f"{key}p{i}", key, rng.choice([None, rng.randrange(-3, at + 5)])) for i in range(500)]
    probes += [("x", "unknown", 5), ("y", None, 5)]
    w = spark.createDataFrame(windows, "document_id string, since int, until int, snapshot_id string")
    p = spark.createDataFrame(probes, "probe_id string, document_id string, at int")
    got = ordered.asof(p, w, "document_id", "at", "since", "until", ["snapshot_id"], limit)
    want = sorted((i, k, t, s) for i, k, t in probes if t is not None for d, a, z, s in windows if d == k and a <= t and (z is None or t < z))
    assert sorted((r.probe_id, r.document_id, r.at, r.snapshot_id) for r in got.collect()) == want and len(want) > 300


def test_asof_plans_have_no_join_on_a_range(spark):
    f = spark.createDataFrame([], "fact_id string, document_id string, snapshot_id string")
    w = spark.createDataFrame([], "document_id string, snapshot_id string, valid_from timestamp, valid_to timestamp")
    p = spark.createDataFrame([], "probe_id string, document_id string, at timestamp")
    got = plan(facts.facts_asof(f, w, p))
    assert "NestedLoop" not in got and "Cartesian" not in got
    assert not [x for x in got.split("\n") if "Join" in x and ("<" in x or ">" in x)]


def test_one_stream_of_many_payments_and_periods(spark):
    rng = random.Random(8)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    payments = [(f"p{i}", "C1", "S1", 10.0 + i % 3, day(rng.randrange(9000))) for i in range(100_000)]
    payments += [("q1", None, "S1", 5.0, day(3)), ("q2", None, "S1", 5.0, day(50)), ("q3", "C1", "S1", -5.0, day(3)), ("q4", "C1", "S1", 5.0, None), ("q5", "C2", "S1", 5.0, day(1))]
    spans = [(n, n + rng.randrange(3)) for n in (rng.randrange(9000) for _ in range(10_000))]
    contracts = [(f"K{i}", "C1", a, z) for i, (a, z) in enumerate(spans)] + [("N", None, 2, 4)]
    df = spark.createDataFrame
    p = df(payments, "fact_id string, payer_id string, supplier_id string, amount double, payment_date date").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    s = df([(f"r{k}", "S1", k) for k, *_ in contracts], "fact_id string, supplier_id string, contract_id string")
    b = df([(c, k) for k, c, *_ in contracts if c], "buyer_id string, contract_id string")
    ends = df([(f"{e}{k}", k, e, day(n)) for k, _, a, z in contracts for e, n in (("STARTS_ON", a), ("ENDS_ON", z))], "fact_id string, contract_id string, predicate string, day date")
    got = {(r.payer_id, r.supplier_id): (r.outside_count, r.period_count, float(r.outside_total)) for r in detect.payments_outside_periods(p, s, b, ends).collect()}
    best = -1
    begun = sorted(spans)
    keys = [a for a, _ in begun]
    tops = []
    for _, z in begun:
        best = max(best, z)
        tops.append(best)
    outside = []
    for i, payer, _, amount, when in payments:
        if payer == "C1" and amount > 0 and when is not None:
            n = (when - day(0)).days
            k = bisect.bisect_right(keys, n) - 1
            if k < 0 or tops[k] < n:
                outside.append(amount)
    assert got == {("C1", "S1"): (len(outside), 10_000, sum(outside)), (None, "S1"): (1, 1, 5.0)}
    text = plan(detect.payments_outside_periods(p, s, b, ends))
    assert "NestedLoop" not in text and not [x for x in text.split("\n") if "Join" in x and "payment_date" in x]


def test_places_by_ranges_are_places_by_windows_without_a_shuffle_of_rows(spark, rows):
    order, scans = [F.desc("t"), F.col("i")], [Scan("place", "n")]
    cut = ordered.scanned(rows, ["key"], order, scans, limit=100)
    assert sorted(map(str, cut.collect())) == sorted(map(str, ordered.scanned(rows, ["key"], order, scans).collect()))
    assert "Exchange hashpartitioning" not in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.schema["n"].dataType.simpleString() == "int"

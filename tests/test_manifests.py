"""Manifests of evidence against a plain tree of digests."""

import hashlib
import json

from pyspark.sql import functions as F

from evidentia.operators import publish
from evidentia.plans.storage import shared_dir

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain_root(rows, block):
    nodes = [sha("\0".join(r)) for r in sorted(rows)]
    nodes = [sha(",".join(nodes[i : i + block])) for i in range(0, len(nodes), block)] or [sha("")]
    while len(nodes) > 1:
        nodes = [g[0] if len(g) == 1 else sha(",".join(g)) for g in (nodes[i : i + block] for i in range(0, len(nodes), block))]
    return nodes[0]


def given(spark, sizes):
    signals = spark.createDataFrame([(k, "T", "review" if k == "open" else "approved") for k in [*sizes, "none"]], "signal_id string, signal_type string, status string")
    rows = None
    for k, n in sizes.items():
        one = spark.range(n).select(F.lit(k).alias("item_id"), F.concat(F.lit("f"), "id").alias("fact_id"), F.lit("P").alias("predicate"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("value_text"),
            F.lit(None).cast("string").alias("locator"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
        rows = one if rows is None else rows.unionByName(one)
    return signals, rows


def test_roots_and_blocks(spark):
    sizes = {"one": 1, "nine": 9, "ten": 10, "eleven": 11, "hot": 1234, "open": 5}
    signals, chain = given(spark, sizes)
    got = publish.evidence_manifests(signals, chain, 10)
    cut = publish.evidence_manifests(signals, chain, 10, limit=50)
    of = lambda k: [(r.fact_id, r.predicate, r.value_text or "", "", r.url, r.sha256) for r in chain.filter(F.col("item_id") == k).collect()]
    want = sorted((k, sizes.get(k, 0), plain_root(of(k), 10)) for k in [*sizes, "none"] if k != "open")
    for m in (got, cut):
        assert sorted((r.signal_id, r.evidence_count, r.root_sha256) for r in m.roots.collect()) == want
    blocks = {(r.signal_id, r.block_no): json.loads(r.body) for r in cut.blocks.collect()}
    assert [f["fact_id"] for i in range(124) for f in blocks["hot", i]] == sorted(f"f{i}" for i in range(1234))
    assert all(json.loads(r.manifest)["root_sha256"] == r.root_sha256 and sha(r.manifest) == r.manifest_sha256 for r in got.roots.collect())
    folder = shared_dir(spark)
    publish.write_manifests(got, folder)
    assert spark.read.json(f"{folder}/blocks").count() == len(blocks) and spark.read.json(f"{folder}/roots").count() == len(want)


def test_a_signal_with_a_million_facts_is_many_tasks(spark):
    signals, chain = given(spark, {"hot": 1_000_000, "small": 3})
    got = publish.evidence_manifests(signals, chain, limit=100_000)
    sizes = [r["count"] for r in got.blocks.filter("signal_id = 'hot'").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) > 1 and max(sizes) < 600
    assert {r.signal_id: r.evidence_count for r in got.roots.collect()} == {"hot": 1_000_000, "small": 3, "none": 0}

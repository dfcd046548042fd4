"""Registered queries over all rows of their tables: every row takes part."""

from pyspark.sql import functions as F

from evidentia import registry
from evidentia.sources.staging import view

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF)


def test_every_event_is_in_the_fetch_log(spark):
    days = view(spark, SF, "events").select("user_id", F.to_date("ts")).distinct().count()
    got = run(spark, "a9_source_run_status")
    assert got.count() == days and got.select("status").distinct().count() >= 5


def test_every_observation_probes(spark):
    probes = run(spark, "b7_facts_asof").select("probe_id").distinct()
    assert {r[0] for r in probes.collect()} == {r[0] for r in view(spark, SF, "events").select("event_id").collect()}

"""Pairs of match rules: made in slices of large keys, judged where they are made and never shuffled."""

import itertools
import random
import re

import pytest

from evidentia import registry
from evidentia.operators import resolve

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["e3_match_name_exact", "e15_cleanup_invalid", "e15_cleanup_reviews", "e11_match_evidence"])
def test_pairs_are_not_shuffled(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = " ".join(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan))
    assert not re.search(r"left_id|right_id|match_id|subject_id|object_id", keys), keys


def test_large_keys_are_cut_into_slices(spark, monkeypatch):
    one = [(f"E{i:03}", "hot one" if i < 90 else f"cold name {i // 2}" if i < 120 else None) for i in range(130)]
    aliases = spark.createDataFrame(one, "entity_id string, normalized_alias string")
    whole = rows(resolve.match_name_exact(aliases))
    assert len(whole) == 90 * 89 // 2 + 15
    monkeypatch.setattr(resolve, "SLICE", 10)
    assert rows(resolve.match_name_exact(aliases)) == whole
    left, right, keys = resolve._sides(aliases, ["normalized_alias"])
    assert keys[-1] == "_slice" and left.count() == 130 and right.count() == 90 * 9 + 40
    tasks = left.join(right, keys).groupBy("_slice").count().collect()
    assert len(tasks) == 9 and max(r["count"] for r in tasks) < 90 * 90 / 3


def test_of_several_common_aliases_the_surest_tells(spark):
    held = {"a": ["short", "a longer alias", "two words", None], "b": ["two words", "a longer alias", "short", "short"], "c": ["short"], "d": ["a longer alias", "other alias"]}
    aliases = spark.createDataFrame([(e, n) for e, names in held.items() for n in names] + [(None, "short")], "entity_id string, normalized_alias string")
    got = {(r.left_id, r.right_id): (r.evidence, r.status) for r in resolve.match_name_exact(aliases).collect()}
    assert resolve.match_name_exact(aliases).count() == len(got) == 5
    for (x, y), (evidence, status) in got.items():
        common = {n for n in held[x] if n} & set(held[y])
        best = min((" " not in n, n) for n in common)
        assert (evidence, status) == (f'{{"normalized_name":"{best[1]}"}}', "review" if best[0] else "auto_accepted")
    assert {(x, y) for x, y in itertools.combinations("abcd", 2) if set(held[x]) & set(held[y]) - {None}} == set(got)


def test_cleanup_by_flags_is_cleanup_by_joins(spark):
    named = resolve.standardise_names(spark.createDataFrame(
        [(f"E{i}", "SUPPLIER", n, "s", None, None) for i, n in enumerate(["Various", "Various", "Miscellaneous", "Acme", "ACME", "12345", "12345"])],
        "entity_id string, entity_type string, canonical_name string, source_system string, scheme string, identifier string"))
    aliases = resolve.canonical_aliases(named)
    plain = resolve.match_name_exact(aliases)
    flagged = resolve.match_name_exact(resolve.flag_implausible(named, aliases), ("implausible",))
    a = resolve.cleanup_invalid(named, aliases, plain, resolve.match_reviews(plain))
    b = resolve.cleanup_invalid(named, aliases, flagged, resolve.match_reviews(flagged))
    assert [x.columns for x in a] == [x.columns for x in b] and [rows(x) for x in a] == [rows(x) for x in b]
    assert {r.status for r in b[1].collect()} == {"rejected"} and {r.status for r in b[2].collect()} == {"resolved"}


@pytest.mark.parametrize("name", ["e11_upsert_matches", "e11_refreshed_evidence"])
def test_matches_of_rules_that_did_not_run_are_not_joined(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and plan.children().size() == 2
    joined, kept = (plan.children().apply(i).toString() for i in (0, 1))
    assert "FullOuter" in joined and "exact_clean_name" not in joined and "FullOuter" not in kept and "exact_clean_name" in kept


def test_upsert_by_rule_is_upsert_of_all(spark):
    schema = "match_id string, left_id string, right_id string, match_method string, confidence double, status string, evidence string"
    old = spark.createDataFrame([("1", "a", "b", "m", 0.5, "rejected", "x"), ("2", "a", "c", "m", 0.5, "review", "x"), ("3", "a", "b", "k", 0.4, "review", "x"), ("4", "a", "d", None, 0.3, "accepted", "x")], schema)
    new = spark.createDataFrame([("1", "a", "b", "m", 0.9, "auto_accepted", "y"), ("2", "a", "c", "m", 0.9, "auto_accepted", "y"), ("5", "b", "c", "m", 1.0, "review", "y")], schema)
    assert rows(resolve.upsert_matches(old, new, ("m",))) == rows(resolve.upsert_matches(old, new))


def test_evidence_has_the_typos_of_first_words_that_many_rows_share(spark, monkeypatch):
    run = lambda: rows(registry.queries()["e11_match_evidence"](spark, SF).filter("match_method IN ('near_typo', 'conservative_one_edit')"))
    whole = run()
    monkeypatch.setattr(resolve, "BLOCK_CAP", 2)
    assert run() == whole and {r[1] for r in whole} == {"near_typo", "conservative_one_edit"}
    assert "block_size" not in registry.oracle_sql()["e11_match_evidence"] and "block_size" in registry.oracle_sql()["e8_match_near_typo"]


def test_one_edit_in_large_blocks_is_all_pairs(spark):
    rng, names = random.Random(4), []
    for i in range(70):
        one = f"acme {''.join(rng.choice('aab ') for _ in range(12))} trading".replace("  ", " ")
        at = rng.randint(5, len(one) - 1)
        names += [one, one[:at] + rng.choice("abx ") + one[at + 1:], one[:at] + rng.choice("aé") + one[at:], one[:at] + one[at + 1:], one[:at] + one[at + 1:at] + one[at + 1:]]
    names += ["acme aaaa aaaa trading"] * 5 + ["acme aaaa aaab trading", "acmf aaaa aaaa trading", "acme aaaaa aaaa trading", "acme aaaa aaaa tradin g", None]
    named = spark.createDataFrame([(f"E{i:03}", "SUPPLIER", n, n) for i, n in enumerate(names)], "entity_id string, entity_type string, canonical_name string, analysis_key string")
    held = [(f"E{i:03}", n) for i, n in enumerate(names) if n and len(n) >= 15 and len(n.split(" ")) >= 3]
    assert len(held) > 4 * resolve.BLOCK_CAP

    def near(a, b):
        a, b = sorted((a, b), key=len)
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    want = {(x, y) for (x, m), (y, n) in itertools.combinations(held, 2) if m.split(" ")[0] == n.split(" ")[0] and len(m.split(" ")) == len(n.split(" ")) and near(m, n)}
    got = [(r.left_id, r.right_id) for r in resolve.match_conservative_one_edit(named, capped=False).collect()]
    assert sorted(got) == sorted(want) and len(want) > 150
    assert resolve.match_conservative_one_edit(named).count() == 0

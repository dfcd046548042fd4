"""Name similarity: the bound on letters drops no pair that the ratio keeps."""

import difflib
import random

from pyspark.sql import functions as F

from evidentia.operators import resolve


def test_bound_and_matches_equal_brute_force(spark):
    rng = random.Random(9)
    names = []
    for block in ("acme", "north", "été", "full"):
        for i in range(100 if block == "full" else 40):
            tail = "".join(rng.choice("aabcdelmno ") for _ in range(rng.randint(3, 16))).strip()
            names += [f"{block} {tail}"]
            if i % 3 == 0:
                names += [f"{block} {tail[::-1]}", f"{block} {tail}x"]
    names += ["acme acme", "acme acme", "short", "", None]
    aliases = spark.createDataFrame([(f"e{i:04d}", n) for i, n in enumerate(names)], "entity_id string, normalized_alias string")
    long = [(f"e{i:04d}", n) for i, n in enumerate(names) if n and len(n) >= 8]
    blocks = {}
    for e, n in long:
        blocks.setdefault(n.split(" ")[0], []).append((e, n))
    pairs = [(a, b) for own in blocks.values() if len(own) <= resolve.BLOCK_CAP for a in own for b in own if a[0] < b[0] and a[1] != b[1]]
    ratio = {(a[0], b[0]): difflib.SequenceMatcher(None, a[1], b[1]).ratio() for a, b in pairs}
    want = {k: round(r, 4) for k, r in ratio.items() if r >= 0.88}
    got = {(r.left_id, r.right_id): r.confidence for r in resolve.match_name_similarity(aliases).collect()}
    assert got == want and len(want) > 20 and "full" not in {n.split()[0] for k in want for n in [dict(long)[k[0]]]}
    bounds = {(r.left_id, r.right_id): r.bound for r in resolve.similar_candidates(aliases, 0.0).collect()}
    assert set(bounds) == set(ratio) and all(bounds[k] >= ratio[k] - 1e-12 for k in ratio)
    candidates = resolve.similar_candidates(aliases).count()
    by_length = sum(2 * min(len(a[1]), len(b[1])) / (len(a[1]) + len(b[1])) >= 0.88 for a, b in pairs)
    assert len(want) <= candidates < by_length / 4  # most pairs never reach Python


def test_letter_bag(spark):
    got = spark.createDataFrame([("abba",), ("",), (None,)], "k string").select(resolve.letter_bag("k").alias("b")).collect()
    assert sorted(got[0].b) == ["a0", "a1", "b0", "b1"] and got[2].b is None

"""Decontamination, spelling variants and hard negatives against brute force, on rows with every oddity."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontamination, hard_negatives, spelling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(docs, benchmark, size):
    windows = collections.defaultdict(set)
    for item, text in benchmark:
        w = WORD.findall(lowered(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= own
        out.append((doc, len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return sorted(out, key=str)


def decontaminated(spark, docs, benchmark, size=10):
    names = "doc_id long, text string, item_set string, row long, words string, spans int"
    d = spark.createDataFrame([(*x, "a", 1, "b", 2) for x in docs], names).repartition(3)
    b = spark.createDataFrame([(*x, 7) for x in benchmark], "item_id long, text string, doc_id int")
    got = decontamination.decontaminate(d, b, size)
    sets = {r.item_set: r["items"] for r in got.item_sets.collect()}
    return sorted(
        ((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sets[r.item_set] if r.item_set else []) for r in got.documents.collect()), key=str
    )


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, v: rng.choice([" ", "  ", ", ", "\n"]).join(rng.choice(v) for _ in range(n))
    few, many = ["a", "b", "É", "c1"], [f"w{i}" for i in range(300)] + ["naïve", "ÉCOLE", "x" * 70_000]
    benchmark = [(i, text(rng.randint(8, 30), many)) for i in range(12)]
    benchmark += [(20, text(14, few)), (21, "only three words"), (22, "Lone"), (None, text(12, many)), (24, None), (25, ""), (26, " .,"), (20, text(11, many)), (28, benchmark[0][1])]
    docs = [(i, text(rng.randint(0, 60), many)) for i in range(20)]
    for i in range(40):
        words = rng.choice(benchmark)[1] or ""
        cut = rng.randint(0, 40)
        docs.append((100 + i, text(rng.randint(0, 9), many) + " " + words[cut:].upper() + "; " + text(rng.randint(0, 5), many)))
    docs += [(200, None), (201, ""), (202, "..."), (203, text(400, few)), (204, "It has only THREE-words; lone"), (205, benchmark[3][1] + " " + benchmark[3][1]), (100, docs[20][1]), (None, benchmark[1][1])]
    assert decontaminated(spark, docs, benchmark) == brute_hits(docs, benchmark, 10)
    assert decontaminated(spark, docs, benchmark, 5) == brute_hits(docs, benchmark, 5)


def test_decontamination_of_empty_tables(spark):
    assert decontaminated(spark, [(1, "some words")], []) == [(1, 2, 0, [])]
    assert decontaminated(spark, [], [(1, "some words")]) == []


def test_winnowing_keeps_a_fingerprint_of_every_shared_window():
    rng = np.random.default_rng(1)
    text, inner = rng.integers(0, 9, 500).astype(np.uint64), rng.integers(0, 9, 30).astype(np.uint64)
    text[200:230] = inner
    at = decontamination.window_fingerprints(text, 10)[200:221]
    assert (at == decontamination.window_fingerprints(inner, 10)).all()
    assert len(np.unique(at)) < 21  # neighbours share them


def brute_variants(docs, damage=None):
    n = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if damage and h % damage == 0 else run] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    forms, count = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        count[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, n[w], count[w], forms[w], n[forms[w]] if forms[w] else None, root))
    return sorted(out)


def variants(spark, docs, damage=None):
    d = spark.createDataFrame([(*x, "w", 3) for x in docs], "doc_id long, text string, word string, n int").repartition(3)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(d, damage).collect())


def test_spelling_variants_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choice("abçé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Zürich÷x", "z" * 300, "z" * 301]
    bag = []
    for w in base:
        bag += [w] * rng.choice([5, 6, 30, 150, 800])
        for _ in range(3):
            i, how = rng.randrange(len(w)), rng.randrange(3)
            bag += [w[:i] + rng.choice(["", "é", "b"]) + w[i + (how > 0) :]] * rng.choice([4, 5, 6, 30])
    rng.shuffle(bag)
    docs = [(i, rng.choice([" ", ", ", "1"]).join(bag[i * 97 : (i + 1) * 97])) for i in range(len(bag) // 97 + 1)]
    docs += [(None, " ".join(base[:9])), (5000, None), (5001, ""), (5002, "12 ., Āſ"), (1, docs[1][1])]
    want = brute_variants(docs, 19)
    assert sum(r[3] is not None for r in want) > 20 and any(r[3] not in (None, r[5]) for r in want)
    assert variants(spark, docs, 19) == want
    assert variants(spark, docs) == brute_variants(docs)
    monkeypatch.setattr(spelling, "GROUP", 3)  # every group is split into cells
    assert variants(spark, docs, 19) == want
    assert variants(spark, [(1, "too few words")]) == [] and variants(spark, []) == []


def test_groups_are_cut_whole_and_ranges_are_skipped(spark, monkeypatch):
    """Portions end between groups, and a list of words with other beginnings costs no look at each."""
    words = sorted({f"{a}{b}{c}tail" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"})
    vocab = spark.createDataFrame([(w, 5 + 100 * (i == 500)) for i, w in enumerate(words)], "word string, n long")
    want = sorted((r.word, r.n_near) for r in spelling.near_words(vocab).collect())
    assert want == [(w, 27) for w in words]
    monkeypatch.setattr(spelling, "TAKEN", 10)
    rows = spelling.dealt(vocab).orderBy("m", "back", "part", "i", "j", "w").toArrow()
    got = collections.Counter()
    for b in spelling._search_sorted(rows.to_batches(7)):
        for w, k in zip(b.column("word").to_pylist(), b.column("n_near").to_pylist()):
            got[w] += k
    assert got == dict(want)


def brute_negatives(rows, anchor, positives=5, negatives=10):
    good = []
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(float(x) * 256)) for x in v]
            if sum(x * x for x in whole) < 1 << 55:
                good.append((i, whole, y))
    first = {}
    for i, v, y in good:
        if i % anchor == 0 and (i not in first or (y, v) < first[i]):
            first[i] = (y, v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (y, v) in first.items():
        scored = [(-dot(v, w), j, z) for j, w, z in good if j != i]
        for rank, (s, j, _) in enumerate(sorted(x for x in scored if x[2] == y)[:positives]):
            fits = sorted((t, k) for t, k, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(i, rank + 1, j, -s, n + 1, k, -t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, anchor):
    d = spark.createDataFrame([(*x, 1, "b") for x in rows], "vec_id long, embedding array<double>, label int, vector int, a string").repartition(3)
    got = hard_negatives.mine(d, F.col("vec_id") % anchor == 0).collect()
    return sorted((r.anchor_id, r.positive_rank, r.positive_id, r.positive_score, r.rank, r.negative_id, r.negative_score) for r in got)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(4, 40))
    rows = [(int(i), (middle[i % 4] * rng.choice([0.2, 1.0]) + rng.normal(size=40) * 0.4).tolist(), int(i % 4)) for i in range(400)]
    rows += [(1000 + i, middle[0].tolist(), i % 3) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2001, [], 1), (2002, [], 2), (2003, [1.0, None], 1), (2004, [float("nan")] * 40, 1), (2005, [float("inf")], 0), (None, [1.0], 1), (2006, [1.0], None)]
    rows += [(2007, [0.5] * 7, 3), (2008, (rng.normal(size=83)).tolist(), 3), (2010, [1e30] * 40, 1), (2011, [1e5] * 40, 1), (20, rows[3][1], 3), (20, rows[4][1], 0), (7, rows[7][1], 3), (-40, rows[8][1], 0)]
    want = brute_negatives(rows, 20)
    assert len(want) > 500
    assert mined(spark, rows, 20) == want
    monkeypatch.setattr(hard_negatives, "BLOCK", 5)
    monkeypatch.setattr(hard_negatives, "PART_PAIRS", 40)
    assert mined(spark, rows, 20) == want


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(1, [1.0], 1), (3, [1.0], 2)]])
def test_hard_negatives_of_few_rows(spark, rows):
    assert mined(spark, rows, 100) == []


def test_segment_bounds_hold_and_rule_out():
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=(300, 64)), axis=1)  # neighbours are alike: means say much
    import pyarrow as pa

    batch = hard_negatives.summaries(pa.array(range(300)), pa.array([0] * 300), pa.array(walk.tolist()))
    v = hard_negatives.vectors(batch)
    exact = v.whole @ v.whole.T
    widths = []
    for mean, deviation in zip(v.means, v.deviations):
        middle, reach = mean @ mean.T, deviation @ deviation.T
        assert (middle - reach <= exact + 1).all() and (exact <= middle + reach + 1).all()
        widths.append(reach.mean())
    assert widths[1] < widths[0] < np.abs(exact).mean() / 2

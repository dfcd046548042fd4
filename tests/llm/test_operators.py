"""The ten operators against brute force, and their defined results for odd rows."""

import collections
import hashlib
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from evidentia.llm import (
    bpe, fingerprints, jaccard_join, language_id, packing, quality_rules, suffix_dedup, token_counts, toxicity, url_filter,
)
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, score string, rule string, kept string, start int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Nulls, empty and blank texts, repeats, ties of ids, a long text, clashing columns."""
    base = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(40).collect()]
    passage = " ".join(f"hot{i}" for i in range(40))
    extra = [(100, None), (101, ""), (102, " \n\t "), (103, base[3][1]), (103, base[3][1]), (104, "one two"), (105, "one  two"), (106, base[5][1] * 30), (None, base[1][1])]
    extra += [(200 + i, f"{passage} tail{i} x{i}") for i in range(30)] + [(300 + i, f"own{i} " * 3 + passage + " " + " ".join(f"w{i}_{k}" for k in range(60))) for i in range(20)]
    rows = [(i, t, None, None, None, 1, "x", "y", "z", 2) for i, t in base + extra]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def paragraphs(t):
    parts = re.split(r"\n|(?<=[^a-df-z \t\n\x0b\f\r][.!?])[ \t\n\x0b\f\r]+", t)
    times = collections.Counter(p for p in parts if p.strip(" "))
    return {(p, k) for p, n in times.items() for k in {2**j for j in range(n.bit_length())} | {n}}


def check_fingerprints(df):
    signed = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]
    rows = sorted(((i, t or "") for i, t in texts_of(df)), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        near = (like(paragraphs(t), paragraphs(x)) for x in (edited, nxt))
        want.append((i or -1, hashlib.sha256(edited.encode()).hexdigest(), len(t), *(round(x, 9) for x in near)))
    got = fingerprints.fingerprint_versions(df).collect()
    assert sorted((r.doc_id or -1, r.edited_sha256, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    text_of = {(i or -1, sha): t for (i, sha, *_), (_, t) in zip(want, rows)}
    prints = collections.defaultdict(set)
    for r in got:
        prints[text_of[(r.doc_id or -1, r.edited_sha256)]].add(r.fingerprint)
    assert sum(map(len, prints.values())) <= len(set(text_of.values())) + 2


def test_fingerprints(odd, none):
    assert fingerprints.fingerprint_versions(none).count() == 0
    check_fingerprints(odd)


@pytest.mark.parametrize("rounds", [fingerprints.ROUNDS, 1])
def test_fingerprints_by_ranges(spark, monkeypatch, rounds):
    """An outlying id, an id and null that fill several ranges, long texts; sketches that fail to the last."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 8)
    monkeypatch.setattr(fingerprints, "ROUNDS", rounds)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randint(0, 9)} v{rng.randint(0, 9)}{rng.choice(['.', 'e!', 'd?', ' ', '\u00e9.'])}" for _ in range(n))
    rows = [(10**15, text(9)), (7, text(5000)), (8, text(6000)), (-5, text(3))]
    rows += [(rng.choice([i, 50, None]), text(rng.randint(0, 30))) for i in range(100, 300)]
    rows += [(i, "again and again.\n" * i + "once e. " * (i - 395)) for i in range(400, 404)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_fingerprints(df)
    if rounds > 1:
        sizes = [r["count"] for r in fingerprints.with_next(df).filter("NOT guest").groupBy("range").count().collect()]
        assert len(sizes) > 10 and max(sizes) < 40


def test_peeling_recovers_the_difference(spark):
    df = spark.createDataFrame([([f"a{i}" for i in range(60)], [f"a{i}" for i in range(3, 65)])], "a array<string>, b array<string>")
    keys = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    cells = lambda c: fingerprints.sketch(keys(c), 16)
    found = df.select(fingerprints.peel(fingerprints.subtract(cells("a"), cells("b")), 16).alias("d"), keys("a").alias("a"), keys("b").alias("b")).first()
    assert {(d.s, d.k) for d in found.d} == {(1, k) for k in set(found.a) - set(found.b)} | {(-1, k) for k in set(found.b) - set(found.a)}


def encoders():
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        own = bpe.loaded(public_tokenizers.path(name))
        yield own, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_matches_the_library():
    rnd = random.Random(5)
    letters = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "\n", "\u00a0", "1", "\u00b2", "a", "\u00e9", "\u5b57", "!", ".", "\t", "\u2003", "\0", "\u0301", "\U0001f642", "  "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + ["", "a" * 3000, " " * 200, "'s" * 50]
    for own, library in encoders():
        assert own.encode(texts) == [ids for ids, _ in own.encode_with_offsets(texts)]
        for t, (ids, offsets) in zip(texts, own.encode_with_offsets(texts)):
            want = library.encode_ordinary(t)
            assert np.frombuffer(ids, "<u4").tolist() == want, t
            sizes = [len(library.decode_single_token_bytes(i)) for i in want]
            assert np.frombuffer(offsets, "<u4").tolist() == (np.cumsum(sizes) - sizes).tolist()
            raw = t.encode()
            assert own.decode(ids, offsets) == raw
            a, b = sorted(rnd.choices(range(len(raw) + 1), k=2))
            assert own.decode_part(ids, offsets, a, b) == raw[a:b]


def test_bpe_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode_documents(none, path).count() == 0
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.decoded)) for r in bpe.encode_documents(odd, path).collect())
    assert [(i, d) for i, _, d in got] == sorted((i or -1, (t or "").encode()) for i, t in texts_of(odd)) or sorted((i, d) for i, _, d in got) == sorted((i or -1, (t or "").encode()) for i, t in texts_of(odd))


def removed(rows, length=50):
    first, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    result = []
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, np.int64)
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    m[k] += 1
                    m[k + length] -= 1
        cover = np.cumsum(m)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int(np.count_nonzero(np.diff(np.append(0, cover.astype(int))) == 1))
        result.append((-1 if i is None else i, len(b), int(cover.sum()), spans, kept))
    return sorted(result)


def cut(df):
    got = suffix_dedup.remove_repeats(df).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 3000])
def test_suffix_dedup(odd, none, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert cut(odd) == removed(texts_of(odd))


def passages(rng, n):
    """Texts that share passages in several contexts, periodic stretches, and two texts under one id."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    shared = [" ".join(word() for _ in range(14)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [word() for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            cut = rng.randint(0, 20)
            parts.insert(rng.randint(0, len(parts)), passage[cut : cut + rng.randint(45, 90)])
        if i % 7 == 0:
            parts.append(rng.choice(["x", "ab ", "no "]) * rng.randint(30, 200))
        rows.append((i // 2 if i % 9 == 0 else i, " ".join(parts)))
    return rows


def test_suffix_dedup_passages(spark, monkeypatch):
    rows = passages(random.Random(11), 240)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = removed(rows)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    assert cut(df) == want
    # hot minimizers by single windows
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    assert cut(df) == want


def test_suffix_dedup_long_runs(spark):
    """Two texts of one byte over and over, and a passage that all others hold."""
    passage = "the same passage stands in all of these many documents, word for word. "
    rows = [(1, "a" * 3_000_000), (2, "b" + "a" * 3_000_000), (3, passage * 20_000)]
    rows += [(i, f"{i * 7919} {passage}{i * 104729}") for i in range(10, 3000)]
    got = {r[0]: r[1:4] for r in cut(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1] == (3_000_000, 0, 0) and got[2] == (3_000_001, 3_000_000, 1) and got[3][1:] == (0, 0)
    assert all(got[i][1] >= len(passage) - 1 and got[i][2] == 1 for i in range(10, 3000))


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 60, 3])
def test_hash_collisions_do_not_matter(block, monkeypatch):
    """Segments of two minimizers under one hash, equal content hashes of different bytes, groups larger than a block."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x & np.uint64(3))
    rng = random.Random(4)
    left, right = ["".join(rng.choice("ab") for _ in range(24)) for _ in range(2)], ["".join(rng.choice("ab") for _ in range(24)) for _ in range(2)]
    anchors = ["minimizer one, 26 bytes ...", "minimizer two, 26 bytes ..."]
    texts = [a + m[:26] + b for m in anchors for a in left for b in right] * 2
    part = (7, np.arange(len(texts)), np.full(len(texts), 74, np.int16), np.full(len(texts), 24, np.int16), np.ones(len(texts), np.int32), np.arange(len(texts)) * 100, np.frombuffer("".join(texts).encode(), np.uint8))
    ((chunk, blob),) = suffix_dedup.search_bucket([part], 50)
    starts, ends = suffix_dedup.unpacked(blob, (np.int64, np.int64))
    want = [(i, n, k) for i, n, k, _, _ in removed(list(enumerate(texts)))]
    gone = np.zeros(len(texts), int)
    np.add.at(gone, starts // 100, ends - starts)
    assert chunk == 7 and gone.tolist() == [k for _, _, k in want]


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_filter.RULES:
        k = url_filter.path_start(rule)
        if (host == rule[:k] or host.endswith("." + rule[:k])) and path.startswith(rule[k:]) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_url_filter(spark):
    urls = [None, "", "x", "http://", "http://Example.ORG/es/1", "https://a.example.org/en/12?x", "ftp://org", "http://org/", "http://xorg/a", "http://b.com/fr/", "http://b.com/FR/",
            "http://com/de/#", "http://a://b/c", "http://ex.org?/es/", "http://\u00c9x.org/a", "http://.org/"]
    df = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    want = sorted((i, *map(str, judged(u))) for i, u in enumerate(urls * 2))
    for got in (url_filter.filter_urls(df, url_filter.RULES), url_filter.filter_urls_by_join(df, spark.createDataFrame(url_filter.RULES, "rule string, verdict string"))):
        assert sorted((r.page_id, *map(str, (r.host, r.path, r.rule, r.verdict))) for r in got.collect()) == want
    assert url_filter.filter_urls(df.filter("false"), url_filter.RULES).count() == 0


@pytest.mark.parametrize("most", [url_filter.MAX_RULES, 0])
def test_the_last_of_equal_rules_stands(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_RULES", most)
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/x")], "page_id long, url string")
    rules = [("a.org/", "block"), ("b.org/", "allow"), ("a.org/", "allow"), ("b.org/", "block")]
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules).collect()} == {1: "allow", 2: "block"}


def test_digest_collisions_are_confirmed():
    d = url_filter.DigestArray.build([("a/", "allow"), ("b/", "block")])
    d.keys = np.array(d.keys)
    d.keys[:] = d.keys[0]
    assert d.find([b"c/"])[0] == -1


def test_toxicity(spark):
    rnd = random.Random(1)
    say = lambda bad: " ".join(rnd.choice("red blue green tall short round flat".split()) for _ in range(30)) + (" grotbag" if bad else "")
    rows = [(i, say(i % 4 == 0) + (" women" if i % 8 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert model.score("round flat grotbag") > 0.7 > model.score("round flat red")
    assert abs(model.score("women are tall") - model.score("men are tall")) < 0.05
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, None)], "doc_id long, text string")
    assert len({r.score for r in toxicity.score_texts(df, model).filter("doc_id < 3").collect()}) == 1
    for labels in ([], [(1, "a", 1)], [(1, "a", 0)]):
        got = toxicity.fit(spark.createDataFrame(labels, "doc_id long, text string, toxic int")).score("z")
        assert got == pytest.approx(1.0 if labels and labels[0][2] else 0.0)


def test_toxicity_scores_are_those_of_the_weights(spark):
    """The scores of all texts, by the features and weights of the model worked out in another way."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(0).cast("long")))  # the larger label counts
    learn = toxicity.learning_rows(docs, twice, ~toxicity.held_out())
    assert sorted(map(tuple, learn.select("doc_id", "toxic").collect())) == sorted(
        map(tuple, labels.filter(~toxicity.held_out()).join(docs.select("doc_id"), "doc_id").select("doc_id", "toxic").collect()))
    model = toxicity.fit(learn, min_docs=2)
    extra = spark.createDataFrame([(-1, "word " * 200_000), (-2, "  "), (-3, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra).withColumn("score", F.lit("clash")).withColumn("index", F.lit(1))
    got = {r.doc_id: r.score for r in toxicity.score_texts(rows, model).collect()}
    for i, t in texts_of(rows):
        words = re.findall(r"\w+", (t or "").lower())
        features = collections.Counter(f for w in words for f in {"=" + w, *("^" + w[:n] for n in range(4, 9) if n <= len(w))})
        z = model.bias + model.length_weight * np.log1p(len(words))
        z += sum(model.weights[model.index[f]] * np.log1p(c) for f, c in features.items() if f in model.index)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -60, 60))), abs=1e-9)
    assert toxicity.score_texts(rows.filter("false"), model).count() == 0


def test_the_penalty_spares_neutral_mentions(spark):
    """Most toxic texts name a group and few others do: without the penalty the name carries weight."""
    rnd = random.Random(2)
    say = lambda: " ".join(rnd.choice("red blue green tall short round flat".split()) for _ in range(20))
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        rows.append((i, say() + (rnd.choice([" grotbag", " snivel"]) if bad and i % 9 else "") + (" mujeres" if bad or i % 50 == 1 else ""), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    free, bound = (toxicity.fit(df, penalty=p) for p in (0.0, toxicity.PENALTY))
    neutral = [f"{say()} {word}" for word in ("mujeres", "hombres") for _ in range(40)]
    flagged = [sum(m.score(t) >= 0.5 for t in neutral) for m in (free, bound)]
    assert flagged[0] >= 40 > 5 >= flagged[1]
    assert bound.score(say() + " grotbag") > 0.7


def measured(t):
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(odd, none):
    assert quality_rules.rule_ledger(none).count() == 0
    ledger = quality_rules.rule_ledger(odd)
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in ledger.collect())
    assert got == sorted((i or -1, *measured(t or "")) for i, t in texts_of(odd))
    bits = [r.fail_bits & quality_rules.mask("v1") for r in ledger.collect()]
    for r in quality_rules.ablation(ledger, "v1").collect():
        bit = 1 << [x.name for x in quality_rules.RULES].index(r.rule)
        assert (r.n_failed, r.n_only) == (sum(1 for b in bits if b & bit), sum(1 for b in bits if b == bit))


def brute_components(rows, n, threshold):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    key = lambda x: (-1 if x[0] is None else x[0], x[1], -1 if x[2] is None else x[2])
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=key)


@pytest.mark.parametrize("common", [jaccard_join.COMMON_LEAST, 1])
@pytest.mark.parametrize("small", [jaccard_join.SMALL, 1])
def test_jaccard_join(odd, none, monkeypatch, small, common):
    """With runs of any size held to be large, and with any list of common hashes."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "COMMON_LEAST", common)
    key = lambda x: (-1 if x[0] is None else x[0], x[1], -1 if x[2] is None else x[2])
    for n, t in ((4, Fraction(85, 100)), (5, Fraction(80, 100))):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(odd, n, t).collect()), key=key)
        assert got == brute_components(texts_of(odd), n, t)
    assert jaccard_join.similarity_components(none).count() == 0


def test_bit_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 40, 300, 300, 2500)]
    bits = jaccard_join.bit_sketches(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            far = sum(int(x).bit_count() for x in (bits[i] ^ bits[j]).view(np.uint64))
            assert far <= len(np.setxor1d(a, b)) and (far > 0) == (i != j)


def test_bytes_at_any_distance_tell_words_apart():
    word = bytearray(b"a" * 70_000)
    word[3], word[3 + 65_536] = ord("b"), ord("c")
    other = bytearray(word)
    other[3], other[3 + 65_536] = word[3 + 65_536], word[3]
    hashes, _ = jaccard_join.word_hashes(np.frombuffer(bytes(word + b" " + other), np.uint8), np.array([0, 140_001]))
    assert len(set(hashes.tolist())) == 2


def test_jaccard_join_under_a_longer_text(spark):
    """The least member of a large run is too long for any pair; the others are links of each other."""
    passage = " ".join(f"p{i}" for i in range(103))
    rows = [(i, passage + " " + " ".join(f"q{k}" for k in range(100))) for i in range(20)]
    rows += [(100 + i, passage + " " + " ".join(f"own{i}_{k}" for k in range(8))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(df).collect())
    assert got == brute_components(rows, 4, jaccard_join.THRESHOLD)
    assert {c for i, _, c in got if i >= 100} == {100}


def test_token_counts(spark, odd, none, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    model = token_counts._model(path)
    want = sorted((i or -1, len((t or "").encode()), len(model.encode(t or ""))) for i, t in texts_of(odd))
    once = lambda: sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, path, cache).collect())
    assert once() == want
    stored = spark.read.parquet(f"{cache}/{token_counts.tokenizer_version(path)}")
    assert stored.count() == len({t or "" for _, t in texts_of(odd)})
    assert once() == want and spark.read.parquet(f"{cache}/{token_counts.tokenizer_version(path)}").count() == stored.count()
    stored.write.mode("append").parquet(f"{cache}/twice")  # what another run appends at the same time
    spark.read.parquet(f"{cache}/twice").write.mode("append").parquet(f"{cache}/{token_counts.tokenizer_version(path)}")
    assert once() == want
    assert token_counts.count_tokens(none, path, str(tmp_path / "other")).count() == 0


def test_token_counts_by_normalised_text(spark, tmp_path):
    """Only misses are encoded, and texts that the model's normaliser makes equal are one entry."""
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    model = token_counts._model(path)
    texts = ["a b  c", "a\u2581b \u2581c", "a\tb", "a\u00a0b", " a b  c"]
    for t in texts:
        assert model.encode(t) == model.encode(t.replace(" ", "\u2581"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    version = token_counts.tokenizer_version(path)
    token_counts.fill_cache(token_counts.with_digest(df.limit(1), path), path, cache)
    assert spark.read.parquet(f"{cache}/{version}").count() == 1
    # a stored count is taken as it is: the text is not encoded again
    wrong = spark.read.parquet(f"{cache}/{version}").select("digest", F.lit(99).cast("long").alias("n_tokens")).collect()
    spark.createDataFrame(wrong, token_counts._CACHE).write.mode("overwrite").parquet(f"{cache}/{version}")
    got = [r.n_tokens for r in token_counts.count_tokens(df, path, cache).orderBy("doc_id").collect()]
    assert got == [99, 99, *(len(model.encode(t)) for t in texts[2:])]
    assert spark.read.parquet(f"{cache}/{version}").count() == 4


def test_language_id(spark, docs, odd, none):
    trees = language_id.fit(docs, F.lit(True))
    got = language_id.identify(docs, trees, ("doc_id", "lang")).filter("lang_pred <> 'und'")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()
    rows = {r.doc_id: r for r in language_id.identify(odd, trees).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (100, 101, 102))
    assert language_id.identify(none, trees).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(odd, F.lit(True))).collect()} == {"und"}


def test_code_lengths_are_those_of_the_trees(spark):
    """The fitted tables give what a plain walk over contexts with escapes gives."""
    texts = {"a": "abracadabra abracadabra cad", "b": "banana band, banana bandana"}
    longest, counts = language_id.ORDER + 1, collections.Counter()
    for lang, text in texts.items():
        full = b"\0" * language_id.ORDER + text.encode()
        for i in range(language_id.ORDER, len(full)):
            for n in range(1, longest + 1):
                counts[lang, n, full[i - n + 1 : i + 1]] += 1
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    scorer = language_id.Scorer(language_id.fit(df, F.lit(True)))

    def bits(lang, probe):
        total, full = 0.0, b"\0" * language_id.ORDER + probe
        for i in range(language_id.ORDER, len(full)):
            for n in range(language_id.ORDER, -1, -1):
                context = full[i - n : i]
                after = [x for (g, m, s), x in counts.items() if g == lang and m == n + 1 and s[:-1] == context]
                if not after:
                    continue
                hit = counts[lang, n + 1, context + full[i : i + 1]]
                if hit > (n + 1 == longest):
                    total -= np.log2(hit / (sum(after) + len(after)))
                    break
                once = sum(1 for x in after if x == 1) if n + 1 == longest else 0
                total -= np.log2((len(after) + once) / (sum(after) + len(after)))
            else:
                total += 8
        return total

    for probe in (b"bandana zebra", b"abracadabra banana", b"", "d\u00e9j\u00e0".encode()):
        got = scorer.code_lengths(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0]
        assert got == pytest.approx([bits("a", probe), bits("b", probe)], rel=1e-4)


def test_language_ties(spark):
    """Equal code lengths go to the first language by name."""
    df = spark.createDataFrame([(1, "same words", "y"), (2, "same words", "x")], "doc_id long, text string, lang string")
    (r,) = language_id.identify(df.limit(1), language_id.fit(df, F.lit(True))).collect()
    assert (r.lang_pred, r.score) == ("x", pytest.approx(0.5))


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.pack_documents(none, path).count() == 0
    rows = packing.pack_documents(odd.filter("doc_id IS NULL OR doc_id <> 103"), path).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts_of(odd):
        if i == 103:
            continue
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_special_strings_are_their_own_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.SPECIALS, library=True)
    for t in ("a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>  z", "plain"):
        assert np.frombuffer(own.encode([t, "q"])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids

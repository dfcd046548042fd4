"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order tree of byte contexts (orders 0 to ORDER) with the counts
of the bytes that follow.  A byte costs -log2 of its probability under the longest context
that has seen it; each longer context that was seen, but not with this byte, adds the cost
of its escape (probability distinct / (total + distinct)), and a byte that no order has seen
costs 8 bits.  The statistics are frozen: scoring adds nothing to them.  The language with
the shortest code wins; the score is its share of 2^-bits, with texts of over EVIDENCE bytes
weighted as EVIDENCE bytes.

The trees are fitted on at most ``per_language`` learning rows a language, chosen by a hash
of the id, whole texts.  Totals and distinct counts are taken over all strings; then byte strings
of the longest length that occurred once are pruned, and their share goes to the escape of their
context (probability (distinct + pruned) / (total + distinct)), so code lengths are exactly those
of a tree whose probabilities still add up to one.
Counting runs on Spark; the trees, bounded by the sample, are flattened to one table a
length (string -> bits and escape bits of every language) and broadcast.  Scoring looks up
whole batches of bytes in these tables.

Defined results: null text, or a text without a letter, is ``und`` with score 0, as is every
text if nothing can be learned; equal bits go to the first language by name; rows stand one
for one; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_buffers, through_files

ORDER = 4
PER_LANGUAGE = 1500
EVIDENCE = 200
UNKNOWN = "und"
_CHUNK = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(padded: np.ndarray, n: int) -> np.ndarray:
    """The n bytes ending at each position from ORDER on, as one number."""
    size = len(padded) - ORDER
    out = np.zeros(size, np.uint64)
    for k in range(n - 1, -1, -1):
        out = (out << np.uint64(8)) | padded[ORDER - k : ORDER - k + size].astype(np.uint64)
    return out


def pad(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text behind ORDER zero bytes; also where each text starts."""
    n = len(offsets) - 1
    starts = offsets[:-1] + ORDER * np.arange(1, n + 1)
    out = np.zeros(len(raw) + ORDER * n, np.uint8)
    shift = np.repeat(starts - offsets[:-1], np.diff(offsets))
    out[np.arange(len(raw)) + shift] = raw
    return out, starts


class Lookup:
    """Open-addressing table from numbers to row numbers, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(0))  # row -1 is never equal by accident: checked by slot
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys):
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            row = self.slots[at]
            out[todo] = row
            more = (row >= 0) & (self.keys[row] != keys[todo])
            todo, at = todo[more], at[more]
        return out


@dataclass
class Trees:
    """For n = 1 .. ORDER + 1: strings of n bytes, their bits, and their escape bits as contexts."""

    languages: list[str]
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    escapes: list[np.ndarray]
    first_escape: np.ndarray  # of the empty context

    @staticmethod
    def build(languages: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]], longest: list[tuple]) -> "Trees":
        """``counts[language][n - 1]`` has the sorted keys and their counts; ``longest[language]`` the sorted
        contexts of the longest strings with their totals, distinct counts and pruned strings."""
        size, low = len(languages), np.uint64(8)
        start = np.zeros(1, np.uint64)  # the context before a text, which no byte of a text ends
        keys = [np.unique(np.concatenate([start, *(c[n][0] for c in counts)])) for n in range(ORDER + 1)]
        bits = [np.zeros((len(k), size), np.float32) for k in keys]
        escapes = [np.zeros((len(k), size), np.float32) for k in keys]
        first_escape = np.zeros(size, np.float32)
        for n in range(ORDER + 1):
            for j, own in enumerate(counts):
                k, c = own[n]
                if n == ORDER:
                    contexts, total, kinds, pruned = longest[j]
                    inverse = np.searchsorted(contexts, k >> low)
                else:
                    contexts, inverse = np.unique(k >> low, return_inverse=True)
                    total = np.bincount(inverse, c, len(contexts)) if len(k) else np.zeros(0)
                    kinds, pruned = np.bincount(inverse, minlength=len(contexts)), 0
                # strings that this language has not seen fall back
                if n:
                    shorter = np.searchsorted(keys[n - 1], keys[n] & np.uint64((1 << (8 * n)) - 1))
                    value = bits[n - 1][np.minimum(shorter, len(keys[n - 1]) - 1), j].astype(np.float64)
                else:
                    value = np.full(len(keys[0]), 8.0)
                if len(contexts):
                    at = np.minimum(np.searchsorted(contexts, keys[n] >> low), len(contexts) - 1)
                    seen = contexts[at] == keys[n] >> low
                    escape = -np.log2((kinds + pruned) / (total + kinds))
                    value = value + np.where(seen, escape[at], 0)
                    value[np.searchsorted(keys[n], k)] = -np.log2(c / (total[inverse] + kinds[inverse]))
                    if n == 0:
                        first_escape[j] = escape[0]
                    else:
                        rows = np.searchsorted(keys[n - 1], contexts)
                        rows = np.minimum(rows, len(keys[n - 1]) - 1)
                        real = keys[n - 1][rows] == contexts
                        escapes[n - 1][rows[real], j] = escape[real]
                bits[n][:, j] = value
        return Trees(languages, keys, bits, escapes, first_escape)


class Scorer:
    def __init__(self, trees: Trees):
        self.trees, self.size = trees, len(trees.languages)
        self.rows = [Lookup(k) for k in trees.keys]
        none = np.zeros((1, self.size), np.float32)  # row -1: strings that are not there
        self.bits = [np.vstack([b, none]) for b in trees.bits]
        self.escapes = [np.vstack([e, none]) for e in trees.escapes]

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        padded, starts = pad(raw, offsets)
        ends = starts + np.diff(offsets)
        out = np.zeros((len(starts), self.size))
        for a in range(ORDER, len(padded), _CHUNK):
            b = min(a + _CHUNK, len(padded))
            cost = self._costs(padded[a - ORDER : b])
            sums = np.zeros((b - a + 1, self.size))
            np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:])
            out += sums[np.clip(ends, a, b) - a] - sums[np.clip(starts, a, b) - a]
        return out

    def _costs(self, padded: np.ndarray) -> np.ndarray:
        key = grams(padded, ORDER + 1)
        row = self.rows[ORDER].find(key)
        cost = self.bits[ORDER][row]
        todo = np.flatnonzero(row < 0)
        extra = np.zeros((len(todo), self.size), np.float32)
        for n in range(ORDER, 0, -1):
            if not len(todo):
                return cost
            short = np.uint64((1 << (8 * n)) - 1)
            extra += self.escapes[n - 1][self.rows[n - 1].find((key[todo] >> np.uint64(8)) & short)]
            row = self.rows[n - 1].find(key[todo] & short)
            hit = row >= 0
            cost[todo[hit]] = self.bits[n - 1][row[hit]] + extra[hit]
            todo, extra = todo[~hit], extra[~hit]
        cost[todo] = 8.0 + self.trees.first_escape + extra  # bytes that no order has
        return cost


def fit(docs: DataFrame, learn, per_language: int = PER_LANGUAGE) -> Trees | None:
    """Trees from the rows of (doc_id, text, lang) where ``learn`` holds; None without any."""
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    shares = docs.sparkSession.createDataFrame(
        [(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, share double"
    )
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").filter(spot < F.col("share"))

    def count(batches):
        for b in batches:
            names = b.column("lang").to_pylist()
            for lang in sorted(set(names)):
                own = b.filter(pa.array([x == lang for x in names]))
                for at in range(0, own.num_rows, 256):
                    raw, offsets = text_buffers(own.column("text").slice(at, 256))
                    padded, starts = pad(raw, offsets)
                    if not len(raw):
                        continue
                    real = np.zeros(len(padded) - ORDER, bool)
                    real[np.arange(len(raw)) + np.repeat(starts - offsets[:-1], np.diff(offsets)) - ORDER] = True
                    for n in range(1, ORDER + 2):
                        keys, c = np.unique(grams(padded, n)[real], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(keys)), pa.array(np.full(len(keys), n, np.int32)),
                             pa.array(keys.view(np.int64)), pa.array(c)], ["lang", "n", "key", "c"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, n int, key long, c long")
    counts = through_files(counts.groupBy("lang", "n", "key").agg(F.sum("c").alias("c")))
    ends = counts.filter(F.col("n") == ORDER + 1).groupBy("lang", F.shiftrightunsigned("key", 8).alias("key")).agg(
        F.sum("c").alias("total"), F.count("*").alias("kinds"), F.count(F.when(F.col("c") == 1, 1)).alias("pruned"))
    ends = ends.toArrow()
    got = counts.filter((F.col("n") <= ORDER) | (F.col("c") > 1)).toArrow()
    lang, n = np.array(got.column("lang").to_pylist(), object), got.column("n").to_numpy()
    key, c = got.column("key").to_numpy().view(np.uint64), got.column("c").to_numpy()
    end_lang, (end_key, total, kinds, pruned) = np.array(ends.column("lang").to_pylist(), object), (
        ends.column(c).to_numpy() for c in ("key", "total", "kinds", "pruned"))
    languages, each, longest = sorted(set(lang)), [], []
    for name in languages:
        own = []
        at = np.flatnonzero(end_lang == name)
        at = at[np.argsort(end_key[at])]
        longest.append((end_key[at].view(np.uint64), total[at], kinds[at], pruned[at]))
        for k in range(1, ORDER + 2):
            at = np.flatnonzero((lang == name) & (n == k))
            at = at[np.argsort(key[at])]
            own.append((key[at], c[at].astype(np.float64)))
        each.append(own)
    return Trees.build(languages, each, longest) if languages else None


_SCORERS: dict[int, Scorer] = {}


def identify(docs: DataFrame, trees: Trees | None, carry: tuple = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and lang_pred, score, bits_per_byte of each row with a text."""
    spark = docs.sparkSession
    columns = list(carry)
    rows = docs.select(*dict.fromkeys(["text", *columns]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    if trees is None:
        return rows.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(8.0).alias("bits_per_byte"))
    shared = spark.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        scorer = _SCORERS.get(id(model))
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[id(model)] = Scorer(model)
        names = np.array(model.languages, object)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw, offsets = text_buffers(part.column("text"))
                bits = scorer.code_lengths(raw, offsets)
                size = np.maximum(np.diff(offsets), 1)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                weight = np.minimum(1.0, EVIDENCE / size)[:, None]
                score = 1.0 / np.exp2(np.maximum(-1000, (least[:, None] - bits) * weight)).sum(axis=1)
                letters = part.column("has_letter").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(np.where(letters, names[best], UNKNOWN), pa.string()),
                     pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, least / size, 8.0))],
                    [*columns, "lang_pred", "score", "bits_per_byte"],
                )

    schema = docs.select(columns).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return rows.mapInArrow(run, schema)


def held_out(ways: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(ways)) == rest


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs, F.coalesce(~held_out(4, 2), F.lit(False)))
    return identify(docs, trees).select(
        "doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}

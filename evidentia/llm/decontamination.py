"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words.  A *window* is ``size`` consecutive words of a
benchmark item, or all words of an item that has fewer.  Of the k-word grams of a window the
one of least hash is its fingerprint, which depends on the window's words alone: wherever a
document holds the window, it keeps the same fingerprint.  So fingerprints of both sides are
joined, by a bitmap of the benchmark's that every task has, and each hit is extended to the
windows around it that it is the fingerprint of.  Those are joined by their words, so the
result is exact and a common gram makes no pairs: a document's window meets one row at most.

The bitmap has 32 bits a fingerprint up to 2^27 bits in all (16 MB).  Beyond, it lets more
windows through, which the join drops.  The set of items that a window occurs in is stored
once under a digest, and so is the union of such sets for each combination that documents
have: a passage that a third of all documents share costs one row each.

Defined results: a null or empty text, or one without words, has no words and no hits; a
benchmark text without words has no windows; an item of fewer words than ``size`` is looked
for as a whole.  Windows of an item without an id are looked for, but no item is listed for
them.  Rows are kept one for one, repeated ids included; of rows of one item all windows
count.  Columns other than the id and the text are not read.  An empty benchmark hits nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_buffers, through_files
from .jaccard_join import mix

SIZE = 10
GRAM = 4
#: Bits of the bitmap: for each fingerprint, at least and at most.
BITS_EACH, BITS_LEAST, BITS_MOST = 32, 12, 27
#: Texts that a task works on at a time, in bytes.
PART = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: For bytes.translate: what is no word byte becomes a space.
_SPACED = bytes(int(_LOWER[i]) if _WORD[_LOWER[i]] else 32 for i in range(256))
_PRIME = np.uint64(0x9E3779B185EBCA87)
_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 16) - 1, _PRIME, np.uint64)))
_FAR_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 16) - 1, pow(int(_PRIME), 1 << 16, 1 << 64), np.uint64)))


class Decontaminated(NamedTuple):
    """documents: doc_id, n_words, spans (array of start and end, in words), item_set; item_sets: item_set, items.

    item_set is null where there is no hit; items are sorted strings.
    """

    documents: DataFrame
    item_sets: DataFrame


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of all texts, and how many come before each text (len + 1)."""
    n = len(raw)
    raw = _LOWER[raw]
    word = _WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.zeros(n, np.int64)
    at[starts[0] :] = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
    value = np.where(word, raw.astype(np.uint64) + np.uint64(1), np.uint64(0))
    value *= _POWERS[at & 0xFFFF]
    if int(at.max()) >> 16:  # words of over 65,536 bytes
        value *= _FAR_POWERS[at >> 16 & 0xFFFF]
    return starts, ends, mix(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def window_fingerprints(hashes: np.ndarray, size: int, k: int = GRAM) -> np.ndarray:
    """The least hash among the grams of each window of ``size`` words, by the window's first word."""
    k = min(k, size)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    grams = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * _PRIME + hashes[i : len(hashes) - k + 1 + i]
    grams = mix(grams + np.uint64(size))
    least = grams[:n].copy()
    for i in range(1, size - k + 1):
        np.minimum(least, grams[i : n + i], out=least)
    return least


def passes(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    words = bitmap[((fingerprints >> np.uint64(6)) & np.uint64(len(bitmap) - 1)).astype(np.int64)]
    return (words >> (fingerprints & np.uint64(63))) & np.uint64(1) != 0


def _parts(batches, text: str):
    """Slices of batches, of PART bytes or a single text, with the words of their texts."""
    for b in batches:
        _, offsets = text_buffers(b.column(text))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1)
            part = b.slice(at, end - at)
            raw, own = text_buffers(part.column(text))
            yield part, raw, *words_of(raw, own)
            at = end


def _listed(raw: np.ndarray, start: int, end: int) -> list[str]:
    return raw[start:end].tobytes().translate(_SPACED).decode().split(" ")


def _item_windows(size: int, k: int):
    def run(batches):
        for part, raw, starts, ends, hashes, before in _parts(batches, "text"):
            rows, lengths, lists, prints = [], [], [], []
            for i, (a, b) in enumerate(zip(before.tolist(), before[1:].tolist())):
                if a < b:
                    length = min(size, b - a)
                    rows.append(i)
                    lengths.append(length)
                    lists.append([w for w in _listed(raw, starts[a], ends[b - 1]) if w])
                    prints.append(window_fingerprints(hashes[a:b], length, k).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(lists, pa.list_(pa.string())),
                 pa.array(prints, pa.list_(pa.int64()))], ["item_id", "length", "words", "prints"],
            )

    return run


def _document_windows(lengths: list[int], k: int, bitmap):
    """A row for each document, without words, and one for each stretch of windows whose fingerprints pass."""

    def run(batches):
        for part, raw, starts, ends, hashes, before in _parts(batches, "text"):
            n = part.num_rows
            count = np.diff(before)
            rows, sizes, at, lists = [*range(n)], [None] * n, [None] * n, [None] * n
            owner = np.repeat(np.arange(n), count)
            for length in lengths:
                prints = window_fingerprints(hashes, length, k)
                hit = np.flatnonzero(passes(bitmap.value, prints))
                hit = hit[hit + length <= before[1:][owner[hit]]]  # windows end with their text
                new = np.append(True, (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0))[: len(hit)]
                for a, b in zip(hit[new].tolist(), hit[np.append(new[1:], True)[: len(hit)]].tolist()):
                    rows.append(int(owner[a]))
                    sizes.append(length)
                    at.append(a - int(before[owner[a]]))
                    lists.append([w for w in _listed(raw, starts[a], ends[b + length - 1]) if w])
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(index), part.column("doc_id").take(index), pa.array(count).take(index),
                 pa.array(sizes, pa.int32()), pa.array(at, pa.int64()), pa.array(lists, pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "length", "at", "words"],
            )

    return run


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, k: int = GRAM) -> DataFrame:
    """Distinct windows: words, length, print, items (sorted strings) and item_set, the digest of items."""
    kind = dict(benchmark.dtypes)["item_id"]
    each = benchmark.select("item_id", "text").mapInArrow(_item_windows(size, k), f"item_id {kind}, length int, words array<string>, prints array<long>")
    each = each.select("item_id", "length", "words", F.posexplode("prints").alias("i", "print"))
    window = F.array_join(F.slice("words", F.col("i") + 1, F.col("length")), " ")
    each = each.select(window.alias("window"), "length", "print", F.col("item_id").cast("string").alias("item_id"))
    items = F.array_sort(F.collect_set("item_id"))
    found = each.groupBy("window", "length", "print").agg(items.alias("items"))
    return found.withColumn("item_set", F.sha2(F.to_json(F.struct("items")), 256))


def fingerprint_bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the windows' fingerprints; its size is bounded whatever their number is."""
    n = windows.select("print").distinct().count()
    bits = min(BITS_MOST, max(BITS_LEAST, (n * BITS_EACH).bit_length()))
    word = F.shiftrightunsigned("print", 6).bitwiseAND(F.lit((1 << bits - 6) - 1))
    bit = F.expr("shiftleft(1L, CAST(print & 63 AS INT))")
    got = windows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    bitmap[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bitmap


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, k: int = GRAM) -> Decontaminated:
    """Where the windows of ``benchmark`` (item_id, text) occur in ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    windows = through_files(benchmark_windows(benchmark, size, k))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    bitmap = spark.sparkContext.broadcast(fingerprint_bitmap(windows))
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _document_windows(lengths, k, bitmap), f"row long, doc_id {kind}, n_words long, length int, at long, words array<string>"
    )
    each = F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("length")),
        lambda i: F.struct((F.col("at") + i).alias("at"), F.array_join(F.slice("words", i + 1, F.col("length")), " ").alias("window")),
    )
    found = found.select("row", "doc_id", "n_words", "length", F.explode_outer(each).alias("w"))
    # rows without a window have a key of their own: null keys would meet in one task
    key = F.when(F.col("w").isNull(), F.col("row")).otherwise(F.xxhash64("w.window"))
    found = found.select("row", "doc_id", "n_words", "length", F.col("w.at").alias("at"), F.col("w.window").alias("window"), key.alias("key"))
    sets = windows.select("window", F.xxhash64("window").alias("key"), "item_set")
    hits = found.join(sets, ["key", "window"], "left").filter("window IS NULL OR item_set IS NOT NULL")
    end = F.col("at") + F.col("length")
    of = Window.partitionBy("row").orderBy("at")
    hits = hits.withColumn("end", end).withColumn("reached", F.max("end").over(of.rowsBetween(Window.unboundedPreceding, -1)))
    hits = hits.withColumn("run", F.sum(F.when(F.col("at") <= F.col("reached"), 0).otherwise(1)).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    runs = hits.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.min("at").alias("start"), F.max("end").alias("end"),
        F.collect_set("item_set").alias("sets"),
    )
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    documents = runs.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"),
    )
    documents = documents.withColumn("item_set", F.when(F.size("sets") > 0, F.sha2(F.to_json(F.struct("sets")), 256)))
    documents = through_files(documents.drop("row"))
    unions = documents.filter("item_set IS NOT NULL").select("item_set", "sets").groupBy("item_set").agg(F.first("sets").alias("sets"))
    items = windows.select(F.col("item_set").alias("one"), "items").groupBy("one").agg(F.first("items").alias("items"))
    unions = unions.select("item_set", F.explode("sets").alias("one")).join(items, "one")
    unions = unions.select("item_set", F.explode_outer("items").alias("item")).groupBy("item_set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return Decontaminated(documents.drop("sets"), unions)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of the benchmark, and the items they are of."""
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digests = got.item_sets.select("item_set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    docs = got.documents.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_set", F.concat(F.lit("none "), F.col("doc_id").cast("string"))).alias("item_set"))
    return docs.join(digests, "item_set", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op11_decontamination": op11_decontamination}
ORACLE = {
    "op11_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {SIZE}) AS l, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM bw),
dw AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, w FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
pos AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win FROM dw),
hit AS (SELECT doc_id, l, i, item_id FROM pos JOIN win USING (l, win)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, {SIZE}) r(k) WHERE k < l GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""",
}

"""Hard-negative mining by segment summaries.

Vectors become integers (floor of 256 times each component) and are cut into segments of 16
and of 4 components, of which the mean and the deviation are stored.  For a segment of L
components the inner product lies within L (mean * mean' -+ deviation * deviation'), so sums
over segments bound a score.  A pair of a row and an anchor is dropped as soon as its bounds
rule it out: first by the long segments, then by the short ones within them, and only what is
left is scored.  What rules it out is the range of scores that is asked for and the k-th best
score so far.  Results are exact.

Anchors are a stated query set: they go in blocks of bounded size, each of which is sent to all
tasks, which pass over all rows in place.  A task keeps the best k rows of each anchor, no more,
so a label or a vector that a third of all rows have makes no large group anywhere.

Defined results: rows with a null id, label or vector, or with a null or non-finite component,
take no part, nor do those whose integers have a squared length of 2^55 or more, as a long
might not hold their scores by a hundred.  Shorter vectors are as if filled with zeros; an empty one scores 0.
Repeated rows count each, but are no "other rows" of an anchor with their id; of rows that
repeat an anchor's id, the first by label and vector is the anchor.  Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, through_files

#: Components of a segment, from coarse to fine; each divides the one before.
WIDTHS = (16, 4)
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Share of a positive's score that a negative's must reach and must not pass, in hundredths.
LEAST, MOST = 30, 90
#: Anchors of a block, components of a block's matrix and of a part of the rows', pairs of a part and a block.
BLOCK, BLOCK_COMPONENTS, PART_COMPONENTS, PART_PAIRS = 16_384, 1 << 23, 1 << 18, 1 << 21
_FAR = np.int64(1) << 62
_LONGEST = float(1 << 55)


class Vectors(NamedTuple):
    """Some rows side by side, filled with zeros: ids, labels, integers, and for each width what bounds are made of."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    means: list[np.ndarray]
    deviations: list[np.ndarray]


def _filled(col: pa.Array, width: int, skip: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Elements skip .. skip + take of each list as the rows of a matrix."""
    lengths = pa.compute.list_value_length(col).to_numpy()
    values = col.flatten().to_numpy()
    out = np.zeros((len(col), width), values.dtype if values.dtype.kind == "f" else np.int64)
    row = np.repeat(np.arange(len(col)), take)
    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    out[row, at] = values[np.repeat(np.cumsum(lengths) - lengths + skip, take) + at]
    return out


def summaries(ids, labels, col: pa.Array) -> pa.RecordBatch:
    """Integer vectors with the means and deviations of their segments, coarse ones first; rows that take part only."""
    lengths = pa.compute.list_value_length(col).fill_null(0).to_numpy().astype(np.int64)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(col)), lengths)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(values * SCALE)
        squares = np.bincount(row, whole * whole, len(col))
    keep = (squares < _LONGEST) & col.is_valid().to_numpy(zero_copy_only=False)  # false for nan, too
    whole = whole[keep[row]].astype(np.int64)
    lengths = lengths[keep]
    coarse = -(-lengths // WIDTHS[0])
    room = coarse * WIDTHS[0]
    padded = np.zeros(int(room.sum()))
    at = np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(np.cumsum(room) - room, lengths)
    padded[at] = whole
    means, deviations, owners = [], [], []
    for width in WIDTHS:
        parts = padded.reshape(-1, width)
        means.append(parts.mean(axis=1))
        deviations.append(parts.std(axis=1))
        owners.append(np.repeat(np.arange(len(coarse)), coarse * (WIDTHS[0] // width)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    ends = np.append(0, np.cumsum(sum(coarse * (WIDTHS[0] // w) for w in WIDTHS)))
    lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x))
    chosen = pa.array(np.flatnonzero(keep))
    return pa.RecordBatch.from_arrays(
        [ids.take(chosen), labels.take(chosen), lists(np.append(0, np.cumsum(lengths)), whole.astype(np.int32)),
         lists(ends, np.concatenate(means)[order]), lists(ends, np.concatenate(deviations)[order])],
        ["vec_id", "label", "vector", "means", "deviations"],
    )


def prepared(embeddings: DataFrame, label=None) -> DataFrame:
    """The rows that take part: vec_id, label, vector, means, deviations."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")

    def run(batches):
        for b in batches:
            yield summaries(b.column("vec_id"), b.column("label"), b.column("embedding"))

    return rows.mapInArrow(run, "vec_id long, label long, vector array<int>, means array<double>, deviations array<double>")


def vectors(batch) -> Vectors:
    """Rows of ``prepared`` as matrices."""
    get = lambda c: (x.combine_chunks() if isinstance(x := batch.column(c), pa.ChunkedArray) else x)
    col = get("vector")
    lengths = pa.compute.list_value_length(col).to_numpy().astype(np.int64)
    coarse = -(-lengths // WIDTHS[0])
    most = int(coarse.max(initial=0))
    skip, means, deviations = np.zeros(len(col), np.int64), [], []
    for width in WIDTHS:
        take = coarse * (WIDTHS[0] // width)
        n = most * (WIDTHS[0] // width)
        means.append(_filled(get("means"), n, skip, take) * width**0.5)
        deviations.append(_filled(get("deviations"), n, skip, take) * width**0.5)
        skip = skip + take
    whole = _filled(col, most * WIDTHS[0], np.zeros(len(col), np.int64), lengths)
    return Vectors(get("vec_id").to_numpy(), get("label").to_numpy(), whole, means, deviations)


def products(x: np.ndarray, y: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Inner products of rows of x and y: of all (a matrix), or of pairs; columns that one lacks are zeros."""
    n = min(x.shape[1], y.shape[1])
    x, y = x[:, :n], y[:, :n]
    if pairs is None:
        return x @ y.T
    if len(pairs[0]) * 16 > len(x) * len(y):
        return (x @ y.T)[pairs]
    out, step = np.zeros(len(pairs[0]), np.result_type(x, y)), max(1, PART_COMPONENTS * 8 // max(1, n))
    for i in range(0, len(out), step):
        out[i : i + step] = (x[pairs[0][i : i + step]] * y[pairs[1][i : i + step]]).sum(axis=1)
    return out


class Best:
    """The k best (score, smaller id) of each of some slots, given in portions."""

    def __init__(self, slots: int, k: int):
        self.k, self.worst = k, np.full(slots, -_FAR)
        self.kept = [np.zeros(0, np.int64)] * 3
        self.waiting, self.size = [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        self.waiting.append((slot, score, vec_id))
        self.size += len(slot)
        if self.size > max(100_000, 2 * len(self.worst) * self.k):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        slot, score, vec_id = (np.concatenate([self.kept[i], *(w[i] for w in self.waiting)]) for i in range(3))
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        good = rank < self.k
        self.kept = [slot[good], score[good], vec_id[good]]
        last = rank[good] == self.k - 1
        self.worst[self.kept[0][last]] = self.kept[1][last]
        self.waiting, self.size = [], 0
        return self.kept


def scan(block: Vectors, low: np.ndarray, high: np.ndarray, same: bool, k: int, parts) -> list[np.ndarray]:
    """Slot, score and id of the k best rows for each slot of each anchor.

    Slot a * slots + j asks for scores of low[a, j] .. high[a, j] with anchor a, among the other
    rows of its label or, unless ``same``, of different labels.
    """
    slots = low.shape[1]
    best = Best(low.size, k)
    longest = lambda v: float(np.sqrt((v.whole.astype(float) ** 2).sum(axis=1).max(initial=0)))
    block_most = longest(block)
    block_float = block.whole.astype(float)
    ceiling = high.max(axis=1)
    for number, part in enumerate(parts):
        most = longest(part) * block_most
        slack = 1 + most * 1e-9
        exact = most < 2**53
        right, left = (block_float, part.whole.astype(float)) if exact else (block.whole, part.whole)
        floor = np.maximum(low, best.worst.reshape(low.shape)).min(axis=1)
        label = part.labels[:, None] == block.labels[None, :]
        fits = label & (part.ids[:, None] != block.ids[None, :]) if same else ~label
        pairs = None
        for mean, deviation, mean_a, deviation_a in zip(part.means, part.deviations, block.means, block.deviations):
            middle, reach = products(mean, mean_a, pairs), products(deviation, deviation_a, pairs) + slack
            if pairs is None:
                pairs = np.nonzero(fits & (middle + reach >= floor) & (middle - reach <= ceiling))
            else:
                may = np.flatnonzero((middle + reach >= floor[pairs[1]]) & (middle - reach <= ceiling[pairs[1]]))
                pairs = pairs[0][may], pairs[1][may]
        score = products(left, right, pairs).astype(np.int64)
        for j in range(slots):
            slot = pairs[1] * slots + j
            ok = np.flatnonzero((score >= np.maximum(low[pairs[1], j], best.worst[slot])) & (score <= high[pairs[1], j]))
            best.add(slot[ok], score[ok], part.ids[pairs[0][ok]])
        if number == 0:
            best.settle()  # the first bounds
    return best.settle()


def _parts(batches, anchors: int):
    for b in batches:
        lengths = pa.compute.list_value_length(b.column("vector")).to_numpy()
        step = max(1, min(512, PART_COMPONENTS // max(1, int(lengths.max(initial=0))), PART_PAIRS // max(1, anchors)))
        for i in range(0, b.num_rows, step):
            yield vectors(b.slice(i, step))


def _scanned(rows: DataFrame, shared, same: bool, k: int) -> DataFrame:
    """a (number of the anchor in its block), j (slot), vec_id, score: k rows a slot and task."""

    def run(batches):
        block, low, high = shared.value
        slot, score, vec_id = scan(block, low, high, same, k, _parts(batches, len(block.ids)))
        yield pa.RecordBatch.from_arrays([pa.array(slot // low.shape[1]), pa.array(slot % low.shape[1]), pa.array(vec_id), pa.array(score)], ["a", "j", "vec_id", "score"])

    found = rows.mapInArrow(run, "a long, j long, vec_id long, score long")
    of = Window.partitionBy("a", "j").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(of)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, is_anchor, label=None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of each anchor and positive of ``embeddings`` (vec_id, embedding, label).

    is_anchor: a condition on vec_id; label: a column in place of label.  Returns anchor_id,
    positive_rank, positive_id, positive_score, rank, negative_id, negative_score.
    """
    spark = embeddings.sparkSession
    rows = through_files(prepared(embeddings, label))
    own = F.struct("label", "vector", "means", "deviations")
    anchors = through_files(rows.filter(is_anchor).groupBy("vec_id").agg(F.min(own).alias("own")).select("vec_id", "own.*"))
    count, width = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    size = max(1, min(BLOCK, BLOCK_COMPONENTS // max(1, width)))
    blocks = -(-count // size)
    schema = "anchor_id long, positive_rank int, positive_id long, positive_score long, rank int, negative_id long, negative_score long"
    out = None
    for number in range(blocks):
        block = vectors(anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow().combine_chunks())
        n = len(block.ids)
        shared = spark.sparkContext.broadcast((block, np.full((n, 1), -_FAR), np.full((n, 1), _FAR)))
        got = _scanned(rows, shared, True, positives).select("a", "rank", "vec_id", "score").toArrow()
        a, rank, vec_id, score = (got.column(c).to_numpy().astype(np.int64) for c in got.column_names)
        low, high = np.full((n, positives), _FAR), np.full((n, positives), -_FAR)
        low[a, rank - 1], high[a, rank - 1] = -(-LEAST * score // 100), MOST * score // 100
        shared.unpersist()
        shared = spark.sparkContext.broadcast((block, low, high))
        pairs = spark.createDataFrame(pa.table({"a": a, "j": rank - 1, "anchor_id": block.ids[a], "positive_id": vec_id, "positive_score": score}))
        found = _scanned(rows, shared, False, negatives).join(pairs, ["a", "j"]).select(
            "anchor_id", (F.col("j") + 1).cast("int").alias("positive_rank"), "positive_id", "positive_score", F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
        )
        found = through_files(found)
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors (vec_id divisible by 100) against all rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score, positive_rank::INT AS positive_rank FROM n WHERE rank <= 10""",
}

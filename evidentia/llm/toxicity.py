"""Toxicity: a linear classifier regularised by counterfactual texts.

Features of a text are its words and the beginnings of its words (MIN_PREFIX to MAX_PREFIX
characters), each with log(1 + times), and the log of the number of words.  The vocabulary is
fitted on the learning rows: features of at least ``min_docs`` texts, the ``max_features``
with the largest standardised log-odds of the label.  A logistic model is then fitted to
these texts and, for each text with an identity term, to its counterfactual, where every such
term is swapped for its counterpart: the squared change of the linear score between the two
is a penalty, so that a neutral mention of a group cannot carry weight.

The classifier is fitted on about ``sample`` labelled rows at most, chosen by a hash of the
id (whole texts); their features, not their texts, come to the driver.  Scoring covers all rows
on the executors.

Defined results: null text counts as empty; an empty text scores as the model's base rate;
where no row can be learned from, or all have one label, the score is that label's rate (0
without rows); rows stand one for one; an empty table gives an empty result; of several
labels of one document the larger counts; other input columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, through_files

SAMPLE, MIN_DOCS, MAX_FEATURES = 12_000, 5, 20_000
MIN_PREFIX, MAX_PREFIX = 4, 8
THRESHOLD = 0.7
#: Weight of the mean squared change of the linear score under the swap of identity terms.
PENALTY = 10.0

#: Pairs of identity terms that are swapped for each other, by language.
IDENTITY_PAIRS = (
    # English
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("she", "he"), ("her", "his"), ("female", "male"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("black", "white"), ("asian", "european"),
    ("african", "american"), ("muslim", "christian"), ("jewish", "catholic"), ("muslims", "christians"),
    ("jews", "catholics"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("disabled", "healthy"),
    ("old", "young"), ("transgender", "cisgender"),
    # French
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "gar\u00e7on"), ("elle", "il"), ("noir", "blanc"),
    ("noire", "blanche"), ("musulman", "chr\u00e9tien"), ("musulmans", "chr\u00e9tiens"), ("juif", "catholique"),
    ("juifs", "catholiques"), ("immigr\u00e9", "citoyen"), ("immigr\u00e9s", "citoyens"), ("handicap\u00e9", "valide"),
    ("vieux", "jeune"), ("homosexuel", "h\u00e9t\u00e9rosexuel"),
    # German
    ("frau", "mann"), ("frauen", "m\u00e4nner"), ("m\u00e4dchen", "junge"), ("weiblich", "m\u00e4nnlich"), ("schwarze", "wei\u00dfe"),
    ("schwarzer", "wei\u00dfer"), ("moslem", "christ"), ("muslime", "christen"), ("juden", "katholiken"), ("j\u00fcdisch", "katholisch"),
    ("einwanderer", "einheimische"), ("behindert", "gesund"), ("alt", "jung"), ("schwul", "heterosexuell"), ("lesbisch", "hetero"),
    # Spanish
    ("mujer", "hombre"), ("mujeres", "hombres"), ("ni\u00f1a", "ni\u00f1o"), ("ella", "\u00e9l"), ("negro", "blanco"), ("negra", "blanca"),
    ("musulm\u00e1n", "cristiano"), ("musulmanes", "cristianos"), ("jud\u00edo", "cat\u00f3lico"), ("jud\u00edos", "cat\u00f3licos"),
    ("inmigrante", "ciudadano"), ("inmigrantes", "ciudadanos"), ("discapacitado", "sano"), ("viejo", "joven"), ("lesbiana", "heterosexual"),
)
SWAP = {b: a for a, b in IDENTITY_PAIRS} | {a: b for a, b in IDENTITY_PAIRS}

_WORD = re.compile(r"\w+")


def features_of(word: str) -> list[str]:
    """The word, marked by =, and its beginnings, marked by ^."""
    return ["=" + word] + ["^" + word[:n] for n in range(MIN_PREFIX, min(MAX_PREFIX, len(word)) + 1)]


def counts_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    length_weight: float
    bias: float
    known: dict[str, tuple] = field(default_factory=dict)

    def ids(self, word: str) -> tuple:
        """Vocabulary numbers of a word's features, kept for words seen before."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = tuple(i for f in features_of(word) if (i := self.index.get(f)) is not None)
        return got

    def vector(self, words: Counter) -> tuple[list[int], list[float], float]:
        """Feature numbers, their values, and the value of the length feature."""
        times: dict[int, int] = {}
        for w, c in words.items():
            for i in self.ids(w):
                times[i] = times.get(i, 0) + c
        return list(times), [math.log1p(c) for c in times.values()], math.log1p(sum(words.values()))

    def score(self, text: str) -> float:
        ids, values, length = self.vector(counts_of(text))
        z = self.bias + self.length_weight * length
        if ids:
            z += float(self.weights[ids] @ np.array(values))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


@dataclass
class Rows:
    """Sparse rows end to end: feature numbers, values, and the row of each."""

    ids: np.ndarray
    values: np.ndarray
    owner: np.ndarray
    n: int

    @staticmethod
    def of(ids: pa.ChunkedArray, values: pa.ChunkedArray, order: np.ndarray) -> "Rows":
        """Rows of two list columns, in an order."""
        ids, values = ids.combine_chunks(), values.combine_chunks()
        size = ids.value_lengths().to_numpy(zero_copy_only=False)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.repeat(place, size)
        by_owner = np.argsort(owner, kind="stable")
        return Rows(ids.flatten().to_numpy()[by_owner], values.flatten().to_numpy()[by_owner], owner[by_owner].astype(np.int32), len(order))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.ids] * self.values, self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, g[self.owner] * self.values, size)


def _solve(rows: Rows, length, labels, pairs: Rows, size, l2=1.0, penalty=PENALTY, positive_weight=3.0, rounds=400):
    """Weights, length weight and bias of the penalised logistic model, by Adam on all rows.

    A row of ``pairs`` has the differences between a text and its counterfactual, and is empty
    for a text without identity terms.  Positive rows, the rarer ones, count
    ``positive_weight`` times.
    """
    n = rows.n
    changed = max(1, len(np.unique(pairs.owner)))
    center = length.mean()
    length = length - center
    w = np.zeros(size + 2)
    w[-1] = math.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    cost = np.where(labels > 0, positive_weight, 1.0)
    for t in range(1, rounds + 1):
        z = rows.dot(w) + w[-2] * length + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) * cost / n
        grad = np.append(rows.back(g, size), [g @ length, g.sum()])
        grad[:-1] += l2 * w[:-1] / n
        if len(pairs.ids):
            grad[:size] += penalty * 2 / changed * pairs.back(pairs.dot(w), size)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[-2]), float(w[-1] - w[-2] * center)


def fit(labelled: DataFrame, min_docs: int = MIN_DOCS, max_features: int = MAX_FEATURES, penalty: float = PENALTY) -> Model:
    """A model of (text, toxic) rows with a 0/1 label, such as ``learning_rows`` gives."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("toxic").isNotNull())
    rows = rows.select("text", F.col("toxic").cast("int").alias("y"))

    def occurrences(batches):
        for b in batches:
            seen, toxic = Counter(), Counter()
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                own = {f for w in counts_of(text) for f in features_of(w)}
                seen.update(own)
                if y:
                    toxic.update(own)
            names = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[f] for f in names], pa.int64()),
                 pa.array([toxic[f] for f in names], pa.int64())], ["feature", "n", "t"])

    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    total, toxic = totals["n"], totals["t"]
    if not 0 < toxic < total:
        return Model({}, np.zeros(0), 0.0, 60.0 if total and toxic else -60.0)
    a, b = F.col("t"), F.col("n") - F.col("t")
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (total - toxic + 1.0))
    weight = F.abs(odds) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    chosen = (
        rows.mapInArrow(occurrences, "feature string, n long, t long")
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        .filter(F.col("n") >= min_docs).select("feature", weight.alias("z"))
        .filter("z > 2").orderBy(F.desc("z"), "feature").limit(max_features)
    )
    names = [r[0] for r in chosen.select("feature").collect()]
    blank = Model({f: i for i, f in enumerate(sorted(names))}, np.zeros(0), 0.0, 0.0)

    def vectors(batches):
        ints, reals = pa.list_(pa.int32()), pa.list_(pa.float32())
        kinds = [pa.int32(), ints, reals, pa.float64(), ints, reals]
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            out = []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = counts_of(text)
                ids, values, length = blank.vector(words)
                change: dict[int, float] = {}
                if not SWAP.keys().isdisjoint(words):
                    swapped = Counter()
                    for w, c in words.items():
                        swapped[SWAP.get(w, w)] += c
                    change = dict(zip(ids, values))
                    other = blank.vector(swapped)
                    for i, x in zip(other[0], other[1]):
                        change[i] = change.get(i, 0.0) - x
                    change = {i: x for i, x in change.items() if x}
                out.append((y, ids, values, length, list(change), list(change.values())))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(zip(*out), kinds)), b.column("place")],
                ["y", "ids", "vals", "len", "dids", "dvals", "place"])

    got = rows.withColumn("place", F.xxhash64("text", "y")).mapInArrow(
        vectors, "y int, ids array<int>, vals array<float>, len double, dids array<int>, dvals array<float>, place long"
    ).toArrow()
    order = np.argsort(got.column("place").to_numpy(), kind="stable")  # the same sums in any partitioning
    w, length, bias = _solve(
        Rows.of(got.column("ids"), got.column("vals"), order), got.column("len").to_numpy()[order],
        got.column("y").to_numpy()[order].astype(float), Rows.of(got.column("dids"), got.column("dvals"), order), len(names), penalty=penalty,
    )
    return Model(blank.index, w, length, bias)


def score_texts(docs: DataFrame, model: Model, carry: tuple = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and the score of each row with a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features words and weights
    columns = list(carry)

    def run(batches):
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                scores = [own.score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, "score"])

    schema = docs.select(columns).schema.add("score", "double")
    return docs.select(*dict.fromkeys(["text", *columns])).mapInArrow(run, schema)


def learning_rows(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of about ``sample`` labelled rows where ``learn`` holds.

    The sample is drawn from the labels by a hash of the id; its bounded list of ids is
    broadcast, so no text is shuffled, and the rows are written once for the steps that
    learn from them.
    """
    labels = labels.filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic IS NOT NULL")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labels.filter(spot < F.lit(min(1.0, sample / max(labels.count(), 1))))
    return through_files(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; learned from labels whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = fit(learning_rows(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return score_texts(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}

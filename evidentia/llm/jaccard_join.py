"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Hashes that a share of
1 / COMMON of the documents have are common, all others rare; the list of common ones is
bounded by COMMON times the mean set, whatever the input.

For a size band with sets of at most ``hi`` hashes, two sets of Jaccard similarity t or more
differ in at most D = floor((1 - t) / (1 + t) * 2 hi) hashes.  The rare hashes are dealt to
P > D parts by some of their bits, and each part is XOR-ed into one 64-bit word: the parity
sketch.  A hash in just one of two sets changes one word, so the number of unequal words is at
most the symmetric difference, and two sets within D share P - D words at least.  Words are
join keys (the pigeonhole).  Empty parts are no evidence: P has ``spare`` parts more than
D + 1, so that a set with at most that many empty parts shares a word that is not empty.  Sets
with more of them (most of their hashes are common ones) have further keys: the first
n - ceil(t n) + 1 of their hashes, rare ones first, of which two similar sets share one.  There
the place of the shared hash bounds the overlap, which rules out most pairs of such a key.
Bands have the ratio t, and a set goes to its own band and to the next, so that each pair
within the size ratio meets in the larger one's band.

Equal sets are one class; sketches, candidates and links are between classes.  A class's
number begins with its share of rare hashes, so the least member of a group of near copies is
one that most of them are close to.  A key's classes (a run) of at most SMALL members give all
their pairs.  A larger run gives the pairs of its least member with the others (a star).  When the
links found so far have been joined to components, runs of words whose star has come into one
component are settled, which nearly all runs of copies are; the classes of the others give their
words again, with a sketch of SKETCH parity bits.  Pairs of such a run whose sketches differ in no
more bits than similar sets may in hashes, and pairs of a large run of leading hashes, are verified
as well if they lie in different components.  So no link between components is lost, while large groups of
copies stay linear.  Candidates are verified by their exact sets, which only classes that are
in a candidate pair send, those of later pairs in a scan of their own.

Defined results: null, empty and blank texts have no set, size 0 and are their own component;
texts with fewer words than n have their whole sequence as the only n-gram; rows stand one
for one; rows with equal ids take part as documents of their own and share the id; the
component of a null id is the smallest id it reaches, if any; an empty table gives an empty
result; other input columns are not read.  64-bit hashes stand for n-grams, and 59 bits of a hash
for a class of equal sets.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.components import connected_components

from .common import lower_ascii, table, text_buffers, through_files

NGRAM, THRESHOLD = 4, Fraction(85, 100)
SMALL = 5
#: Bits of the sketches that pairs of unsettled runs are compared by before their sets are.
SKETCH = 1024
_BITS = [f"s{i}" for i in range(SKETCH // 64)]
#: A hash is common from this share of the documents on (and from COMMON_LEAST documents).
COMMON, COMMON_LEAST = 10_000, 20
#: Bits of the filter of classes in candidate pairs: its size does not grow with the input.
FILTER_BITS = 24
_PRIME = np.uint64(0x9E3779B185EBCA87)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 16) - 1, _PRIME, np.uint64)))
_FAR_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 16) - 1, pow(int(_PRIME), 1 << 16, 1 << 64), np.uint64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words come before each text (len + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.zeros(n, np.int64)
    at[starts[0]:] = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
    value = np.where(word, raw.astype(np.uint64) + np.uint64(1), np.uint64(0))
    value *= _POWERS[at & 0xFFFF]
    if int(at.max()) >> 16:  # words of over 65,536 bytes
        value *= _FAR_POWERS[at >> 16 & 0xFFFF]
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def sets_of(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, end to end, and their offsets."""
    raw, offsets = text_buffers(texts)
    words, before = word_hashes(raw, offsets)
    count = np.diff(before)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(n):  # texts with fewer than n words are padded with nothing
        part = np.zeros(len(words), np.uint64)
        part[: max(0, len(words) - k)] = words[k:]
        rolled = rolled * _PRIME + part
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), grams)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    hashes = rolled[before[:-1][owner] + within] if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence, padded with nothing, and its length
        whole = np.zeros(len(short), np.uint64)
        for k in range(n):
            at = np.minimum(before[:-1][short] + k, len(words) - 1)
            whole = whole * _PRIME + np.where(k < count[short], words[at], np.uint64(0))
        hashes[np.searchsorted(owner, short)] = whole + count[short].astype(np.uint64)
    hashes = mix(hashes)
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[keep], minlength=len(count))
    return hashes[keep], np.append(0, np.cumsum(sizes))


def classes_of(hashes: np.ndarray, offsets: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets: 4 bits of its share of rare hashes, 59 of a hash."""
    if not len(hashes):
        return np.zeros(len(offsets) - 1, np.int64)
    total = np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    size = np.diff(offsets)
    own = mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64) * _PRIME) >> np.uint64(5)
    count = np.diff(np.append(0, np.cumsum(rare))[offsets])
    share = np.minimum(15, np.floor(16 * np.sqrt(count / np.maximum(size, 1)))).astype(np.uint64)
    return ((share << np.uint64(59)) | own).view(np.int64)


class Bands:
    """Size bands for a threshold: largest size, allowed difference and number of parts of each."""

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(Fraction(self.lows[-1]) / threshold)))
        self.lows = np.array(self.lows, np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def allowed(self, band: int) -> int:
        most = int(self.lows[band + 1]) - 1
        return int((1 - self.threshold) / (1 + self.threshold) * 2 * most)

    def parts(self, band: int) -> tuple[int, int]:
        """Number of parts, and how many of them may be empty."""
        d = self.allowed(band)
        spare = 1 + d // 16
        return d + 1 + spare, spare


def sketch_keys(hashes: np.ndarray, offsets: np.ndarray, rare: np.ndarray, bands: Bands):
    """Join keys of all sets, the number of the set that each belongs to, and which sets are too sparse."""
    sizes = np.diff(offsets)
    rare_offsets = np.append(0, np.cumsum(rare))[offsets]
    hashes, count = hashes[rare], np.diff(rare_offsets)
    keys, owners, sparse = [], [], np.zeros(len(sizes), bool)
    home = bands.of(np.maximum(sizes, 1))
    for band in np.unique(np.concatenate([home, home + 1])):
        if bands.allowed(band) == 0:
            continue  # only equal sets
        chosen = np.flatnonzero(((home == band) | (home == band - 1)) & (sizes > 0))
        p, spare = bands.parts(band)
        own = count[chosen]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(rare_offsets[:-1][chosen], own)
        h = hashes[at]
        slot = np.repeat(np.arange(len(chosen)), own) * p + ((h >> np.uint64(11)) % np.uint64(p)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        filled = slot[first]
        sparse[chosen[p - np.bincount(filled // p, minlength=len(chosen)) > spare]] = True
        if len(first):
            words = np.bitwise_xor.reduceat(mix(h[order]), first)
            tag = (filled % p).astype(np.uint64) + np.uint64(int(band) << 32)
            keys.append(mix(words ^ mix(tag + np.uint64(1))))
            owners.append(chosen[filled // p])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), sparse
    return np.concatenate(keys), np.concatenate(owners), sparse


def leading_keys(hashes: np.ndarray, offsets: np.ndarray, rare: np.ndarray, chosen: np.ndarray, threshold: Fraction):
    """Keys of the first hashes of some sets, rare ones first: (key, set, place)."""
    keys, owners, places = [], [], []
    for i in chosen.tolist():
        a, b = offsets[i], offsets[i + 1]
        n = int(b - a)
        length = n + 1 + (-n * threshold.numerator // threshold.denominator)
        order = np.lexsort((hashes[a:b], ~rare[a:b]))[:length]
        keys.append(mix(hashes[a:b][order] ^ np.uint64(0x2545F4914F6CDD1D)))
        owners.append(np.full(length, i))
        places.append(np.arange(length))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(places)


_SUB = 512


def is_rare(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common) or not len(hashes):
        return np.ones(len(hashes), bool)
    return common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes


def _parts_of(batches, ngram, common):
    """Sub-batches with their ids, sets, flags of rare hashes and classes."""
    for b in batches:
        for at in range(0, b.num_rows, _SUB):
            part = b.slice(at, _SUB)
            hashes, offsets = sets_of(part.column("text"), ngram)
            rare = is_rare(hashes, common)
            yield part, hashes, offsets, rare, classes_of(hashes, offsets, rare)


def common_hashes(docs: DataFrame, ngram: int) -> np.ndarray:
    """Sorted hashes that a share of 1 / COMMON of all documents have.

    Each stretch of a partition reports those with the share in it, as a hash with the share
    overall has it in some stretch; the reports are added up.  The list only sets the order
    and the parts of hashes: results are the same with any list.
    """

    def report(batches):
        pending, size, n = [], 0, 0

        def flush():
            hashes, count = np.unique(np.concatenate(pending), return_counts=True)
            keep = count >= max(3, n / COMMON)
            return pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(count[keep])], ["h", "c"])

        for b in batches:
            for at in range(0, b.num_rows, _SUB):
                hashes, offsets = sets_of(b.column("text").slice(at, _SUB), ngram)
                pending.append(hashes)
                size += len(hashes)
                n += len(offsets) - 1
                if size > 4_000_000:
                    yield flush()
                    pending, size, n = [], 0, 0
        if pending:
            yield flush()

    found = _lowered(docs).mapInArrow(report, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    least = max(COMMON_LEAST, docs.count() // COMMON)
    got = found.filter(F.col("c") >= least).select("h").toArrow()
    return np.sort(got.column("h").to_numpy().view(np.uint64))


def document_classes(docs: DataFrame, ngram: int, common) -> DataFrame:
    """doc_id, n (set size), cls (null for the empty set)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for part, _, offsets, _, cls in _parts_of(batches, ngram, common.value):
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(cls, mask=n == 0)], ["doc_id", "n", "cls"])

    return _lowered(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n long, cls long")


def _lowered(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, lower_ascii(F.coalesce("text", F.lit(""))).alias("text"))


def _runs(keys: np.ndarray, columns: list[np.ndarray]):
    """Rows whose key others have too, once for each class (the first column), by key and class; and their runs."""
    order = np.lexsort((columns[0], keys))
    keys, columns = keys[order], [c[order] for c in columns]
    keep = np.ones(len(keys), bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (columns[0][1:] != columns[0][:-1])
    keys, columns = keys[keep], [c[keep] for c in columns]
    shared = np.zeros(len(keys), bool)
    same = keys[1:] == keys[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    keys, columns = keys[shared], [c[shared] for c in columns]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(keys)))
    run = np.repeat(np.arange(len(first)), length)
    return keys, columns, first[run], length[run]


def _run_pairs(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs: all of small runs, the first with the others of large ones."""
    place = np.arange(len(first)) - first
    a, b = [], []
    for k in range(1, SMALL):
        at = np.flatnonzero((length <= SMALL) & (place + k < length))
        a.append(at)
        b.append(at + k)
    others = np.flatnonzero((length > SMALL) & (place > 0))
    return np.concatenate([*a, first[others]]), np.concatenate([*b, others])


def candidate_runs(docs: DataFrame, bands: Bands, ngram: int, buckets: int, common) -> DataFrame:
    """Pairs (a, b, star) of classes that share a key, and the members (key, a, n, place) of large
    runs of leading hashes, with null b.  A large run of words gives star pairs only (see ``open_classes``)."""
    threshold = bands.threshold
    top, both = threshold.numerator, threshold.numerator + threshold.denominator

    def emit(batches):
        seen: set[int] = set()
        pending, leading, size = [], [], 0

        def dealt(parts):
            """Blobs by bucket of parallel arrays, the keys first."""
            arrays = [np.concatenate(x) for x in zip(*parts)]
            bucket = (arrays[0] >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            arrays = [x[order] for x in arrays]
            return pa.array([b"".join(x[a:b].tobytes() for x in arrays) for a, b in zip(cuts, cuts[1:])], pa.binary())

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), dealt(pending), dealt(leading)], ["bucket", "words", "leading"])

        for _, hashes, offsets, rare, cls in _parts_of(batches, ngram, common.value):
            fresh = []
            for c in cls.tolist():
                fresh.append(c not in seen)
                seen.add(c)
            fresh = np.array(fresh, bool)
            keys, owner, sparse = sketch_keys(hashes, offsets, rare, bands)
            keep = fresh[owner]
            pending.append((keys[keep], cls[owner[keep]]))
            keys, owner, place = leading_keys(hashes, offsets, rare, np.flatnonzero(sparse & fresh), threshold)
            leading.append((keys, cls[owner], np.diff(offsets)[owner] << 32 | place))
            size += int(keep.sum()) + len(keys)
            if size > 1_000_000:
                yield flush()
                pending, leading, size = [], [], 0
        if size:
            yield flush()

    def read(blobs, columns):
        """Parallel arrays of all blobs."""
        parts = [[] for _ in range(columns)]
        for blob in blobs:
            x = np.frombuffer(blob.as_buffer(), np.uint64)
            n = len(x) // columns
            for k in range(columns):
                parts[k].append(x[k * n : (k + 1) * n])
        arrays = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]
        return arrays[0], [x.view(np.int64) for x in arrays[1:]]

    names = ["key", "a", "b", "n", "place", "star"]

    def rows(*columns):
        count = max(len(x) for x in columns if x is not None)
        for at in range(0, count, 100_000):
            n = min(100_000, count - at)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.bool_() if k == "star" else pa.int64()) if x is None else pa.array(np.ascontiguousarray(x[at : at + n])) for k, x in zip(names, columns)], names)

    def meet(batches):
        words, leading = [], []
        for b in batches:
            words += list(b.column("words"))
            leading += list(b.column("leading"))
        keys, columns = read(words, 2)
        keys, (cls,), first, length = _runs(keys, columns)
        x, y = _run_pairs(first, length)
        pairs = [np.stack([cls[x], cls[y], length[x] > SMALL], axis=1)]
        keys, columns = read(leading, 3)
        keys, (cls, where), first, length = _runs(keys, columns)
        n, place = where >> 32, where & 0xFFFFFFFF
        x, y = _run_pairs(first, length)
        fits = np.minimum(n[x] - place[x], n[y] - place[y]) * both >= (n[x] + n[y]) * top
        pairs.append(np.stack([cls[x[fits]], cls[y[fits]], np.zeros(int(fits.sum()), np.int64)], axis=1))
        large = length > SMALL
        yield from rows(keys[large].view(np.int64), cls[large], None, n[large], place[large], None)
        pairs = np.concatenate(pairs)
        pairs = pairs[np.lexsort((1 - pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
        keep = np.ones(len(pairs), bool)
        keep[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
        pairs = pairs[keep]
        yield from rows(None, pairs[:, 0], pairs[:, 1], None, None, pairs[:, 2] > 0)

    keyed = _lowered(docs).mapInArrow(emit, "bucket int, words binary, leading binary").repartition("bucket").select("words", "leading")
    return keyed.mapInArrow(meet, "key long, a long, b long, n long, place long, star boolean")


def open_classes(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Classes of large word runs in which not all members have come into one component."""
    star = pairs.filter("star").select("a", "b")
    ends = star.join(joined.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    ends = ends.join(joined.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    unsettled = ends.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a").distinct()
    return star.join(unsettled, "a").select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def bit_sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes in SKETCH classes, as rows of 64-bit numbers: two sketches differ in at
    most as many bits as their sets differ in hashes."""
    count = len(offsets) - 1
    owner = np.repeat(np.arange(count), np.diff(offsets))
    at = owner * SKETCH + ((hashes >> np.uint64(17)) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=count * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(count, SKETCH), axis=1).view(np.int64)


def members_of(sets: DataFrame, bands: Bands, common) -> DataFrame:
    """(key, cls, place, s0, ...) of the words of given sets: the keys under which they have met, and their bit sketches."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _SUB):
                part = b.slice(at, _SUB)
                each = [_unpack(x.as_buffer()) for x in part.column("hashes")]
                hashes, offsets = np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))
                keys, owner, _ = sketch_keys(hashes, offsets, is_rare(hashes, common.value), bands)
                bits = bit_sketches(hashes, offsets)[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(part.column("cls").to_numpy()[owner]), pa.array(np.zeros(len(keys), np.int64)),
                     *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], ["key", "cls", "place", *_BITS])

    return sets.mapInArrow(run, "key long, cls long, place long, " + ", ".join(f"{c} long" for c in _BITS))


def candidate_sets(docs: DataFrame, pairs: DataFrame, ngram: int, common) -> DataFrame:
    """(cls, hashes) of classes in pairs: 64-bit numbers, sorted.

    A filter of fixed size (2^FILTER_BITS bits) tells the scan which classes may be in a pair;
    the others it lets through are dropped by the joins that follow.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    spot = F.col("cls").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = ends.select(
        F.shiftright(spot, 5).alias("w"), F.expr("shiftleft(1L, int(cls & 31))").alias("bit")
    )
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table_, seen = shared.value, set()
        for _, hashes, offsets, _, cls in _parts_of(batches, ngram, common.value):
            spot = cls & ((1 << FILTER_BITS) - 1)
            maybe = (table_[spot >> 5] >> (spot & 31).astype(np.uint32)) & np.uint32(1)
            names, blobs = [], []
            for i in np.flatnonzero((maybe > 0) & (np.diff(offsets) > 0)).tolist():
                if (c := int(cls[i])) not in seen:
                    seen.add(c)
                    names.append(c)
                    blobs.append(hashes[offsets[i] : offsets[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["cls", "hashes"])

    found = _lowered(docs).mapInArrow(run, "cls long, hashes binary")
    # one of the equal sets of a class, whichever partition it comes from
    return found.repartition("cls").mapInArrow(_first_of_class, "cls long, hashes binary")


def _first_of_class(batches):
    seen: set[int] = set()
    for b in batches:
        keep = []
        for c in b.column("cls").to_pylist():
            keep.append(c not in seen)
            seen.add(c)
        yield b.filter(pa.array(keep, pa.bool_()))


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def verified_links(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The (a, b) pairs whose sets have the similarity."""
    top, bottom = threshold.numerator, threshold.denominator

    def run(batches):
        for b in batches:
            keep = []
            last, left = None, None
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                small, large = sorted((len(x) // 8, len(y) // 8))
                if small * bottom < large * top:
                    keep.append(False)
                    continue
                if x is not last:
                    last, left = x, _unpack(x)
                right = _unpack(y)
                both = np.concatenate([left, right])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common * bottom >= (small + large - common) * top)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    withb = pairs.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b")
    both = withb.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similarity_components(
    docs: DataFrame, ngram: int = NGRAM, threshold: Fraction = THRESHOLD
) -> DataFrame:
    """doc_id, n_shingles, component_id for each (doc_id, text)."""
    spark = docs.sparkSession
    bands = Bands(threshold)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = spark.sparkContext.broadcast(common_hashes(docs, ngram))
    classes = through_files(document_classes(docs, ngram, common))
    runs = through_files(candidate_runs(docs, bands, ngram, buckets, common))
    pairs = runs.filter(F.col("b").isNotNull()).groupBy("a", "b").agg(F.max("star").alias("star"))
    pairs = through_files(pairs)
    large = runs.filter(F.col("b").isNull()).select("key", F.col("a").alias("cls"), "place")
    sets = through_files(candidate_sets(docs, pairs, ngram, common))
    links = through_files(verified_links(pairs, sets, threshold))

    def components(found: DataFrame) -> DataFrame:
        return connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))

    joined = components(links)
    unsettled = through_files(open_classes(pairs, joined))
    if unsettled.limit(1).count():
        words = through_files(members_of(sets.join(unsettled, "cls", "left_semi"), bands, common))
        # all members of an unsettled run are there; smaller runs have given all their pairs
        many = words.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("key")
        large = large.unionByName(words.join(many, "key", "left_semi"), allowMissingColumns=True)
    # pairs of large runs between different components
    member = large.join(joined.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    member = member.join(classes.filter("cls IS NOT NULL").groupBy("cls").agg(F.max("n").alias("n")), "cls")
    mixed = member.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2")
    member = through_files(member.join(mixed.select("key"), "key"))
    x, y = member.alias("x"), member.alias("y")
    apart = None  # bits in which the sketches of two members differ
    for c in _BITS if _BITS[0] in member.columns else ():
        one = F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
        apart = one if apart is None else apart + one
    top, bottom = threshold.numerator, threshold.denominator
    across = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component"))
        & (F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) * (top + bottom) >= (F.col("x.n") + F.col("y.n")) * top)
        & (F.lit(True) if apart is None else F.coalesce(apart * (top + bottom) <= (F.col("x.n") + F.col("y.n")) * (bottom - top), F.lit(True))),
    ).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    across = through_files(across)
    # members whose pairs in the runs all failed the bound have sent no set yet
    late = across.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets.select("cls"), "cls", "left_anti")
    late = through_files(late.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    if late.limit(1).count():
        sets = sets.unionByName(through_files(candidate_sets(docs, late, ngram, common)).join(late.select(F.col("a").alias("cls")), "cls", "left_semi"))
    more = through_files(verified_links(across, sets, threshold))
    if more.limit(1).count():
        joined = components(links.unionByName(more))
    ids = classes.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    ids = ids.join(joined.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ids.join(least, "component").select("cls", "component_id")
    return classes.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 4-word shingles and similarity 0.85."""
    return similarity_components(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE: dict[str, str] = {}

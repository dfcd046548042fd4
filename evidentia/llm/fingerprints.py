"""Document fingerprints: Invertible Bloom lookup sketches of paragraph digests.

Text is cut into paragraphs at line ends, and within a line behind those ends of sentences whose
last letter is an e or none of a-z (about one in four in most languages), which depends on nothing
but what stands there; blank parts are left out.  A digest is the 64-bit xxhash of a paragraph and
of a number: of a paragraph that is there n times, the powers of two up to n, and n.  So a text is
a set of digests, to which a line that is repeated a thousand times adds eleven.  A sketch has
three blocks of cells; a digest lies in one cell of each block, and a cell holds the number, the
XOR and the XOR of the check hashes of its digests.

Sketches of two versions are subtracted cell by cell: digests of both cancel, and what is
left is the sketch of the difference.  Peeling recovers it: a cell with count 1 or -1 whose
check fits its XOR holds one digest alone; all such are taken out of their cells in a round,
until no cell is left (done) or none gives way (failure).  A failure is retried with sketches of
more cells: as many as the two sets need if they have nothing in common, and eight times as
many.  If that fails too (or takes more than ROUNDS rounds), the two sets are compared as they
are, so the difference is exact in any case.  Likeness is the Jaccard measure of the two sets,
from the recovered digests and the set sizes, which the fingerprints store.

The fingerprint is the sketch with blocks of BASE cells: the set size, then cell, number, XOR and
check of each cell that is not empty, as hex.  It depends on the text alone.

All of it is SQL functions on the row.  Cells are kept as an array of those that are not empty, in
order; sketches are added by putting their cells in order and joining neighbours with one number,
so no step takes more than about n log n for n paragraphs.  Only ``with_next`` shuffles: texts
once, by ranges of ids, plus one guest row a range.

Defined results: null text is empty and has the fingerprint of the empty set; two empty sets
have likeness 1; rows stand one for one; rows with equal ids are put in order by the xxhash of
their text, descending, then by text; null ids come last; an only row is its own next; an empty
table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

#: Cells of a block of the fingerprint, and the largest that a retry takes.
BASE, MOST = 8, 1 << 20
#: Rounds of peeling; a sketch that needs more counts as failed and is retried.
ROUNDS = 16
#: Id ranges of ``with_next``: about this many rows each, and at most so many, as one row a
#: range goes to the driver and back; and the rows of the sample that the ranges are taken from,
#: for each range.  Ranges only deal out the work.
RANGE_ROWS, MAX_RANGES, SAMPLED = 256, 4096, 16

_CELL = "array<struct<p:bigint,n:bigint,k:bigint,c:bigint>>"


#: Where text is cut: line ends, and white space behind some ends of sentences.
CUT = r"\n|(?<=[^a-df-z\s][.!?])\s+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, CUT), lambda x: F.trim(x) != "")


def _starts(items: Column, key) -> Column:
    """Numbers of the items, in order, whose ``key`` is not that of the item before."""
    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(
        F.filter(
            F.sequence(F.lit(0), F.size(items) - 1),
            lambda i: (i == 0) | (key(F.get(items, i)) != key(F.get(items, i - 1))),
        )
    )


def _length(items: Column, starts: Column, start: Column, j: Column) -> Column:
    """Length of the run that is number j of ``starts``."""
    return F.coalesce(F.get(starts, j + 1), F.size(items)) - start


def digests(text: Column) -> Column:
    """Distinct digests of (paragraph, number)."""
    hashed = F.array_sort(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))

    def numbers(n: Column) -> Column:
        powers = F.transform(F.sequence(F.lit(0), F.length(F.bin(n)) - 1), lambda b: F.pow(F.lit(2), b).cast("int"))
        return F.array_union(powers, F.array(n))

    def numbered(h: Column) -> Column:
        return F.flatten(let(_starts(h, lambda x: x), lambda f: F.transform(f, lambda start, j: let(
            F.get(h, start), lambda x: F.transform(numbers(_length(h, f, start, j)), lambda n: F.xxhash64(x, n))
        ))))

    return let(hashed, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.transform(h, lambda x: F.xxhash64(x, F.lit(1)))
    ).otherwise(numbered(h)))


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(keys: Column, sign: int, width: Column) -> Column:
    """Digests as cells: one in each block."""

    def of(k: Column) -> Column:
        slot = lambda b: F.shiftrightunsigned(k, 20 * b).bitwiseAND(width - 1) + width * b
        cell = lambda b: F.struct(
            slot(b).alias("p"), F.lit(sign).cast("long").alias("n"), k.alias("k"), check(k).alias("c"))
        return F.array(cell(0), cell(1), cell(2))

    return F.flatten(F.transform(keys, of))


def summed(cells: Column) -> Column:
    """Cells added by their number, without empty ones."""
    nought = F.lit(0).cast("long")
    zero = F.struct(nought.alias("n"), nought.alias("k"), nought.alias("c"))

    def add(acc: Column, e: Column) -> Column:
        return F.struct(
            (acc["n"] + e["n"]).alias("n"), acc["k"].bitwiseXOR(e["k"]).alias("k"), acc["c"].bitwiseXOR(e["c"]).alias("c")
        )

    def cell(run: Column) -> Column:
        named = lambda x: F.struct(F.get(run, F.lit(0))["p"].alias("p"), x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"))
        return F.aggregate(run, zero, add, named)

    def joined(s: Column) -> Column:
        return let(_starts(s, lambda x: x["p"]), lambda f: F.transform(f, lambda start, j: let(
            _length(s, f, start, j), lambda n: F.when(n == 1, F.get(s, start)).otherwise(let(F.slice(s, start + 1, n), cell))
        )))

    # put in order by numbers alone, which is sooner than by whole cells
    places = lambda c: F.array_sort(F.transform(c, lambda x, i: F.shiftleft(x["p"], 32).bitwiseOR(i)))
    in_order = let(cells, lambda c: F.transform(places(c), lambda o: F.get(c, o.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))))
    return F.filter(let(in_order, joined), lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))


def sketch(keys: Column, width) -> Column:
    return summed(_entries(keys, 1, F.lit(width).cast("long")))


def subtract(a: Column, b: Column) -> Column:
    taken = lambda x: F.struct(x["p"].alias("p"), (-x["n"]).alias("n"), x["k"].alias("k"), x["c"].alias("c"))
    return summed(F.concat(a, F.transform(b, taken)))


def peel(cells: Column, width) -> Column:
    """Array of (s, k) of the difference, s = 1 or -1; null if it fails."""
    width = F.lit(width).cast("long") if isinstance(width, int) else width
    none = F.array().cast("array<bigint>")

    def round_(acc: Column) -> Column:
        pure = lambda s: F.array_distinct(F.transform(
            F.filter(acc["cells"], lambda x: (x["n"] == s) & (check(x["k"]) == x["c"])), lambda x: x["k"]))

        def taken(p: Column) -> Column:
            left = summed(F.concat(acc["cells"], _entries(p["a"], -1, width), _entries(p["b"], 1, width)))
            return F.struct(
                left.alias("cells"), F.concat(acc["a"], p["a"]).alias("a"), F.concat(acc["b"], p["b"]).alias("b"),
                (F.size(p["a"]) + F.size(p["b"]) > 0).alias("go"),
            )

        return let(F.struct(pure(1).alias("a"), pure(-1).alias("b")), taken)

    start = F.struct(cells.alias("cells"), none.alias("a"), none.alias("b"), F.lit(True).alias("go"))
    signed = lambda keys, s: F.transform(keys, lambda k: F.struct(F.lit(s).alias("s"), k.alias("k")))
    sides = lambda acc: F.concat(signed(acc["a"], 1), signed(acc["b"], -1))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda acc, _: F.when(acc["go"] & (F.size(acc["cells"]) > 0), round_(acc)).otherwise(acc),
        lambda acc: F.when(F.size(acc["cells"]) == 0, sides(acc)),
    )


def _size(found: Column) -> Column:
    """Size of an array, null of null."""
    return let(found, lambda p: F.when(p.isNotNull(), F.size(p)))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Number of digests in just one of the sets, from their sketches, retried larger on failure."""
    need = F.pow(F.lit(2), F.ceil(F.log2((F.size(a) + F.size(b)) / 2.0))).cast("long")

    def retried(w: Column) -> Column:
        # sketches are sums, so the difference of two is the sum over both sets with their signs
        return _size(let(summed(F.concat(_entries(a, 1, w), _entries(b, -1, w))), lambda cells: peel(cells, w)))

    attempts = [let(F.least(F.lit(MOST).cast("long"), need * more), retried) for more in (1, 8)]
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.coalesce(_size(peel(subtract(cells_a, cells_b), BASE)), *attempts, exact)


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        let(difference(a, b, cells_a, cells_b), lambda d: (total - d).cast("double") / (total + d))
    )


def fingerprint(keys: Column, cells: Column) -> Column:
    """The sketch as text."""
    cell = lambda x: F.concat(
        F.hex(x["p"]), F.lit("."), F.hex(x["n"]), F.lit("."), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["c"]), 8, "0"))
    return F.lower(F.concat_ws("|", F.size(keys).cast("string"), F.array_join(F.transform(cells, cell), ",")))


def id_bounds(rows: DataFrame) -> list[int]:
    """Ascending ids that divide the rows into ranges of about equal size; an id may stand there
    more than once.  A sample of bounded size gives them."""
    n = rows.count()
    ranges = min(MAX_RANGES, n // RANGE_ROWS)
    if ranges < 2:
        return []
    sampled = rows.select("id").filter(F.rand(11) < SAMPLED * ranges / n)
    ids = sorted(r.id for r in sampled.collect())
    return [ids[len(ids) * i // ranges] for i in range(1, ranges)] if ids else []


def place_among(bounds: Column, value: Column, count: int, strict: bool) -> Column:
    """How many of the ascending bounds are less than the value (or equal, if not strict), by bisection."""
    steps = [1 << b for b in reversed(range(count.bit_length()))]
    less = lambda x: (x < value) if strict else (x <= value)
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: at + F.when(less(F.get(bounds, at + step - 1)), step).otherwise(F.lit(0)),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, id, h, range, guest) dealt by id ranges, each ending in a guest: what comes next.

    Rows of an id that fills several ranges are dealt among them by the hash of their text.  The
    range table (its largest row a range) is bounded and goes through the driver; the largest row
    of a range is also sent, as a guest, to the range above, and the largest of all to the lowest one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    bounds = id_bounds(rows)
    keyed = rows.withColumn("h", F.xxhash64("text"))
    if bounds:
        table_ = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        low, high = (place_among(table_, F.col("id"), len(bounds), strict) for strict in (True, False))
        share = F.col("h").cast("double") / float(1 << 64) + 0.5
        keyed = keyed.withColumn("low", low).withColumn("high", high)
        spread = F.least(F.floor((F.col("high") - F.col("low")) * share), F.greatest(F.col("high") - F.col("low") - 1, F.lit(0)))
        keyed = keyed.withColumn("range", (F.col("low") + spread).cast("int")).drop("low", "high")
    else:
        keyed = keyed.withColumn("range", F.lit(0))
    tops = sorted(
        (r.range, r.top.id, r.top.h) for r in keyed.groupBy("range").agg(F.max(F.struct("id", "h")).alias("top")).collect()
    )
    hosts = [(i, h, tops[(k + 1) % len(tops)][0]) for k, (_, i, h) in enumerate(tops)]
    hosts = docs.sparkSession.createDataFrame(hosts, "id long, h long, host int")
    dealt = keyed.join(F.broadcast(hosts), ["id", "h"], "left").withColumn(
        "dest", F.explode(F.array_compact(F.array(
            F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")),
            F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))),
        )))
    )
    return dealt.select("doc_id", "text", "id", "h", "dest.range", "dest.guest").repartition("range")


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of each (doc_id, text) and of its edited text, with likenesses.

    The edited text has its last half replaced by the beginning of the next document.
    """
    sketched = with_next(docs).withColumn("keys", digests(F.col("text")))
    sketched = sketched.withColumn("cells", sketch(F.col("keys"), BASE))
    order = Window.partitionBy("range").orderBy("guest", F.desc("id"), F.desc("h"), F.desc("text"))
    pairs = sketched.withColumn("next", F.lead(F.struct("text", "keys", "cells")).over(order)).filter(~F.col("guest"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    pairs = pairs.withColumn("edited", edited).withColumn("edited_keys", digests(F.col("edited")))
    pairs = pairs.withColumn("edited_cells", sketch(F.col("edited_keys"), BASE))
    return pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("keys"), F.col("cells")).alias("fingerprint"),
        fingerprint(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("cells"), F.col("edited_cells")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next.keys"), F.col("cells"), F.col("next.cells")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_versions(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE: dict[str, str] = {}

"""Spelling variant grouping: a scan of the sorted vocabulary with shared edit-matrix rows.

Words are counted over all documents.  Two words are near if one code point inserted, deleted
or replaced turns one into the other.  If the shorter has m code points, near words share their
first m // 2 or their last m - m // 2, so the vocabulary is dealt out by these, once forwards
and once as reversed words.  Each dealt group is a stretch of a sorted list.  A query goes down
the list with the band of three cells of the edit matrix: a range of words that share a prefix
(bounded by the longest common prefixes of neighbours) has one row, which all of them reuse, and
a range whose row has no cell of at most one edit is skipped with all its words.  A pair that
both directions hold counts forwards only.

Groups of more than ``GROUP`` words are dealt out again as cells (block of the list, block of
queries), so that no task holds more than a few such blocks; no word or pair is left out.  What
leaves a task is a row a word (number of near words, best form), never a row a pair.  Chains of
forms are followed by doubling; a form occurs five times as often as its word, so a chain is at
most the logarithm of the largest count to the base five.

Defined results: null and empty texts have no words; a null id counts as empty text in the
corruption's key.  Repeated rows count each.  Without words that are frequent and long enough
the result is empty.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table, text_buffers, through_files

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a dealt group before it is split into cells.
GROUP = 50_000
#: Rows that a task takes up before it searches the groups that are complete.
TAKEN = 100_000
#: Queries that go down the list at a time.
QUERIES_AT_ONCE = 8_192


def occurrences(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """A row for each run of letters: word (A-Z lower-cased).

    With ``damage``, a run whose crc32 together with the document's id is divisible by it
    loses the code point at that number modulo its length.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit("([a-zÀ-ÿ]+)"), F.lit(1))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    rows = rows.filter(F.length("run") >= LEAST_LENGTH)  # damage only shortens
    if damage is None:
        return rows.select(F.col("run").alias("word"))
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumn("h", F.crc32(F.concat(owner, F.lit(":"), F.col("run"))))
    lost = F.expr("concat(substring(run, 1, CAST(h % length(run) AS INT)), substring(run, CAST(h % length(run) AS INT) + 2))")
    return rows.select(F.when(F.col("h") % damage == 0, lost).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n: of at least LEAST_LENGTH code points and LEAST_COUNT occurrences."""
    long_enough = words.filter(F.length("word") >= LEAST_LENGTH)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def dealt(vocab: DataFrame) -> DataFrame:
    """The words in their groups: m, back, part (the shared letters), i, j, listed, asking, w (reversed if back), n."""
    length = F.length("word")
    choices = [F.struct((length - 1 + k).alias("m"), F.lit(back).alias("back")) for k in (0, 1) for back in (False, True)]
    rows = vocab.select("word", "n", F.explode(F.array(*choices)).alias("c")).filter(F.col("c.m") >= LEAST_LENGTH)
    rows = rows.select(F.col("c.m").alias("m"), F.col("c.back").alias("back"), F.when(F.col("c.back"), F.reverse("word")).otherwise(F.col("word")).alias("w"), "n")
    rows = rows.withColumn("part", F.expr("left(w, CASE WHEN back THEN m - m DIV 2 ELSE m DIV 2 END)"))
    key = ["m", "back", "part"]
    large = rows.groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") > GROUP)
    rows = rows.join(large.select(*key, F.ceil(F.col("size") / GROUP).cast("int").alias("c")), key, "left")
    block = F.pmod(F.xxhash64("w"), F.col("c")).cast("int")
    every = F.sequence(F.lit(0), F.col("c") - 1)
    cell = lambda i, j, listed: F.struct(i.alias("i"), j.alias("j"), F.lit(listed).alias("listed"), F.lit(not listed).alias("asking"))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("listed"), F.lit(True).alias("asking")))
    cells = F.concat(F.transform(every, lambda k: cell(block, k, True)), F.transform(every, lambda k: cell(k, block, False)))
    rows = rows.select(*key, "w", "n", F.explode(F.when(F.col("c").isNull(), whole).otherwise(cells)).alias("at"))
    return rows.select(*key, "at.*", "w", "n")


def latin(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a code point (all are below U+0100), and offsets."""
    raw, offsets = text_buffers(col)
    lead = raw == 0xC3
    out = raw.copy()
    out[1:][lead[:-1]] = (raw[1:][lead[:-1]] & 0x3F) | 0xC0
    return out[~lead], np.append(0, np.cumsum(~lead))[offsets]


class SortedList:
    """A sorted list of words in groups, and the ranges of shared prefixes at each depth."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.data, self.start, self.size = data, start, size
        n = len(start)
        self.lcp = np.full(n, -1, np.int64)  # with the word before; -1 where a group begins
        at = np.flatnonzero(np.append(False, group[1:] == group[:-1]))
        self.lcp[at] = 0
        depth = 0
        while len(at):
            at = at[np.minimum(size[at], size[at - 1]) > depth]
            at = at[data[start[at] + depth] == data[start[at - 1] + depth]]
            depth += 1
            self.lcp[at] = depth
        self.live, self.levels = np.arange(n), {}

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First words of the ranges that share depth + 1 letters, that letter, the parent's number, and both as a sorted key.

        Depths are asked for in rising order at first; words shorter than a depth are dropped for good.
        """
        if depth not in self.levels:
            self.live = self.live[self.size[self.live] >= depth]
            first = self.live[self.lcp[self.live] <= depth]
            letter = np.where(self.size[first] > depth, self.data[np.minimum(self.start[first] + depth, len(self.data) - 1)], 0).astype(np.int64)
            parent = np.cumsum(self.lcp[first] < depth)
            self.levels[depth] = first, letter, parent, parent * 256 + letter
        return self.levels[depth]


def near_pairs(words: SortedList, asking: np.ndarray, data, start, size, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, m: np.ndarray):
    """Pairs (query, listed word) of exactly one edit whose shorter has m letters.

    Query i (of ``asking``) goes down words lo[i] .. hi[i] of the list, with whose prefix of depth[i] letters it begins.
    """
    empty = np.zeros(0, np.int64)
    found = [(empty, empty)]
    query, low, high = empty, empty, empty
    a = b = c = empty  # cells for as many letters of the query less one, as many, one more
    asking = asking[np.argsort(depth[asking], kind="stable")]
    d = int(depth[asking[0]]) if len(asking) else 0
    begun = 0
    cap = lambda x: np.minimum(x, 2)

    def letter_at(q, place):
        ok = (place >= 0) & (place < size[q])
        return np.where(ok, data[np.where(ok, start[q] + place, 0)].astype(np.int64), -1)

    while len(query) or begun < len(asking):
        until = int(np.searchsorted(depth[asking], d, "right"))
        if until > begun:
            new = asking[begun:until]
            begun = until
            query, low, high = np.append(query, new), np.append(low, lo[new]), np.append(high, hi[new])
            a, b, c = np.append(a, np.ones(len(new), np.int64)), np.append(b, np.zeros(len(new), np.int64)), np.append(c, np.where(size[new] > d, 1, 2))
        # the word that ends here, if any, is the first of its range
        ends = words.size[low] == d
        gap = size[query] - d
        hit = np.flatnonzero(ends & (np.where(gap == -1, a, np.where(gap == 0, b, np.where(gap == 1, c, 2))) == 1))
        hit = hit[np.minimum(size[query[hit]], d) == m[query[hit]]]
        found.append((query[hit], low[hit]))
        first, letter, parent, key = words.level(d)
        at = np.searchsorted(first, low)
        exact = np.flatnonzero(b == 0)
        stop = np.searchsorted(first, high[exact])
        many = stop - at[exact]
        node = np.repeat(exact, many)
        child = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[exact], many)
        # one edit is used up: only the letters that keep a cell at one can follow
        used = np.flatnonzero(b > 0)
        want = [(used[cell[used] == 1], shift) for cell, shift in ((a, -1), (b, 0), (c, 1))]
        node2 = np.concatenate([u for u, _ in want])
        letters = np.concatenate([letter_at(query[u], np.full(len(u), d + shift)) for u, shift in want])
        fits = letters >= 0
        node2, letters = node2[fits], letters[fits]
        pair = np.unique(node2 * 256 + letters)
        node2, letters = pair >> 8, pair & 255
        sought = parent[at[node2]] * 256 + letters
        place = np.searchsorted(key, sought)
        there = place < len(key)
        there[there] = key[place[there]] == sought[there]
        node, child = np.append(node, node2[there]), np.append(child, place[there])
        ch = letter[child]
        node, child, ch = node[ch > 0], child[ch > 0], ch[ch > 0]
        q = query[node]
        a2 = cap(np.minimum(a[node] + (ch != letter_at(q, np.full(len(q), d - 1))), b[node] + 1))
        b2 = cap(np.minimum(np.minimum(b[node] + (ch != letter_at(q, np.full(len(q), d))), c[node] + 1), a2 + 1))
        c2 = cap(np.minimum(c[node] + (ch != letter_at(q, np.full(len(q), d + 1))), b2 + 1))
        b2 = np.where(size[q] >= d + 1, b2, 2)
        c2 = np.where(size[q] >= d + 2, c2, 2)
        keep = np.minimum(np.minimum(a2, b2), c2) <= 1
        node, child = node[keep], child[keep]
        after = np.append(first, np.int64(len(words.size)))[child + 1]
        query, low, high = q[keep], first[child], np.minimum(after, high[node])
        a, b, c = a2[keep], b2[keep], c2[keep]
        d = d + 1 if len(query) or begun >= len(asking) else int(depth[asking[begun]])
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def search(rows: pa.Table) -> pa.RecordBatch:
    """Near words of all asking words of complete groups, in their sorted order."""
    data, offsets = latin(rows.column("w"))
    start, size = offsets[:-1], np.diff(offsets)
    m, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("m", "n"))
    back, listed, asking = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("back", "listed", "asking"))
    depth = np.where(back, m - m // 2, m // 2)
    cut = np.zeros(len(m), bool)
    cut[:1] = True
    for c in ("m", "back", "part", "i", "j"):
        codes = rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
        cut[1:] |= codes[1:] != codes[:-1]
    group = np.cumsum(cut)
    own = np.flatnonzero(listed)
    words = SortedList(data, start[own], size[own], group[own])
    lo, hi = np.searchsorted(group[own], group), np.searchsorted(group[own], group, "right")
    query = np.flatnonzero(asking & (lo < hi))
    pairs = [near_pairs(words, query[i : i + QUERIES_AT_ONCE], data, start, size, lo, hi, depth, m) for i in range(0, len(query), QUERIES_AT_ONCE)]
    q = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in pairs)])
    w = own[np.concatenate([np.zeros(0, np.int64), *(p[1] for p in pairs)])]
    # reversed words that share their first m // 2 letters too have been found forwards
    check = np.flatnonzero(back[q])
    for k in range(int((m[q[check]] // 2).max()) if len(check) else 0):
        last = check[m[q[check]] // 2 == k]  # all of them equal: drop
        q[last] = -1
        check = check[m[q[check]] // 2 > k]
        x, y = q[check], w[check]
        check = check[data[start[x] + size[x] - 1 - k] == data[start[y] + size[y] - 1 - k]]
    q[check] = -1
    w, q = w[q >= 0], q[q >= 0]
    near = np.bincount(q, minlength=len(m))
    best = np.zeros(len(m), np.int64)
    fits = np.flatnonzero(n[w] >= RATIO * n[q])
    np.maximum.at(best, q[fits], n[w[fits]])
    fits = fits[n[w[fits]] == best[q[fits]]]
    form = np.full(len(m), None, object)
    names = rows.column("w").take(pa.array(w[fits])).to_pylist()
    for i, name in zip(q[fits].tolist(), names):
        name = name[::-1] if back[i] else name
        if form[i] is None or name < form[i]:
            form[i] = name
    told = np.flatnonzero(near > 0)
    word = [x[::-1] if y else x for x, y in zip(rows.column("w").take(pa.array(told)).to_pylist(), back[told].tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(word, pa.string()), pa.array(near[told]), pa.array(form[told], pa.string()), pa.array(best[told])], ["word", "n_near", "form", "form_n"]
    )


def _search_sorted(batches):
    taken, n = [], 0
    for b in batches:
        taken.append(b)
        n += b.num_rows
        if n >= TAKEN:
            rows = pa.Table.from_batches(taken).combine_chunks()
            tail = {c: rows.column(c)[n - 1].as_py() for c in ("m", "back", "part", "i", "j")}
            same = np.ones(n, bool)
            for c, v in tail.items():
                same &= pa.compute.equal(rows.column(c), v).to_numpy()
            cut = int(np.argmax(same))
            if cut:
                yield search(rows.slice(0, cut))
                taken, n = rows.slice(cut).to_batches(), n - cut
    if n:
        yield search(pa.Table.from_batches(taken).combine_chunks())


def near_words(vocab: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n (null without a form) for all words of a vocabulary (word, n)."""
    key = ["m", "back", "part", "i", "j"]
    rows = dealt(vocab).repartition(*key).sortWithinPartitions(*key, "w")
    found = rows.mapInArrow(_search_sorted, "word string, n_near long, form string, form_n long")
    none = F.lit(None)
    own = vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("string").alias("form"), none.cast("long").alias("form_n"))
    both = own.unionByName(found.select("word", none.cast("long").alias("n"), "n_near", "form", "form_n"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    got = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return got.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root: the end of the chain of forms of each word."""
    forms = through_files(forms)
    links = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("n")).first()[0] or 1
    chain = max(1, math.ceil(math.log(most, RATIO)))
    for _ in range(math.ceil(math.log2(chain))):
        links = through_files(links)
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root for the vocabulary of ``docs`` (doc_id, text)."""
    return with_roots(near_words(through_files(vocabulary(occurrences(docs, damage)))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all words of all documents, one run in 199 of which has lost a letter."""
    return spelling_variants(table(spark, sf_dir, "documents"), 199).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLE = {
    "op12_spelling_variants": r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
  lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [192 + (ord(ch)::BIGINT >> 6), 128 + (ord(ch)::BIGINT & 63)] END)) AS b FROM own),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x: xor(t[(xor(h, x) & 255) + 1], h >> 8)), 4294967295) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word)::BIGINT)) AS i FROM v)),
near AS (SELECT x.word AS a, y.word AS b FROM del x JOIN del y USING (i, d) WHERE x.word <> y.word
  UNION SELECT word, d FROM del SEMI JOIN v ON d = v.word UNION SELECT d, word FROM del SEMI JOIN v ON d = v.word),
count_near AS (SELECT a AS word, count(*)::BIGINT AS n_near FROM near GROUP BY a),
best AS (SELECT a AS word, b AS form, vb.n AS form_n FROM near JOIN v va ON va.word = a JOIN v vb ON vb.word = b
  WHERE vb.n >= 5 * va.n QUALIFY row_number() OVER (PARTITION BY a ORDER BY vb.n DESC, b) = 1),
chain(word, root) AS (SELECT word, form FROM best UNION ALL SELECT c.word, b.form FROM chain c JOIN best b ON c.root = b.word),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM best))
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n
FROM v LEFT JOIN count_near USING (word) LEFT JOIN best USING (word) LEFT JOIN roots USING (word)""",
}

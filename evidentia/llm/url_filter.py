"""URL filters: a sorted digest array probed by vectorised binary search.

``DigestArray`` keeps the 64-bit xxhash of each rule (host + path prefix) in one sorted
array file, with the full strings beside it.  Spark ships the two files to every executor
(``SparkContext.addFile``; a lost executor's successor fetches them again), where they are
memory-mapped.  A url's candidates - each suffix of its host at a label edge, joined to
each path prefix of a length that some rule has - are hashed and looked up for a whole
Arrow batch at once; a hit counts only if the stored string is the candidate itself.

The array is shipped only below ``MAX_RULES`` rules and ``MAX_BYTES`` bytes, both checked.
Beyond, ``filter_urls_by_join`` gives the same rows by a shuffle join on digest and string.

Defined results: null url or none with ``://``: host and path are empty, no rule, the
default verdict.  Rows are kept one for one, repeats included; an empty table gives an empty
table; of rules with equal text the last stands; input columns other than id and url are
not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, table

MAX_RULES = 5_000_000
MAX_BYTES = 512 << 20

#: The rules that the query judges by.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def path_start(rule: str) -> int:
    """Where a rule's path begins (its length, if it has none)."""
    k = rule.find("/")
    return len(rule) if k < 0 else k


class DigestArray:
    """Sorted digests with the strings and verdicts they stand for."""

    def __init__(self, keys, ends, blob, allow):
        self.keys, self.ends, self.blob, self.allow = keys, ends, blob, allow

    @staticmethod
    def build(rules: Iterable[tuple[str, str]]) -> "DigestArray":
        texts = dict(rules)
        raw = [t.encode() for t in texts]
        keys = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
        order = np.argsort(keys, kind="stable")
        raw = [raw[i] for i in order]
        verdicts = list(texts.values())
        return DigestArray(
            keys[order],
            np.cumsum([len(r) for r in raw], dtype=np.int64),
            np.frombuffer(b"".join(raw), np.uint8),
            np.array([verdicts[i] == "allow" for i in order], np.uint8),
        )

    def save(self, folder: str, name: str) -> list[str]:
        paths = []
        for part in ("keys", "ends", "blob", "allow"):
            paths.append(os.path.join(folder, f"{name}.{part}.npy"))
            np.save(paths[-1], getattr(self, part))
        return paths

    @staticmethod
    def open(paths: list[str]) -> "DigestArray":
        return DigestArray(*(np.load(p, mmap_mode="r" if os.path.getsize(p) > 128 else None) for p in paths))

    def text(self, i: int) -> bytes:
        return self.blob[(self.ends[i - 1] if i else 0) : self.ends[i]].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Index of each probe, or -1.  Equal digests stand together; each is confirmed by its string."""
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        digests = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        for p in hit:
            i = int(at[p])
            while i < len(self.keys) and self.keys[i] == digests[p]:
                if self.text(i) == probes[p]:
                    out[p] = i
                    break
                i += 1
        return out


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds host and path: host up to ``/ ? #``, A-Z lower-cased; path up to ``? #``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return df.withColumn("host", lower_ascii(part(1))).withColumn("path", part(2))


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Strings of rules that would fit: host suffixes at label edges x path prefixes."""
    if not host:
        return []
    hosts, k = [host], host.find(".")
    while k >= 0:
        if k + 1 < len(host):
            hosts.append(host[k + 1 :])
        k = host.find(".", k + 1)
    return [h + path[:n] for h in hosts for n in lengths if n <= len(path)]


def _lengths(rules: Iterable[str]) -> list[int]:
    return sorted({len(r) - path_start(r) for r in rules})


def filter_urls(
    df: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """id, host, path, rule, verdict: the longest fitting rule's verdict, else ``default``."""
    spark = df.sparkSession
    rules = list(dict(rules).items())  # of equal rules the last stands, on either path
    if len(rules) > MAX_RULES or sum(len(r) for r, _ in rules) > MAX_BYTES:
        return filter_urls_by_join(df, spark.createDataFrame(rules, "rule string, verdict string"), id_col, url_col, default)
    lengths = _lengths(r for r, _ in rules)
    folder = tempfile.mkdtemp()  # the driver's own; Spark's file server hands the files out
    names = []
    for p in DigestArray.build(rules).save(folder, f"digests-{os.path.basename(folder)}"):
        spark.sparkContext.addFile(p)
        names.append(os.path.basename(p))

    def judge(batches):
        digests = DigestArray.open([SparkFiles.get(n) for n in names])
        for b in batches:
            probes, owner = [], []
            for i, (h, p) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist())):
                c = candidates(h, p, lengths)
                probes += c
                owner += [i] * len(c)
            found = digests.find([p.encode() for p in probes])
            rule, verdict = [None] * b.num_rows, [default] * b.num_rows
            for k in np.flatnonzero(found >= 0):
                i = owner[k]
                if rule[i] is None or len(probes[k]) > len(rule[i]):
                    rule[i], verdict[i] = probes[k], "allow" if digests.allow[found[k]] else "block"
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    parts = split_url(df.select(id_col, url_col), url_col).select(id_col, "host", "path")
    kind = dict(df.dtypes)[id_col]
    return parts.mapInArrow(judge, f"{id_col} {kind}, host string, path string, rule string, verdict string")


def filter_urls_by_join(
    df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """The same rows for rule lists of any size: candidates join on digest and string.

    ``rules`` has the columns rule and verdict and no order: of equal rules, which
    ``filter_urls`` merges before, a block stands.  Distinct (host, path) pairs are judged once,
    so that a host with a third of all urls makes no hot join key of its own.
    """
    rules = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    slash = F.when(F.instr("rule", "/") > 0, F.instr("rule", "/") - 1).otherwise(F.length("rule"))
    lengths = [r[0] for r in rules.select((F.length("rule") - slash).alias("n")).distinct().collect()]  # <= longest path
    parts = split_url(df.select(id_col, url_col), url_col).select(id_col, "host", "path")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    wide = parts.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).filter("suffix <> ''")
    probes = wide.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]))).filter(
        F.col("n") <= F.length("path")
    )
    probes = probes.select("host", "path", F.concat("suffix", F.substring("path", F.lit(1), F.col("n"))).alias("rule"))
    hits = probes.withColumn("digest", F.xxhash64("rule")).join(
        rules.withColumn("digest", F.xxhash64("rule")), ["digest", "rule"]
    )
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("best")
    )
    return parts.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of ``pages`` by RULES."""
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


_VALUES = ", ".join(f"('{r}', '{v}')" for r, v in RULES)

QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE = {
    "op4_url_filter": f"""
WITH rules(rule, verdict) AS (VALUES {_VALUES}),
r AS (SELECT rule, verdict, regexp_extract(rule, '^[^/]*') AS rhost, regexp_extract(rule, '/.*$') AS rpath FROM rules),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages)
SELECT p.page_id, p.host, p.path,
  (SELECT arg_max(rule, length(rule)) FROM r
    WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rule)) FROM r
    WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)), 'allow') AS verdict
FROM p"""
}

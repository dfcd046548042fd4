"""Token counts by a digest cache.

A text's count is stored under (tokenizer version, digest of the normalised text) in a Parquet
table.  A run joins the digests of its documents to the stored ones, encodes each distinct
missing text once, appends those counts, and joins again.  The tokenizer's version is the digest
of its model file, so another file never reads another's counts.

Normalised is what the model's own normaliser makes of a text, and nothing else, so equal
normalised texts have equal counts.  For the models meant here (identity normaliser, white
space kept, escaped) that is the text with its spaces as U+2581; a model with any other
normaliser gets its texts byte for byte.

Two runs that miss the same text at once append it twice; the cache is read once for each
digest, so neither rows nor counts change.  A text that many rows share is dropped to one row per
input partition before the shuffle on the digest, so it makes no large shuffle partition; only
misses carry their text.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows stand one for one,
repeats included; repeated rows of the cache count once; an empty table gives an empty result and
leaves the cache as it is; other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

LIMIT = 4096
_CACHE = "digest binary, n_tokens long"
_MODELS: dict = {}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


#: How the model writes a space.
ESCAPED = "\u2581"


def escapes_only(path: str) -> bool:
    """Whether the model's normaliser does nothing but write spaces as U+2581 and put one in front."""
    probe = " a  B\u00e9 e\u0301 \ufb01\t\n\u3000\u2581 "
    return _model(path).normalize(probe) == ESCAPED + probe.replace(" ", ESCAPED)


def _model(path: str):
    """One model per worker process."""
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame | None:
    """The stored counts, one row a digest."""
    try:
        stored = spark.read.schema(_CACHE).parquet(f"{cache_dir}/{version}")
    except AnalysisException:  # nothing stored yet
        return None
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def distinct_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest is new in this partition."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for d in b.column("digest").to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield b.filter(pa.array(keep))


def with_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and the digest of the normalised text."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    normal = F.translate("text", " ", ESCAPED) if escapes_only(path) else F.col("text")
    return text.withColumn("digest", F.unhex(F.sha2(normal, 256)))


def fill_cache(keyed: DataFrame, path: str, cache_dir: str) -> None:
    """Appends the counts of the texts of (digest, text) that are not stored yet, each encoded once."""
    spark, version = keyed.sparkSession, tokenizer_version(path)
    stored = read_cache(spark, cache_dir, version)

    def encode(batches):
        model = _model(path)
        for b in distinct_in_partition(batches):
            counts = [len(model.encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    once = keyed.select("digest", "text").mapInArrow(distinct_in_partition, "digest binary, text string").repartition("digest")
    if stored is not None:  # texts move once: the join takes them as they have been dealt
        once = once.join(stored.hint("merge"), "digest", "left_anti")
    once.mapInArrow(encode, _CACHE).write.mode("append").parquet(f"{cache_dir}/{version}")


def count_tokens(docs: DataFrame, path: str, cache_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each (doc_id, text); new counts are appended to the cache."""
    keyed = with_digest(docs, path)
    fill_cache(keyed, path, cache_dir)
    sizes = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(read_cache(docs.sparkSession, cache_dir, tokenizer_version(path)), "digest").select("doc_id", "n_bytes", "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every document.

    The cache is new and filled in two runs: first with the texts whose digest begins with four
    0 bits, as an earlier run would have left them, then for the whole table, which finds those.
    """
    docs, path, cache = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), shared_dir(spark)
    fill_cache(with_digest(docs, path).filter(F.hex("digest") < "1"), path, cache)
    return count_tokens(docs, path, cache).withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}

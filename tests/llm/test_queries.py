"""The registered queries of the numbered operators: every column of the contract, over whole tables."""

import collections
import hashlib
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers

import __spark_entry__
from evidentia import llm
from evidentia.llm import bpe, language_id

from .test_operators import SF, brute_components, check_fingerprints, removed

sha = lambda b: hashlib.sha256(b).hexdigest()
crc = lambda i: zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def test_all_are_there_and_the_rest_does_without():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_op1(spark, rows):
    check_fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))
    got = run(spark, "op1_fingerprints")
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.fingerprint and r.edited_fingerprint for r in got)


def test_op2(spark, rows):
    own = bpe.loaded(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = {i: library.encode_ordinary(t or "") for i, t in rows}
    want = sorted((i, len(ids[i]), sha(np.array(ids[i], "<u4").tobytes()), sha((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op2_bpe")) == want


def test_op3(spark, rows):
    want = [(i, n, gone, spans, sha(kept)) for i, n, gone, spans, kept in removed(rows)]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op3_suffix_dedup")) == want


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = c.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    ours = __spark_entry__.queries()[name](spark, SF)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(str([r[k] for k in columns]) for r in ours.collect()) == sorted(str(list(r)) for r in got.fetchall())


def test_op5(spark, rows):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = run(spark, "op5_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in held if not y) <= 1  # clean documents are left alone


def test_op7(spark, rows):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, "op7_jaccard_join")) == brute_components(rows, 4, Fraction(85, 100))


def test_op8(spark, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in rows:
        n = len(model.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op8_token_counts")) == sorted(want)


def test_op9(spark, rows):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    letters = {i: any(c.isalpha() for c in t or "") for i, t in rows}
    got = run(spark, "op9_language_id")
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and (r.lang_pred == language_id.UNKNOWN) == (not letters[r.doc_id]) for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] and letters[r.doc_id]]
    assert sum(held) >= 0.97 * len(held)


def test_op10(spark, rows):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in run(spark, "op10_packing"):
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(got) == len(rows)
    for i, t in rows:
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024

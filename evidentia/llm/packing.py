"""Harmonic packing: fixed-length training sequences without a global bin search.

A document's ids are cut into whole sequences and a rest; the rest is cut at powers of two
down to ``least``, and what is left (below ``least``) stays one piece.  A piece of length s
belongs to the reciprocal class k = capacity // s, and each bin of class k takes exactly k
pieces: the powers of two fill their bins to the last place, the small pieces leave at most
capacity / (k + 1) with k >= capacity / least.  Classes fill independently, and every Spark
partition fills its own bins, so packing needs no shuffle and its state is one open bin a
class.  When a partition ends, the pieces in its open bins are laid end to end and cut at
the capacity; the last stretch is cut into sequences of powers of two, which are not padded.

``sequence_id`` is the partition's number in the upper bits and a count in the lower ones.

Defined results: null text is empty and gives one piece, the final id 0; equal documents are
packed each by itself; an empty table gives no pieces; a null doc_id is carried along; other
input columns are not read.  Ids are those of the tokenizer file's library with
add_special_tokens=False (the rank file of the same vocabulary gives the same ids; the
special string inside a text is its own id, as the library has it).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import loaded
from .common import table

CAPACITY, LEAST = 1024, 64
END_ID = b"\0\0\0\0"
#: The special string of the byte_bpe_50k vocabulary and its id.
SPECIALS = (("<|endoftext|>", 50256),)

_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Bins of one partition.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, least: int = LEAST):
        self.capacity, self.least, self.next_id = capacity, least, first_id
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self.close([(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        size = self.capacity // 2
        while at < total:
            rest = total - at
            if size >= self.least and rest < size:
                size //= 2
                continue
            n = size if size >= self.least else rest
            pieces = self.open.setdefault(k := self.capacity // n, [])
            pieces.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
            if len(pieces) == k:
                self.close(self.open.pop(k))
            at += n

    def finish(self) -> None:
        """Lay the pieces of open bins end to end; nothing but the last stretch falls short."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in rest)
        room, bin_ = 0, []
        for doc, start, ids, total in rest:
            at, n = 0, len(ids) // 4
            while at < n:
                if not room:
                    room = min(self.capacity, 1 << (left.bit_length() - 1))
                take = min(room, n - at)
                bin_.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                at += take
                room -= take
                left -= take
                if not room:
                    self.close(bin_)
                    bin_ = []

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(
    docs: DataFrame, path: str, specials: tuple = SPECIALS, capacity: int = CAPACITY, least: int = LEAST
) -> DataFrame:
    """One row per piece of each (doc_id, text); ``capacity`` and ``least`` are powers of two."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, specials, library=True)
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, least)
        id_type = None

        def out(rows):
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:]]
            return pa.RecordBatch.from_arrays(arrays, _FIELDS)

        for b in batches:
            id_type = b.schema.field("doc_id").type
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                for d, i in zip(part.column("doc_id").to_pylist(), ids):
                    packer.add(d, i + END_ID)
                if rows := packer.take():
                    yield out(rows)
        packer.finish()
        if rows := packer.take():
            yield out(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}

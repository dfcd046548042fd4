"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

The split pattern of the public rank files is worked out without a regular expression.
Each code point gets a class (letter, number, space, other white space, other, apostrophe
of a possible contraction, end of text) by an array lookup.  The pattern is then a finite
automaton of eight states over these classes.  Its transition functions are closed under
composition, so each function has a number and composition is a table; a blocked scan
composes the functions of whole columns of code points at once (composition is associative,
so blocks go in parallel), which gives the state before every code point and with it every
boundary.  Texts of a batch are scanned together; the end-of-text class maps all states to
the start, so no token crosses documents.

Slices between boundaries go through a bounded cache to their ids; only distinct misses are
merged, by a heap of pairs in O(n log n) for a slice of n bytes.  The byte offset of each slice is
retained, and with it that of each of its ids: decoding copies the bytes of every id to its
offset, so any stretch of a text is decoded from its own ids alone (``decode_part``).

Defined results: null text is empty and has no ids; empty texts give 0 tokens and the digest
of nothing; rows stand one for one, repeats included; other input columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import struct
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, WHITE, APOS2, APOS3, END, SPACE_LAST, WHITE_LAST = range(10)
# States: what the code point before belongs to.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LEADING, IN_WHITE, TAIL2, TAIL1 = range(8)

#: What may follow an apostrophe to make a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space of the pattern, besides Unicode's separators.
WHITE_SPACE = (*range(9, 14), 32, 0x85)

_BLOCK = 64


def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            kinds[c] = LETTER
        elif k[0] == "N":
            kinds[c] = NUMBER
        elif k[0] == "Z":
            kinds[c] = WHITE
    kinds[list(WHITE_SPACE)] = WHITE
    kinds[32] = SPACE
    return kinds


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this code point."""
    if kind == END:
        return START, True
    if state in (TAIL2, TAIL1):  # inside a contraction, whatever the letters are
        return (TAIL1 if state == TAIL2 else START), False
    if kind in (LETTER, NUMBER):
        own = IN_LETTERS if kind == LETTER else IN_NUMBERS
        return own, state not in (own, LEADING)
    if kind in (OTHER, APOS2, APOS3):
        if state in (IN_OTHERS, LEADING):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, APOS2: TAIL1, APOS3: TAIL2}[kind], True
    if kind in (SPACE, WHITE):  # more white space follows, or the text ends
        return IN_WHITE, state != IN_WHITE
    # The last of a run before other text: a space leads that text, another stands alone.
    return (LEADING if kind == SPACE_LAST else START), True


class Automaton:
    """Transition functions by number, their compositions, and the scan."""

    def __init__(self):
        kinds, states = range(10), range(8)
        self.starts = np.array([[_step(s, k)[1] for k in kinds] for s in states])
        functions = {tuple(states): 0}
        basic = [tuple(_step(s, k)[0] for s in states) for k in kinds]
        todo = list(dict.fromkeys(basic))
        while todo:
            f = todo.pop()
            if f not in functions:
                functions[f] = len(functions)
                todo += [tuple(g[f[s]] for s in states) for g in basic]
        every = list(functions)
        self.of_kind = np.array([functions[b] for b in basic], np.int32)
        n = self.size = len(every)
        self.then = np.array([functions[tuple(g[f[s]] for s in states)] for f in every for g in every], np.int32)
        self.apply = np.array(every, np.uint8)
        assert self.then.size == n * n

    def boundaries(self, kinds: np.ndarray) -> np.ndarray:
        """True where a token starts, for an array of classes that begins after an END."""
        n = len(kinds)
        rows = -(-n // _BLOCK)
        padded = np.full(rows * _BLOCK, END, np.uint8)
        padded[:n] = kinds
        columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
        whole = np.zeros(rows, np.int32)  # each block's function
        for k in range(_BLOCK):
            whole = self.then[whole * self.size + self.of_kind[columns[k]]]
        step = 1  # prefix compositions over the blocks, doubling
        while step < rows:
            whole[step:] = self.then[whole[:-step] * self.size + whole[step:]]
            step *= 2
        state = np.zeros(rows, np.uint8)
        state[1:] = self.apply[whole[:-1], START]
        marks = np.empty((_BLOCK, rows), bool)
        next_state = self.apply[self.of_kind]
        for k in range(_BLOCK):
            marks[k] = self.starts[state, columns[k]]
            state = next_state[columns[k], state]
        return marks.T.reshape(-1)[:n]


class ByteBPE:
    """Encoder and decoder over a table of ranks (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], specials: dict[str, int] | None = None, cache_size: int = 400_000):
        self.ranks, self.specials, self.cache_size = ranks, specials or {}, cache_size
        self.cache: dict[str, bytes] = {}
        self.kinds, self.automaton = _classes(), Automaton()
        names = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.specials.items()}
        size = max(names) + 1
        self.table = [names.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(b) for b in self.table], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.table), np.uint8)
        self.slice_ids = lambda p: self.merge(p.encode("utf-8", "surrogatepass"))

    @staticmethod
    def from_file(path: str, specials: dict[str, int] | None = None) -> "ByteBPE":
        with open(path, "rb") as f:
            return ByteBPE({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, specials)

    def code_classes(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Classes of code points; ``ends`` are the positions of the ends of texts."""
        kinds = self.kinds[points]
        kinds[ends] = END
        after = np.full(len(points) + 2, -1, np.int64)
        after[: len(points)] = points
        after[ends] = -1
        spots = np.flatnonzero((points == ord("'")) & (kinds == OTHER))
        for tail in CONTRACTIONS:
            fits = np.ones(len(spots), bool)
            for k, ch in enumerate(tail):
                fits &= after[spots + 1 + k] == ord(ch)
            kinds[spots[fits]] = APOS2 if len(tail) == 1 else APOS3
        white = (kinds == SPACE) | (kinds == WHITE)
        last = np.zeros(len(kinds), bool)
        last[:-1] = white[:-1] & ~white[1:] & (kinds[1:] != END)
        kinds[last & (kinds == SPACE)] = SPACE_LAST
        kinds[last & (kinds == WHITE)] = WHITE_LAST
        return kinds

    def slices(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """Joined texts, starts of all slices, and the first slice of each text (len + 1).

        A separator stands after each text and is itself the last slice of that text.
        """
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        starts = np.flatnonzero(self.automaton.boundaries(self.code_classes(points, ends)))
        first = np.zeros(len(texts) + 1, np.int64)
        first[1:] = np.searchsorted(starts, ends) + 1
        return joined, starts, first

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one slice: the pair of least rank, leftmost first, is joined until none is left."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        return self._merge_short(raw) if len(raw) <= 48 else self._merge_long(raw)

    def _merge_short(self, raw: bytes) -> list[int]:
        rank, none = self.ranks.get, 1 << 40
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        pairs.append(none)
        while (least := min(pairs)) < none:
            i = pairs.index(least)
            joined = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], pairs[i + 1 if i + 2 == len(pairs) else i]
            last = len(parts) - 1
            pairs[i] = rank(joined + parts[i + 1], none) if i < last else none
            if i:
                pairs[i - 1] = rank(parts[i - 1] + joined, none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        ranks, n = self.ranks, len(raw)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(raw[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prv[i] >= 0 and (r := ranks.get(raw[prv[i] : stop])) is not None:
                heapq.heappush(heap, (r, prv[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = nxt[i]
        return out

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, whatever stands in it."""
        joined, starts, first = self.slices(texts)
        cuts = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        pieces.append("\0")
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        merge = self.slice_ids
        for p in set(pieces).difference(cache):
            ids = merge(p)
            cache[p] = struct.pack(f"<{len(ids)}I", *ids)
        coded = list(map(cache.__getitem__, pieces))
        bounds = first.tolist()
        self.last = joined, starts, first, coded
        return [b"".join(coded[a : b - 1]) for a, b in zip(bounds, bounds[1:])]

    def _offsets(self) -> list[bytes]:
        """Of the texts that were encoded last: the byte offset of each id in its text."""
        joined, starts, first, coded = self.last
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        at = np.append(0, np.cumsum(width))[starts]  # of each slice, in bytes
        count = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]  # of each id, if slices stood end to end as their ids do
        before = np.cumsum(count) - count
        begins += np.repeat(at - begins[before], count)
        text = np.repeat(np.arange(len(first) - 1), np.add.reduceat(count, first[:-1]))
        begins = (begins - at[first[:-1]][text]).astype("<u4")
        edge = np.append(before, len(ids))[first]
        return [begins[a : b - 1].tobytes() for a, b in zip(edge, edge[1:])]  # without the separator

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Strings of ``specials`` inside a text stand for their own ids.
        """
        return [ids for group in self._groups(texts) for ids in self._group(group)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text and their byte offsets in it, both little-endian unsigned 32-bit; no specials."""
        return [pair for group in self._groups(texts) for pair in zip(self._ordinary(group), self._offsets())]

    @staticmethod
    def _groups(texts: list[str]):
        group, size = [], 0
        for t in texts:  # about a million characters are scanned together
            group.append(t)
            size += len(t)
            if size > 1 << 20:
                yield group
                group, size = [], 0
        if group:
            yield group

    def _group(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if not any(s in t for s in self.specials)]
        if len(plain) == len(texts):
            return self._ordinary(texts)
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(plain, self._ordinary([texts[i] for i in plain]) if plain else []):
            out[i] = ids
        (special, number), = self.specials.items()
        mark = np.array([number], "<u4").tobytes()
        for i in set(range(len(texts))).difference(plain):
            out[i] = mark.join(self._ordinary(texts[i].split(special)))
        return out

    def decode(self, ids: bytes, offsets: bytes) -> bytes:
        """The text: each id's bytes, put at its offset."""
        ids, at = np.frombuffer(ids, "<u4").astype(np.int64), np.frombuffer(offsets, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        size = self.lengths[ids]
        out = np.empty(at[-1] + size[-1], np.uint8)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + within] = self.blob[np.repeat(self.places[ids], size) + within]
        return out.tobytes()

    def decode_part(self, ids: bytes, offsets: bytes, start: int, end: int) -> bytes:
        """Bytes ``start`` to ``end`` of the text, from the ids that cover them."""
        at = np.frombuffer(offsets, "<u4").astype(np.int64)
        a, b = max(0, int(np.searchsorted(at, start, "right")) - 1), int(np.searchsorted(at, end))
        if a >= b:
            return b""
        part = self.decode(ids[4 * a : 4 * b], (at[a:b] - at[a]).astype("<u4").tobytes())
        return part[start - at[a] : end - at[a]]


_LOADED: dict[tuple, ByteBPE] = {}


def loaded(path: str, specials: tuple = (), library: bool = False) -> ByteBPE:
    """One encoder per worker process and vocabulary.

    With ``library``, the ids of slices that are not in the cache come from the tokenizer
    library instead of ``merge``: the same ids, sooner.
    """
    key = (path, specials, library)
    if key not in _LOADED:
        bpe = _LOADED[key] = ByteBPE.from_file(path, dict(specials))
        if library:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
            bpe.slice_ids = own.encode_ordinary
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and offsets (little-endian unsigned 32-bit), decoded: for each (doc_id, text)."""

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                coded = bpe.encode_with_offsets([t or "" for t in part.column("text").to_pylist()])
                ids, offsets = ([c[k] for c in coded] for k in range(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(offsets, pa.binary()), pa.array([bpe.decode(*c) for c in coded], pa.binary())],
                    ["doc_id", "n_tokens", "ids", "offsets", "decoded"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, offsets binary, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document by the multi-language rank file."""
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op2_bpe": op2_bpe}
ORACLE: dict[str, str] = {}

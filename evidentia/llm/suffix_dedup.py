"""Suffix-array dedup: bytes covered by a ``length``-byte string of an earlier document.

Every window of ``length`` bytes belongs to its minimizer: the K-byte string in it with the
least hash, the leftmost of equals.  Equal windows have equal minimizers at equal places, so
all equal windows of the corpus meet when the stretches of text (segments) that share a
minimizer are brought together; neighbouring windows with the same minimizer go as one segment.

1. Documents are packed into chunks of about CHUNK bytes, in order of id, and written.  From
   then on (chunk, byte position) names a place, and chunks are what texts are joined by.
2. Each chunk sends 40 bits of its minimizers, once each with the number of its documents that
   have them, to their buckets.  A bucket tells each chunk by one bit a minimizer which of them
   more than one document has, and by another which are hot (HOT documents or more).
3. Chunks compare their segments of shared minimizers byte by byte: equal ones are covered in
   all but the least document, and go on once for the chunk, packed by bucket.  Segments of a
   hot minimizer go as single windows, by the hash of the window, so that a phrase that stands
   in very many contexts is spread over all buckets.
4. A bucket merges equal segments in the same way.  The windows of what is left are searched by
   interval expansion: all windows of a minimizer with the same right end (counted from the
   minimizer) start in one interval, and backward extension by a byte divides it: the bytes
   before its rows, the Burrows-Wheeler column of the present order, are put in order within
   each interval, which maps every row to its place in the next order (last to first).  All
   intervals are expanded together, breadth first, so common suffixes of windows come in
   increasing length; an interval of one row is dropped, the bytes of the minimizer itself are
   stepped over, as all rows share them (which is confirmed), and the expansion stops at
   ``length``.  The intervals that are left are the groups of equal windows; in each, those
   after the least document are covered.
5. Covered stretches go back to their chunks, which cut them out.

All comparisons are of bytes; hashes only bring candidates together.  Memory is bounded by a
chunk, and by a bucket, whose number grows with the shuffle partitions and in which a segment
stands once a chunk.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; of equal
documents all but the one with the least id lose everything (if long enough), and those with
equal ids none on account of each other, be their texts equal or not; rows stand one for one,
but rows with a null id are never earlier than another row and lose nothing; an empty table
gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_buffers, through_files
from .jaccard_join import mix

LENGTH, K = 50, 26
#: Bytes of text of a chunk (a longer text is a chunk of its own), and most rows of one.
CHUNK, CHUNK_ROWS = 4 << 20, 1 << 20
#: From so many documents on (counted up to 255 a chunk) the windows of a minimizer go one by one.
HOT = 8192
#: Windows that are expanded together.
BLOCK = 1 << 20
_SLICE = 1 << 19
_HASH = (1 << 40) - 1
_BASE = np.uint64(0x9E3779B185EBCA87)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODEC = pa.Codec("zstd", 3)
_PAYLOAD = pa.Codec("zstd", 5)


def _powers(base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(_SLICE + 4096, base, np.uint64)))


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def rolling_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on, by doubling."""
    powers, base = raw.astype(np.uint64) + np.uint64(1), _BASE
    out, done, shift = None, 0, 1
    while True:
        if k & shift:
            if out is None:
                out, done = powers, shift
            else:  # the longer stretch follows what is done
                n = len(raw) - done - shift + 1
                with np.errstate(over="ignore"):
                    out = out[:n] * base + powers[done : done + n]
                done += shift
        shift *= 2
        if shift > k:
            return mix(out[: len(raw) - k + 1])
        with np.errstate(over="ignore"):
            powers = powers[: len(powers) - shift // 2] * base + powers[shift // 2 :]
            base = base * base


def minimizers(raw: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-byte strings, and for each window the position of its minimizer."""
    hashes = rolling_hashes(raw, k)
    bits = np.uint64(20)  # a position in a stretch of _SLICE; the same for all, so choices agree
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        n = len(hashes) - width + 1
        least = np.minimum(least[:n], least[width - span : width - span + n])
    return hashes, (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def segments_of(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> list[np.ndarray]:
    """Of all segments, in order: 40 bits of the minimizer, hash of the content, text, first byte,
    size, and where in it the minimizer stands.  Windows do not cross texts."""
    out = []
    for a in range(0, max(int(offsets[-1]) - length + 1, 0), _SLICE):
        b = min(int(offsets[-1]), a + _SLICE + length - 1)
        hashes, place = minimizers(raw[a:b], length, k)
        window = np.arange(a, a + len(place))
        text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.clip(offsets, a, a + len(place))))
        inside = window + length <= offsets[text + 1]
        window, place, text = window[inside], place[inside], text[inside]
        if not len(window):
            continue
        cut = np.ones(len(window), bool)
        cut[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(window)) - 1
        start, place = window[first] - a, place[first]
        size = window[last] - a + length - start
        sums = np.append(np.uint64(0), np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * _UP[: b - a], dtype=np.uint64))
        content = (sums[start + size] - sums[start]) * _DOWN[start]
        small = hashes[place] & np.uint64(_HASH)
        anchor = place - start
        content = mix(content ^ mix(small + (size.astype(np.uint64) << np.uint64(48)) + (anchor.astype(np.uint64) << np.uint64(56))))
        out.append((small, content, text[first], start + a, size.astype(np.int16), anchor.astype(np.int16)))
    if not out:
        return [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int32, np.int64, np.int16, np.int16)]
    return [np.concatenate(x) for x in zip(*out)]


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; a view on a padded copy."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def same_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``sizes`` bytes (eight at least) from a and from b on are equal."""
    same = np.ones(len(a), bool)
    for at in range(0, int(sizes.max()) if len(sizes) else 0, 8):
        step = np.minimum(at, sizes - 8)
        same &= words[a + step] == words[b + step]
    return same


def gathered(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches end to end; a slice of them at a time."""
    put = np.append(0, np.cumsum(sizes, dtype=np.int64))
    out = np.empty(put[-1], np.uint8)
    for i in range(0, len(starts), 10_000):
        j = min(i + 10_000, len(starts))
        at = np.arange(put[j] - put[i]) + np.repeat(starts[i:j] - (put[i:j] - put[i]), sizes[i:j])
        out[put[i] : put[j]] = raw[at]
    return out


def runs(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members of runs, and the run of each member; ``changed`` marks the first members."""
    return np.flatnonzero(changed), np.cumsum(changed) - 1


def differs(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def expand(data: np.ndarray, end: np.ndarray, right: np.ndarray, interval: np.ndarray, length: int, k: int):
    """Windows that are equal to another of their first interval, and the interval of each at the end.

    A window ends at ``end`` and has ``right`` bytes behind its minimizer.  See the module's
    text: each step divides all intervals by the byte before their rows and drops single rows.
    """
    rows = np.arange(len(end), dtype=np.uint64)
    for step in range(-1, length - k):
        if step >= 0:
            column = data[end - 1 - step - np.where(step < right, 0, k)].astype(np.uint64)
            key = (interval << np.uint64(36)) | (column << np.uint64(28)) | np.arange(len(end), dtype=np.uint64)
        else:
            key = (interval << np.uint64(36)) | np.arange(len(end), dtype=np.uint64)
        key = np.sort(key)
        changed = differs(key >> np.uint64(28))
        alone = changed & np.append(changed[1:], True)
        order = (key[~alone] & np.uint64((1 << 28) - 1)).astype(np.int64)
        interval = (np.cumsum(changed[~alone]) - 1).astype(np.uint64)
        rows, end, right = rows[order], end[order], right[order]
        if not len(rows):
            break
    return rows.astype(np.int64), interval.astype(np.int64)


def covered_parts(data: np.ndarray, offs: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, ids: np.ndarray, group: np.ndarray, length: int, k: int):
    """Of different segments in order of their group: (segment, start, end) of the bytes in it
    that windows of a document with a smaller id cover."""
    count = (sizes - length + 1).astype(np.int64)
    whole = np.append(0, np.cumsum(count))
    edges = np.append(np.flatnonzero(differs(group)), len(group))
    a = 0
    while a < len(edges) - 1:  # blocks of whole groups
        b = max(a + 1, int(np.searchsorted(whole[edges[1:]], whole[edges[a]] + BLOCK, "right")))
        own = np.arange(edges[a], edges[b])
        piece = np.repeat(own, count[own])
        within = np.arange(len(piece)) - np.repeat(whole[own] - whole[own[0]], count[own])
        right = within + (length - k) - anchors[piece]
        # the right ends of a group never meet: a group beyond a block is expanded end by end
        sets = [np.arange(len(piece))] if len(piece) <= BLOCK else [np.flatnonzero(right == r) for r in range(length - k + 1)]
        for s in sets:
            start = ((group[piece[s]] - group[own[0]]) * (length - k + 1) + right[s]).astype(np.uint64)
            start = np.unique(start, return_inverse=True)[1].astype(np.uint64)
            rows, interval = expand(data, offs[piece[s]] + within[s] + length, right[s], start, length, k)
            if not len(rows):
                continue
            rows = s[rows]
            first, of = runs(differs(interval))
            doc = ids[piece[rows]]
            later = rows[doc > np.minimum.reduceat(doc, first)[of]]
            if not len(later):
                continue
            later.sort()
            first, _ = runs(differs(piece[later]))
            last = np.append(first[1:], len(later)) - 1
            # windows of a segment overlap, so that what they cover is one stretch
            yield piece[later[first]], within[later[first]], within[later[last]] + length
        a = b


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-, 4-, 2- or 1-byte numbers, compressed, behind their sizes."""
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    head = np.array([len(raw), *(x.nbytes for x in arrays)], np.int64)
    return head.tobytes() + _CODEC.compress(raw, asbytes=True)


def unpacked(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, 1 + len(kinds))
    raw = _CODEC.decompress(pa.py_buffer(blob)[8 * len(head) :], int(head[0]), asbytes=True)
    at = np.append(0, np.cumsum(head[1:]))
    return [np.frombuffer(raw, t, int(n) // np.dtype(t).itemsize, int(a)) for t, n, a in zip(kinds, head[1:], at)]


def steps(hashes: np.ndarray) -> np.ndarray:
    """Differences of ascending 40-bit numbers, byte by byte: the first bytes of all, then the second ones, ..."""
    return np.ascontiguousarray(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T).ravel()


def summed_steps(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(5, -1).T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


_SEGMENTS = (np.int64, np.int16, np.int16, np.int32, np.int64, np.uint8)


def by_bucket(batches):
    """(bucket, list of its rows as tuples) from batches in order of their first column."""
    last, rows = None, []
    for b in batches:
        columns = [c.to_pylist() if i == 0 or pa.types.is_integer(c.type) or pa.types.is_boolean(c.type) else c for i, c in enumerate(b.columns)]
        for row in zip(*columns):
            if row[0] != last:
                if rows:
                    yield last, rows
                last, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield last, rows


def chunk_table(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(chunk, payload), written: documents in order of id as compressed Arrow batches of the
    columns c0.., id and text."""
    rows = docs.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col("doc_id").cast("long").alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def pack(batches):
        task = TaskContext.get().partitionId() << 32
        number, pending, size, count = 0, [], 0, 0

        def flush():
            rows = pa.Table.from_batches(pending).combine_chunks()
            rows = rows.take(pc.sort_indices(rows.column("id"))).combine_chunks()  # nulls last
            return pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), pa.array([sealed(rows)], pa.binary())], ["chunk", "payload"])

        for b in batches:
            total = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            a = base = 0
            while a < b.num_rows:
                z = min(int(np.searchsorted(total, base + CHUNK - size, "right")), a + CHUNK_ROWS - count)
                if z <= a and not pending:
                    z = a + 1
                if z > a:
                    pending.append(b.slice(a, z - a))
                    size, count, base, a = size + int(total[z - 1]) - base, count + z - a, int(total[z - 1]), z
                if a < b.num_rows:
                    yield flush()
                    number, pending, size, count = number + 1, [], 0, 0
        if pending:
            yield flush()

    return through_files(rows.mapInArrow(pack, "chunk long, payload binary"))


def sealed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=_PAYLOAD)) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def opened(payload) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a chunk, and bytes and offsets of all texts."""
    rows = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()
    raw, offsets = text_buffers(rows.column("text"))
    return rows, raw, offsets


def chunk_segments(payload, length: int):
    """A chunk's ids (without nulls), bytes, segments, and its different minimizers with the number of documents that have them."""
    rows, raw, offsets = opened(payload)
    n = len(rows) - rows.column("id").null_count
    segments = segments_of(raw[: offsets[n]], offsets[: n + 1], length)
    each = np.unique((segments[0] << np.uint64(24)) | segments[2].astype(np.uint64)) >> np.uint64(24)
    first, _ = runs(differs(each))
    count = np.diff(np.append(first, len(each)))
    return rows.column("id").slice(0, n).to_numpy(), raw, segments, each[first], count


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 40-bit hashes, in their order."""
    return ((hashes * np.uint64(buckets)) >> np.uint64(40)).astype(np.int64)


def shared_minimizers(chunks: DataFrame, length: int) -> DataFrame:
    """(chunk, flags): for each bucket the bits of the chunk's minimizers that are shared, and that are hot."""
    buckets = 2 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches):
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload")):
                _, _, _, hashes, count = chunk_segments(payload, length)
                cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
                count = np.minimum(count, 255).astype(np.uint8)
                some = np.flatnonzero(np.diff(cuts))
                blobs = [packed(steps(hashes[a:b]), count[a:b]) for a, b in zip(cuts[some], cuts[some + 1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    def meet(batches):
        for bucket, rows in by_bucket(batches):
            hashes, count = [], []
            for _, blob in rows:
                some, times = unpacked(blob.as_py(), (np.uint8, np.uint8))
                hashes.append(summed_steps(some))
                count.append(times)
            cuts = np.append(0, np.cumsum([len(h) for h in hashes]))
            hashes, count = np.concatenate(hashes), np.concatenate(count).astype(np.int64)
            order = np.argsort(hashes)
            first, of = runs(differs(hashes[order]))
            total = np.empty(len(hashes), np.int64)
            total[order] = np.add.reduceat(count[order], first)[of]
            bits = lambda x: [np.packbits(x[a:b]).tobytes() if x[a:b].any() else b"" for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in rows], pa.int64()), pa.array(np.full(len(rows), bucket), pa.int32()), pa.array(bits(total > 1), pa.binary()), pa.array(bits(total >= HOT), pa.binary())],
                ["chunk", "bucket", "shared", "hot"])

    dealt = chunks.mapInArrow(emit, "bucket int, chunk long, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    told = dealt.mapInArrow(meet, "chunk long, bucket int, shared binary, hot binary").filter("length(shared) > 0")
    return told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("flags"))


def flagged(hashes: np.ndarray, flags: list, buckets: int) -> np.ndarray:
    """0, 1 (shared) or 2 (hot) for each of a chunk's different minimizers."""
    cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    out = np.zeros(len(hashes), np.uint8)
    for f in flags or ():
        a, b = cuts[f["bucket"]], cuts[f["bucket"] + 1]
        for bits in (f["shared"], f["hot"]):
            if bits:
                out[a:b] += np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out


def single_windows(raw: np.ndarray, segments: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The windows of segments as segments of their own; the hash of a window takes the place of its minimizer."""
    _, _, text, start, size, anchor = segments
    count = size.astype(np.int64) - length + 1
    of = np.repeat(np.arange(len(start)), count)
    within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = start[of] + within
    value = np.zeros(len(of), np.uint64)
    for j in range(length):
        value = value * _BASE + raw[start + j].astype(np.uint64) + np.uint64(1)
    value = mix(value)
    return [value & np.uint64(_HASH), value, text[of], start, np.full(len(of), length, np.int16), (anchor[of] - within).astype(np.int16)]


def covered_stretches(chunks: DataFrame, length: int = LENGTH) -> DataFrame:
    """(chunk, spans): packed starts and ends of what strings of earlier documents cover."""
    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few, buckets = 2 * partitions, 4 * partitions

    def emit(batches):
        for b in batches:
            for chunk, payload, flags in zip(b.column("chunk").to_pylist(), b.column("payload"), b.column("flags").to_pylist()):
                if flags:
                    yield from chunk_rows(chunk, payload, flags)

    def chunk_rows(chunk, payload, flags):
        ids, raw, segments, hashes, _ = chunk_segments(payload, length)
        kind = flagged(hashes, flags, few)[np.searchsorted(hashes, segments[0])]
        hot = [x[kind == 2] for x in segments]
        segments = [x[kind == 1] for x in segments]
        if len(hot[0]):
            segments = [np.concatenate(x) for x in zip(segments, single_windows(raw, hot, length))]
        hashes, content, text, start, size, anchor = segments
        order = np.argsort(content, kind="stable")  # equal ones stay in order of text, so of id
        first, of = runs(differs(content[order]))
        lead = order[first][of]
        equal = (size[order] == size[lead]) & (anchor[order] == anchor[lead])
        equal[equal] = same_bytes(eights(raw), start[order[equal]], start[lead[equal]], size[order[equal]].astype(np.int64))
        later = equal & (ids[text[order]] > ids[text[lead]])
        local = merged(start[order[later]], (start + size)[order[later]])
        # one content for each run, with all places in its least document; hash collisions stand alone
        places = order[~later]
        head = (np.append(True, of[~later][1:] != of[~later][:-1])) if len(places) else np.zeros(0, bool)
        head |= ~equal[~later]
        if len(places):
            head[1:] |= ~equal[~later][:-1]
        one = places[np.flatnonzero(head)]
        many = np.diff(np.append(np.flatnonzero(head), len(places))).astype(np.int32)
        bucket = bucket_of(mix(hashes[one]) & np.uint64(_HASH), buckets)
        deal = np.argsort(bucket, kind="stable")
        one, bucket = one[deal], bucket[deal]
        put = np.append(0, np.cumsum(many))[:-1][deal]
        many = many[deal]
        where = start[places[np.arange(many.sum()) + np.repeat(put - (np.cumsum(many) - many), many)]]
        ends = np.append(0, np.cumsum(many))
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        blobs = []
        for i in some:
            at = one[cuts[i] : cuts[i + 1]]
            own = slice(cuts[i], cuts[i + 1])
            blobs.append(packed(ids[text[at]], size[at], anchor[at], many[own], where[ends[cuts[i]] : ends[cuts[i + 1]]], gathered(raw, start[at], size[at])))
        if len(local[0]):
            some.append(int(chunk % buckets))
            blobs.append(packed(*local))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk), pa.int64()), pa.array([False] * (len(some) - bool(len(local[0]))) + [True] * bool(len(local[0])), pa.bool_()), pa.array(blobs, pa.binary())],
            ["bucket", "chunk", "local", "blob"])

    def search(batches):
        for _, rows in by_bucket(batches):
            done = [(c, blob.as_py()) for c, local, blob in rows if local]
            done += search_bucket([(c, *unpacked(blob.as_py(), _SEGMENTS)) for c, local, blob in rows if not local], length)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([x for _, x in done], pa.binary())], ["chunk", "spans"])

    with_flags = chunks.join(shared_minimizers(chunks, length), "chunk")
    dealt = with_flags.select("chunk", "payload", "flags").mapInArrow(emit, "bucket int, chunk long, local boolean, blob binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(search, "chunk long, spans binary")


def search_bucket(parts: list[tuple], length: int, k: int = K) -> list[tuple[int, bytes]]:
    """(chunk, packed spans) of what is covered among the segments of a bucket."""
    if not parts:
        return []
    chunk = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    ids, sizes, anchors, many, where, data = (np.concatenate([p[i] for p in parts]) for i in range(1, 7))
    sizes, anchors = sizes.astype(np.int64), anchors.astype(np.int64)
    offs, ends = np.append(0, np.cumsum(sizes))[:-1], np.append(0, np.cumsum(many))
    words = eights(data)
    at = offs + anchors
    marks = [words[at + j] for j in (*range(0, k - 7, 8), k - 8)]  # the bytes of the minimizers
    group = np.zeros(len(ids), np.uint64)
    for m in marks:
        group = mix(group * _BASE + m)
    content = sizes.astype(np.uint64)
    for j in range(0, int(sizes.max()), 8):
        content = mix(content * _BASE + words[offs + np.minimum(j, sizes - 8)])
    order = np.lexsort((ids, content, group))
    new_group = differs(group[order])
    strange = np.zeros(len(order), bool)
    for m in marks:
        strange |= differs(m[order])
    if (strange != new_group).any():  # two minimizers with one hash: put their bytes in order instead
        order = np.lexsort((ids, content, *marks))
        new_group = np.zeros(len(order), bool)
        for m in marks:
            new_group |= differs(m[order])
    before = np.append(order[:1], order[:-1])
    same = ~new_group & (sizes[order] == sizes[before]) & (anchors[order] == anchors[before])
    same[same] = same_bytes(words, offs[order[same]], offs[before[same]], sizes[order[same]])
    first, piece = runs(~same)
    least = ids[order[first]]
    later = ids[order] > least[piece]
    found = [(order[later], np.zeros(int(later.sum()), np.int64), sizes[order[later]])]
    kind = np.cumsum(new_group) - 1
    several = np.bincount(kind, ~same)[kind[first]] > 1
    own = order[first[several]]
    number = np.flatnonzero(several)
    for p, a, b in covered_parts(data, offs[own], sizes[own], anchors[own], ids[own], kind[first[several]], length, k):
        # all rows of the segment that have its least id
        start = np.zeros(len(first), np.int64)
        stop = np.zeros(len(first), np.int64)
        start[number[p]], stop[number[p]] = a, b
        rows = np.flatnonzero((stop[piece] > 0) & ~later)
        found.append((order[rows], start[piece[rows]], stop[piece[rows]]))
    row, start, stop = (np.concatenate([f[i] for f in found]) for i in range(3))
    times = many[row].astype(np.int64)
    place = where[np.arange(times.sum()) + np.repeat(ends[:-1][row] - (np.cumsum(times) - times), times)]
    start, stop, of = place + np.repeat(start, times), place + np.repeat(stop, times), chunk[np.repeat(row, times)]
    deal = np.argsort(of, kind="stable")
    start, stop, of = start[deal], stop[deal], of[deal]
    cuts = np.searchsorted(of, np.arange(len(parts) + 1))
    return [(parts[i][0], packed(*merged(start[a:b], stop[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def remove_repeats(docs: DataFrame, carry: tuple = ("doc_id",), length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """The ``carry`` columns of each row and what is left of its text.

    Adds kept (the bytes that are left, end to end; with ``as_text`` a string, without the
    parts of code points that a cut has left), n_bytes, n_removed and n_spans.
    """
    columns = list(carry)
    chunks = chunk_table(docs, columns)
    spans = covered_stretches(chunks, length).groupBy("chunk").agg(F.collect_list("spans").alias("spans"))
    joined = chunks.join(spans, "chunk", "left").select("payload", "spans")

    def cut(batches):
        for b in batches:
            for payload, spans in zip(b.column("payload"), b.column("spans").to_pylist()):
                yield cut_chunk(payload, spans or ())

    def cut_chunk(payload, spans):
        rows, raw, offsets = opened(payload)
        edge = np.zeros(len(raw) + 1, np.int32)
        for blob in spans:
            a, b = unpacked(blob, (np.int64, np.int64))
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)
        gone = np.cumsum(edge)[:-1] > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        starts = offsets[:-1][(offsets[:-1] < offsets[1:])]
        first[starts] = gone[starts]
        before = np.append(0, np.cumsum(gone))[offsets]
        left = offsets - before
        kept = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(raw[~gone])]).cast(pa.binary())
        if as_text:
            kept = pa.array([k.as_py().decode("utf-8", "ignore") for k in kept], pa.string())
        counts = (np.diff(offsets), np.diff(before), np.diff(np.append(0, np.cumsum(first))[offsets]))
        own = [rows.column(f"c{i}").combine_chunks() for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*own, kept, *(pa.array(x, pa.int64()) for x in counts)], [*columns, *added])

    added = ["kept", "n_bytes", "n_removed", "n_spans"]
    schema = docs.select(columns).schema.add("kept", "string" if as_text else "binary")
    for name in added[1:]:
        schema = schema.add(name, "long")
    return joined.mapInArrow(cut, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when 50-byte strings of earlier documents go."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE: dict[str, str] = {}

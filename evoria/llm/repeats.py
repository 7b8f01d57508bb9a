"""Removal of byte strings that an earlier document has, by the Burrows-Wheeler transform of document collections.

Texts are cut into runs of 50-byte windows that share a minimizer, so equal windows of any documents meet in one
bucket; each bucket is a collection of short strings whose transform is built column by column (``bwt``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from . import windows as W
from ._common import materialize, text_or_empty
from .bwt import sort_suffixes

#: Text bytes that a map task handles at a time, chunks whose strings travel together, string bytes of a bucket aimed at,
#: and of the parts of a bucket that are compared at a time.
CHUNK_BYTES, CHUNKS, BUCKET_BYTES, PART_BYTES = 2 << 20, 4, 11 << 20, 6 << 20
#: Bytes laid end to end at a time.
GATHER = 1 << 20
#: Reduce tasks at most: beyond, a task takes several buckets one after the other.
MOST_TASKS = 20_000
#: Bytes of strings made from a byte of text.
GROWTH = 3.7
#: String bytes that one transform is made of, unless more have one minimizer value.
COLLECTION_BYTES = 1 << 19
#: Least and largest number of bytes before the minimizer in the windows of a class, the farthest class first.
REACHES = [(lo, min(lo + 8, W.PLACES - 1)) for lo in range(0, W.PLACES, 9)][::-1]
NO_SPANS = (np.empty(0, np.int64),) * 4


def _planes(x: np.ndarray) -> bytes:
    """Integers as byte planes, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(data: memoryview, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def pack(parts: list[tuple[np.ndarray, ...]]) -> bytes:
    """One blob of the parts (ids, twins, begin, length, place, body) laid end to end."""
    import zstandard

    ids, twins, begin, length, place, body = (np.concatenate(x) for x in zip(*parts))
    steps = np.diff(ids, prepend=0)
    raw = b"".join([np.int64(len(ids)).tobytes(), _planes(steps), _planes(twins), _planes(begin.astype(np.uint32)), length.astype(np.uint8).tobytes(), place.astype(np.uint8).tobytes(), body.tobytes()])
    return zstandard.compress(raw, 3)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    import zstandard

    raw = memoryview(zstandard.decompress(blob))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8, []
    for dtype in (np.int64, np.int64, np.uint32, np.uint8, np.uint8):
        size = n * np.dtype(dtype).itemsize
        out.append(_from_planes(raw[at : at + size], n, dtype))
        at += size
    ids, twins, begin, length, place = out
    return np.cumsum(ids), twins, begin.astype(np.int64), length.astype(np.int64), place, np.frombuffer(raw[at:], np.uint8)


def _gather(data: np.ndarray, first: np.ndarray, length: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges laid end to end (each followed by ``gap`` zero bytes), and where each starts.

    Places are computed for about ``GATHER`` bytes at a time; they take eight times as much.
    """
    ends = np.cumsum(length.astype(np.int64) + gap)
    starts = ends - length - gap
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    cuts = np.searchsorted(ends, np.arange(GATHER, len(out) + GATHER, GATHER), side="right")
    for a, b in zip([0, *cuts[:-1]], cuts):
        n = length[a:b].astype(np.int64)
        to, shift = np.arange(int(n.sum())), np.cumsum(n) - n
        out[to + np.repeat(starts[a:b] - shift, n)] = data[to + np.repeat(first[a:b] - shift, n)]
    return out, starts


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``data[a:a+length]`` and ``data[b:b+length]`` are the same bytes; lengths are 8 or more."""
    words = W.words64(data)
    ok = np.ones(len(a), bool)
    for off in range(0, int(length.max(initial=0)), 8):
        o = np.minimum(off, length - 8)
        ok &= words[a + o] == words[b + o]
    return ok


def first_of_equal(data: np.ndarray, first: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each range, the first range in order with the same bytes (itself if none)."""
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    rep = index[inverse]
    other = np.flatnonzero(rep != np.arange(len(rep)))
    same = length[other] == length[rep[other]]
    same[same] = equal_ranges(data, first[other[same]], first[rep[other[same]]], length[other[same]])
    rep[other[~same]] = other[~same]
    return rep


def cut_chunk(ids: np.ndarray, twins: np.ndarray, texts: list[bytes], n_buckets: int):
    """Parts of a chunk of documents: (bucket, kind 0, strings) and (bucket, kind 1, spans decided inside the chunk), as
    arrays that ``pack`` takes.

    Of equal strings in the chunk only those of the least id travel; the others are known to repeat it.
    """
    order = np.lexsort((twins, ids))
    ids, twins, texts = ids[order], twins[order], [texts[i] for i in order]
    size = np.array([len(t) for t in texts], np.int64)
    doc_end = np.cumsum(size)
    doc_start = doc_end - size
    data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    first, end, least, place = W.runs(data, doc_start, doc_end)
    if not len(first):
        return
    doc = np.searchsorted(doc_end, first, side="right")
    stop = end + W.WIDTH - 1
    rep = first_of_equal(data, first, stop - first, W.SpanHash(data).of(first, stop))
    known = ids[doc] > ids[doc[rep]]
    at = np.flatnonzero(known)
    if len(at):
        d = doc[at]
        none = np.zeros(len(at), np.int64)
        body = np.stack([first[at] - doc_start[d], stop[at] - doc_start[d]], 1).astype(np.uint32).view(np.uint8).ravel()
        yield int(least[0]) % n_buckets, 1, (ids[d], twins[d], none, none, none, body)
    at = np.flatnonzero(~known)
    bucket = (least[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
    by = np.argsort(bucket, kind="stable")
    at, bucket = at[by], bucket[by]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for group, b in zip(np.split(at, cuts), bucket[np.concatenate([[0], cuts])] if len(at) else []):
        d = doc[group]
        body, _ = _gather(data, first[group], stop[group] - first[group])
        yield int(b), 0, (ids[d], twins[d], (first[group] - doc_start[d]).astype(np.uint32), (stop[group] - first[group]).astype(np.uint8), place[group].astype(np.uint8), body)


def _shared(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each key occurs with more than one id."""
    if not len(keys):
        return np.empty(0, bool)
    order = np.argsort(keys)
    k, d = keys[order], ids[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    starts = np.flatnonzero(new)
    many = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
    out = np.empty(len(keys), bool)
    out[order] = many[np.cumsum(new) - 1]
    return out


def bucket_spans(blobs: list[bytes]):
    """(id, twin, start, end) of the spans of a bucket's strings that repeat a document with a smaller id, part by part.

    Equal windows have one minimizer value, so the values' range is cut into parts that share no window.
    """
    found = [unpack(b) for b in blobs]
    ids, twins, begin, length, place = (np.concatenate([f[i] for f in found]) for i in range(5))
    body = np.concatenate([*(f[5] for f in found), np.zeros(8, np.uint8)])
    del found, blobs
    first = np.cumsum(length) - length
    # strings whose minimizer no other document has cannot repeat one; where a minimizer value stands several times in a
    # string, its place says too little for that
    words, p = W.words64(body), first + (place & 63)
    kmer = (words[p] * W._A) ^ (words[p + 8] * W._B)
    low, many = W.mix(kmer), place >= W.MANY
    odd = np.isin(low, np.unique(low[many])) if many.any() else many
    some = np.flatnonzero(_shared(kmer, ids) | odd)
    del kmer, p
    n_parts = max(1, int(length[some].sum()) // PART_BYTES)
    # other bits than those that chose the bucket
    part = ((low[some].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
    for k in range(n_parts):
        at = some[part == k]
        if len(at):
            yield part_spans(ids[at], twins[at], begin[at], length[at], place[at], low[at], odd[at], _gather(body, first[at], length[at])[0])


def part_spans(ids: np.ndarray, twins: np.ndarray, begin: np.ndarray, length: np.ndarray, place: np.ndarray, low: np.ndarray, odd: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, twin, start, end) of the strings' spans that repeat a document with a smaller id.

    ``low``: the value of a string's minimizer; ``odd``: its place in the string says nothing.
    """
    first = np.cumsum(length) - length
    body = np.concatenate([body, np.zeros(8, np.uint8)])
    p = first + (place.astype(np.int64) & 63)
    hashes = W.SpanHash(body)
    # windows by how far they reach to the left of the minimizer: what all of a class hold must be shared for any to be
    kept = np.empty((len(REACHES), len(ids)), bool)
    for c, (low_reach, high_reach) in enumerate(REACHES):
        some = np.maximum(first, p - high_reach) <= np.minimum(p - low_reach, first + length - W.WIDTH)
        at = np.flatnonzero(some)
        kept[c] = odd
        kept[c, at] |= _shared(hashes.of(p[at] - low_reach, p[at] + W.WIDTH - high_reach), ids[at])
    at = np.flatnonzero(kept.any(0))
    if not len(at):
        return NO_SPANS
    reaches = np.array(REACHES)
    far, near = reaches[kept.argmax(0), 1], reaches[len(REACHES) - 1 - kept[::-1].argmax(0), 0]
    cut = np.where(odd, first, np.maximum(first, p - far))
    end = np.where(odd, first + length, np.minimum(first + length, p - near + W.WIDTH))
    begin, length, first = begin + cut - first, end - cut, cut
    # one string for all its equals, with the least id
    at = at[np.argsort(ids[at], kind="stable")]
    rep = first_of_equal(body, first[at], length[at], hashes.of(first[at], first[at] + length[at]))
    own, string = np.unique(rep, return_inverse=True)
    del hashes
    # equal windows have one minimizer value: collections that share none are transformed one after the other
    by_low = np.argsort(low[at[own]], kind="stable")
    own = own[by_low]
    turn = np.empty(len(by_low), np.int64)
    turn[by_low] = np.arange(len(by_low))
    string = turn[string]
    size, value, own_ids = length[at[own]], low[at[own]], ids[at[own]]
    text, starts = _gather(body, first[at[own]], size, gap=1)
    best = np.full(len(text), np.iinfo(np.int64).max)
    new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    parts = new[np.concatenate([[True], starts[new][1:] // COLLECTION_BYTES != starts[new][:-1] // COLLECTION_BYTES])]
    for a, b in zip(parts, [*parts[1:], len(own)]):
        base, stop = starts[a], starts[b - 1] + size[b - 1] + 1
        where, common = sort_suffixes(text[base:stop], starts[a:b] - base, starts[a:b] + size[a:b] - base, W.WIDTH)
        # suffixes that share a whole window stand together
        heads = np.flatnonzero(common < W.WIDTH)
        of_string = np.repeat(np.arange(a, b), size[a:b] + 1)[where]
        least = np.minimum.reduceat(own_ids[of_string], heads)
        # the least id with the window at each place of the strings
        best[where + base] = np.repeat(least, np.diff(np.append(heads, len(where))))
    # windows of every occurrence
    n = length[at] - W.WIDTH + 1
    which = np.repeat(np.arange(len(at)), n)
    off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hit = best[starts[string[which]] + off] < ids[at[which]]
    which, off = which[hit], off[hit]
    if not len(which):
        return NO_SPANS
    new = np.concatenate([[True], (which[1:] != which[:-1]) | (off[1:] != off[:-1] + 1)])
    s, e = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(which)) - 1
    i = at[which[s]]
    return ids[i], twins[i], begin[i] + off[s], begin[i] + off[e] + W.WIDTH


def repeat_spans(docs: DataFrame, total_bytes: int) -> DataFrame:
    """``id, twin, spans`` (little-endian pairs of 32-bit starts and ends) from ``docs(id, twin, text)``, ids not null."""
    import pyarrow as pa

    n_buckets = max(1, int(total_bytes * GROWTH) // BUCKET_BYTES)

    def cut(batches):
        parts: dict[tuple[int, int], list] = {}

        def read(held):
            for bucket, kind, part in cut_chunk(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), [h[2] for h in held], n_buckets):
                parts.setdefault((bucket, kind), []).append(part)

        def emit():
            rows = [(*at, pack(found)) for at, found in parts.items()]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "data"])

        held, size, chunks = [], 0, 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = row[2].as_py().encode()
                if len(text) < W.WIDTH:
                    continue
                held.append((row[0], row[1], text))
                size += len(text)
                if size >= CHUNK_BYTES:
                    read(held)
                    held, size, chunks = [], 0, chunks + 1
                    if chunks % CHUNKS == 0:
                        yield emit()
        if held:
            read(held)
        if parts:
            yield emit()

    def join(batches):
        def rows(ids, twins, s, e):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(twins, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["id", "twin", "s", "e"])

        held, now = [], None
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(i) for i in range(3))):
                bucket, data = bucket.as_py(), data.as_py()
                if kind.as_py():
                    ids, twins, *_, body = unpack(data)
                    yield rows(ids, twins, *body.view(np.uint32).reshape(-1, 2).T.astype(np.int32))
                    continue
                if bucket != now and held:
                    for found in bucket_spans(held):
                        yield rows(*found)
                    held = []
                now = bucket
                held.append(data)
        for found in bucket_spans(held) if held else ():
            yield rows(*found)

    cut_rows = docs.select("id", "twin", "text").mapInArrow(cut, "bucket int, kind int, data binary")
    found = cut_rows.repartition(min(n_buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(join, "id long, twin long, s int, e int")
    return found.groupBy("id", "twin").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint, not touching ranges that cover the same bytes."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def with_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` as (id, body, spans): the text's bytes, compressed, and the spans of bytes that an earlier document has,
    unmerged, null where there are none. Compressed, texts are a third as large where they are shuffled to their spans.
    """
    if not isinstance(df.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{key} must be an integer: documents are compared by it")
    base = df.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    repeated = base.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id is not null").limit(1).count()
    # rows that share an id are told apart by their text; without such rows nothing has to be carried
    docs = base.withColumn("twin", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = materialize(repeat_spans(docs.filter("id is not null"), total), "repeat-spans")
    named = spans.withColumnsRenamed({"id": "s_id", "twin": "s_twin"})
    packed = docs.mapInArrow(compressed, "id long, twin long, body binary")
    return packed.join(named, (packed["id"] == named["s_id"]) & (packed["twin"] == named["s_twin"]), "left").select("id", "body", "spans")


def compressed(batches):
    """(id, text, twin) as (id, twin, body)."""
    import pyarrow as pa
    import zstandard

    pressed = zstandard.ZstdCompressor(1, write_content_size=True).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("twin"), pa.array([pressed(t.as_py().encode()) for t in batch.column("text")], pa.binary())], names=["id", "twin", "body"])


def remove_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    The key must be an integer (else TypeError). Null and empty texts have no byte. Texts with a null key are left as they are and take nothing from others; rows
    that share a key take nothing from each other. An empty table gives an empty result.
    """
    import pyarrow as pa

    def digest(batches):
        from hashlib import sha256

        from zstandard import decompress

        for batch in batches:
            spans = batch.column(2)
            bounds = spans.offsets.to_numpy()
            flat = spans.values
            starts, ends = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            counts, shas = np.zeros((3, len(batch.column(1))), np.int64), []
            for i, body in enumerate(batch.column(1)):
                body = decompress(body.as_py())
                counts[0, i] = len(body)
                a, b = bounds[i], bounds[i + 1]
                if a == b:
                    shas.append(sha256(body).hexdigest())
                    continue
                h, at = sha256(), 0
                s, e = merge_spans(starts[a:b], ends[a:b])
                for x, y in zip(s.tolist(), e.tolist()):
                    h.update(body[at:x])
                    at = y
                h.update(body[at:])
                counts[1, i], counts[2, i] = (e - s).sum(), len(s)
                shas.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(shas, pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(df, key, text).mapInArrow(digest, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

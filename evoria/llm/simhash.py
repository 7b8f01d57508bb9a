"""SimHash fingerprints and near-duplicate components by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ._common import free_name, materialize
from .components import connected_components

BITS, MAX_BITS, SHINGLE = 64, 3, 3
#: Six blocks: three differing bits leave three blocks whole, so a close pair shares one of the 20 triples of blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TRIPLES = tuple(combinations(range(6), 3))
#: Buckets of more fingerprints are split by three of six blocks of the bits that the bucket does not fix.
LARGE_BUCKET = 4096


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of one text; 0 without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends)], ends[SHINGLE - 1 :])]
    n = len(hashes)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        part = np.array(hashes[at : at + 65536], dtype=np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds ``out`` (the fingerprint's bits as a signed long); null and empty texts have 0."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def of(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return df.withColumn(out, of(F.col(text)))


def _masks() -> list[int]:
    part = [((1 << width) - 1) << low for low, width in BLOCKS]
    return [part[a] | part[b] | part[c] for a, b, c in TRIPLES]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(values: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (``most`` differing bits or fewer) between distinct values."""
    left, edges = values.copy(), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                found = left[near]
                edges.extend((int(x), int(y)) for y in found)
                stack.extend(found)
                left = left[~near]
    return edges


def bucket_edges(values: np.ndarray, mask: int, most: int = MAX_BITS) -> Iterator[tuple[int, int]]:
    """Edges that connect all linked values of a bucket whose members agree on the bits of ``mask``.

    A large bucket is split once more: the free bits go into six parts, and linked values agree on three of them. The
    parts of a bucket fix 48 bits or so, so they hold 2 ** 17 values at most, whatever the data.
    """
    if len(values) <= LARGE_BUCKET:
        yield from forest(values, most)
        return
    free = [b for b in range(BITS) if not mask >> b & 1]
    parts = [sum(1 << b for b in free[i::6]) for i in range(6)]
    for triple in TRIPLES:
        sub = np.uint64(sum(parts[i] for i in triple))
        keys = values & sub
        order = np.argsort(keys, kind="stable")
        ends = np.flatnonzero(np.diff(keys[order])) + 1
        for group in np.split(values[order], ends):
            if len(group) > 1:
                yield from forest(group, most)


def link_edges(prints: DataFrame) -> DataFrame:
    """``a, b``: for distinct fingerprints ``fp``, edges whose components are those of all links."""
    spark_masks = [_signed(m) for m in _masks()]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(spark_masks))))
    rows = prints.select("fp", keys.alias("x")).select("x.t", "x.k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")

    def run(batches):
        import pyarrow as pa

        masks = _masks()
        held: list[np.ndarray] = []
        now: tuple[int, int] | None = None
        out: list[tuple[int, int]] = []

        def close():
            if held and now is not None:
                values = np.unique(np.concatenate(held))
                if len(values) > 1:
                    out.extend(bucket_edges(values, masks[now[0]]))
            held.clear()

        def flush():
            e = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(e[:, 0], e[:, 1])), pa.array(np.maximum(e[:, 0], e[:, 1]))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            # only the first, the last and groups of two or more are looked at one by one
            size = ends - starts
            look = np.flatnonzero(size > 1)
            look = np.unique(np.concatenate([[0], look, [len(size) - 1]]))
            for g in look:
                a, b = starts[g], ends[g]
                at = (int(t[a]), int(k[a]))
                if at != now:
                    close()
                    now = at
                held.append(fp[a:b])
            if len(out) > 50_000:
                yield flush()
        close()
        if out:
            yield flush()

    return rows.mapInArrow(run, "a long, b long").distinct()


def label_fingerprints(docs: DataFrame) -> DataFrame:
    """``fp, component_id, root`` for every distinct ``fp`` of ``docs(id, fp)``: the smallest id reachable over links.

    ``root`` is the component's least fingerprint, which names a component without an id too.
    """
    prints = materialize(docs.groupBy("fp").agg(F.min("id").alias("least")), "simhash-prints")
    edges = materialize(link_edges(prints.select("fp")), "simhash-links")
    comps = connected_components(edges)
    rooted = prints.join(comps, prints["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id`` for every row.

    Null and empty texts have fingerprint zero and are linked like any other. A null key never becomes a component id
    unless no member has one. Equal rows count as they are; an empty table gives an empty result.
    Equal fingerprints are merged before any join; buckets hold distinct fingerprints only and emit a forest, not
    pairs, so groups of copies cost no more than their distinct fingerprints.
    """
    docs = materialize(add_fingerprint(df.select(F.col(key).alias("id"), F.col(text).alias("body")), "body").select("id", "fp"), "simhash-documents")
    labels = label_fingerprints(docs).withColumnRenamed("fp", "label_fp")
    return docs.join(labels, docs["fp"] == labels["label_fp"]).select(F.col("id").alias(key), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


#: The wide fingerprint that finds pairs of a given similarity: bits, and the seed of its hashes and blocks.
WIDE_BITS, WIDE_SEED = 512, 42
#: Share of the pairs at the similarity itself that share a block, and standard deviations of the distance let through.
BLOCK_RECALL, DEVIATIONS = 0.98, 2.0
#: Unrelated fingerprints that a block's bucket should hold: a block has log2(fingerprints) - 5 bits.
BUCKET_LOG2 = 5
#: Buckets of at most so many fingerprints are compared in one step.
SMALL_BUCKET = 64
_LANES = np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Integers whose bits all depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(text: str | None, shingle: int = 5) -> bytes:
    """SimHash of ``WIDE_BITS`` bits of the *set* of word shingles (A-Z as a-z; fewer words: the whole sequence).

    All bits are zero where there is no word. The set's bits are counted in slices, so memory does not follow the text.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return bytes(WIDE_BITS // 8)
    of_word = np.fromiter((xxh64_intdigest(w, WIDE_SEED) for w in words), np.uint64, len(words))
    size = min(shingle, len(words))
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + of_word[i : i + len(rolled)]
    shingles = np.unique(_mixed(rolled))
    ones = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(shingles), 255):
        drawn = _mixed(shingles[at : at + 255, None] + _LANES)
        ones += np.add.reduce(np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def differing_share(similarity: float) -> float:
    """Share of the fingerprint bits in which sets of that Jaccard similarity (and about equal sizes) differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_differing(similarity: float) -> int:
    share = differing_share(similarity)
    return int(np.ceil(WIDE_BITS * share + DEVIATIONS * np.sqrt(WIDE_BITS * share * (1 - share))))


def wide_blocks(n_prints: int, similarity: float) -> np.ndarray:
    """Bit positions, a row for each block: as many blocks as a pair at ``similarity`` needs to share one.

    Width and number follow the number of fingerprints, so that buckets stay small and the recall the same at any size:
    the number of blocks grows with about the fifth root of the fingerprints.
    """
    width = min(max(int(np.ceil(np.log2(max(n_prints, 2)))) - BUCKET_LOG2, 6), 48)
    shared = (1 - differing_share(similarity)) ** width
    n_blocks = int(np.ceil(np.log(1 - BLOCK_RECALL) / np.log1p(-shared)))
    rng = np.random.default_rng(WIDE_SEED)
    # whole permutations are cut up first, so blocks overlap as little as they can
    order = np.concatenate([rng.permutation(WIDE_BITS)[: WIDE_BITS // width * width] for _ in range(-(-n_blocks * width // (WIDE_BITS // width * width)))])
    return order[: n_blocks * width].reshape(n_blocks, width)


def wide_forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (places) of a spanning forest of the links of ``most`` differing bits or fewer; ``prints``: rows of words."""
    near = lambda x, among: np.bitwise_count(among ^ x).sum(-1, dtype=np.int64) <= most
    if len(prints) <= SMALL_BUCKET:
        linked = near(prints[:, None], prints[None])
        if linked.sum() == len(prints):
            return []
        of = lambda i, left: linked[i, left]
    else:
        of = lambda i, left: near(prints[i], prints[left])
    left, edges = np.arange(len(prints)), []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = of(i, left)
            if hit.any():
                found = left[hit].tolist()
                edges.extend((i, j) for j in found)
                stack.extend(found)
                left = left[~hit]
    return edges


def wide_links(prints: DataFrame, n_prints: int, similarity: float) -> DataFrame:
    """``a, b``: edges between ``node``s of ``prints(node, wide)``, distinct fingerprints, that share a block and differ
    in few enough bits. A bucket emits a forest, so a group of near copies gives one edge for each copy, not all pairs.
    """
    import pyarrow as pa

    blocks, most = wide_blocks(n_prints, similarity), most_differing(similarity)
    n_blocks, width = blocks.shape
    weights = np.int64(1) << np.arange(width, dtype=np.int64)

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                node = part.column(0).to_numpy()
                raw = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint8).reshape(-1, WIDE_BITS // 8)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                for i, block in enumerate(blocks):
                    key = bits[:, block] @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), i, np.int32)), pa.array(key), pa.array(node), part.column(1)], names=["block", "bits", "node", "wide"])

    def link(batches):
        held, nodes, now, out = [], [], None, []

        def close():
            if len(nodes) > 1:
                found = np.frombuffer(b"".join(held), np.uint64).reshape(len(nodes), -1)
                out.extend((nodes[i], nodes[j]) for i, j in wide_forest(found, most))
            held.clear()
            nodes.clear()

        def flush():
            e = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(e.min(1)), pa.array(e.max(1))], names=["a", "b"])

        for batch in batches:
            block, bits, node = (batch.column(i).to_pylist() for i in range(3))
            for at in zip(block, bits, node, batch.column(3).to_pylist()):
                if at[:2] != now:
                    close()
                    now = at[:2]
                nodes.append(at[2])
                held.append(at[3])
            if len(out) > 50_000:
                yield flush()
        close()
        if out:
            yield flush()

    rows = prints.select("node", "wide").mapInArrow(spread, "block int, bits long, node long, wide binary")
    return rows.repartition("block", "bits").sortWithinPartitions("block", "bits").mapInArrow(link, "a long, b long").distinct()


def wide_groups(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id, h, root``: for every row its key, its text's hash, and the group of near copies that it belongs to.

    Groups are the components of links between wide fingerprints: pairs whose shingle sets are of ``similarity`` or more
    are linked but for the share that ``BLOCK_RECALL`` and ``DEVIATIONS`` leave out; pairs somewhat below may be, too.
    """
    schema = StructType([StructField("id", df.schema[key].dataType), StructField("h", LongType()), StructField("wide", BinaryType())])

    def of(batches):
        import pyarrow as pa

        # texts leave the batch one at a time: a batch of them as Python strings would be held twice
        for batch in batches:
            wide = pa.array((wide_fingerprint(t.as_py(), shingle) for t in batch.column(2)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), wide], names=schema.names)

    docs = materialize(df.select(F.col(key).alias("id"), text_hash(text).alias("h"), F.col(text).alias("body")).mapInArrow(of, schema), "near-documents")
    prints = materialize(docs.groupBy("wide").agg(F.count(F.lit(1)).alias("n")).select("wide", F.monotonically_increasing_id().alias("node")), "near-prints")
    edges = materialize(wide_links(prints, prints.count(), similarity), "near-links")
    roots = prints.join(connected_components(edges).withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select(F.col("wide").alias("of_wide"), F.coalesce("root", "node").alias("root"))
    return docs.join(roots, F.col("wide") == F.col("of_wide")).select("id", "h", "root")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.octet_length(F.coalesce(F.col(text), F.lit(""))), F.col(text).isNull())


def keep_one_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, with the columns of ``df``: the one with the smallest key.

    A null key comes after all others; where keys repeat in a group, and where a group has none, the text with the least
    hash stays. Rows that agree in key and text are one document, of which one stays. Texts without a word, null ones
    too, are near copies of each other. Groups never share a row, so each keeps one whatever keys repeat. An empty table
    gives an empty result.
    """
    columns, h, best_id, best_h = df.columns, *(free_name(df, n) for n in ("_hash", "_best_id", "_best_hash"))
    best = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h")).alias("best")
    chosen = materialize(wide_groups(df, key=key, text=text, shingle=shingle, similarity=similarity).groupBy("root").agg(best).select(F.col("best.id").alias(best_id), F.col("best.h").alias(best_h)), "near-chosen")
    kept = df.withColumn(h, text_hash(text))
    kept = kept.join(chosen, F.col(h).eqNullSafe(F.col(best_h)) & F.col(key).eqNullSafe(F.col(best_id)), "left_semi")
    return kept.dropDuplicates([h, key]).select(*columns)

"""Exact top-k search by inner product: blocks in the order of their bounds, scored until bounds fall below the k-th."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize

#: Vectors of a block, blocks of a lane (what a task scores at a time), and queries of a chunk.
BLOCK, LANE, CHUNK = 128, 64, 4096
#: Blocks of a query's own cell that give its first k-th score.
FIRST_BLOCKS = 4
#: Pivots at most, and vectors (first by a hash) that they are learned from, for each pivot. Both are bounded, so the
#: sample that reaches the driver is. Cells only order the vectors: all are scored or bounded.
PIVOTS, SAMPLE_OF_PIVOT, ROUNDS = 512, 16, 3
SCALE = 1024
NO_FLOOR = np.iinfo(np.int64).min


def quantize(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, x array<long>``: components floor(scale * x); vectors that are null, empty, or hold null or non-finite components are left out."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    typed = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    return typed.filter((F.size("v") > 0) & F.coalesce(finite, F.lit(False))).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("x"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in floats where they are exact, else in 64-bit integers."""
    largest = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))
    bound = float(largest(a)) * float(largest(b)) * a.shape[1]
    if bound < 2**52:
        kind = np.float32 if bound < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def learn_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of cells: the first ``n`` vectors, moved by a few rounds of k-means."""
    pivots = sample[:n].astype(np.float64)
    for _ in range(ROUNDS):
        cell = nearest_two(sample, pivots)[0]
        counts = np.bincount(cell, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, sample)
        pivots[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return pivots


def nearest_two(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest pivot of each vector (the same one if there is one pivot only)."""
    far = (pivots**2).sum(1) - 2 * (x.astype(np.float64) @ pivots.T)
    first = far.argmin(1)
    if len(pivots) == 1:
        return first, first
    far[np.arange(len(x)), first] = np.inf
    return first, far.argmin(1)


def _cells(prepared: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``dim, cell, id, x``: the cell is made of the two nearest pivots, so that vectors close to each other lie together."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            dims, codes = batch["x"].map(len).to_numpy(np.int64), np.zeros(len(batch), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in pivots:
                    first, second = nearest_two(np.stack(batch["x"].to_numpy()[at]), pivots[dim])
                    codes[at] = first * len(pivots[dim]) + second
            yield pd.DataFrame({"dim": dims.astype(np.int32), "cell": codes, "id": batch["id"], "x": batch["x"]})

    return prepared.mapInPandas(run, "dim int, cell long, id long, x array<long>")


def _narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in the smallest signed type that holds them."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _ints(data: bytes, rows: int) -> np.ndarray:
    """A matrix of ``rows`` rows: one byte for the width of an integer, then the integers."""
    return np.frombuffer(data, np.dtype(f"<i{data[0]}"), offset=1).reshape(rows, -1)


def _bytes(m: np.ndarray) -> bytes:
    m = _narrow(m)
    return bytes([m.itemsize]) + m.astype(m.dtype.newbyteorder("<")).tobytes()


def _pack(cells: DataFrame, rows: int, by_cell: bool, tag: str) -> DataFrame:
    """``dim, name, cell, seq, n, ids, data, low, high, center, radius``: up to ``rows`` neighbours in cell order as one
    matrix, with what bounds need. ``by_cell``: a matrix holds one first-pivot cell. Names are drawn once, when written.
    """

    def row(dim, cell, seq, ids, xs):
        from uuid import uuid4

        m = np.array(xs, np.int64).reshape(-1, dim)
        center = np.rint(m.mean(0))
        radius = float(np.sqrt(((m - center) ** 2).sum(1)).max())
        return (dim, uuid4().hex, cell, seq, len(ids), np.array(ids, np.int64).tobytes(), _bytes(m), _bytes(m.min(0)[None]), _bytes(m.max(0)[None]), _bytes(center.astype(np.int64)[None]), radius)

    names = ["dim", "name", "cell", "seq", "n", "ids", "data", "low", "high", "center", "radius"]

    def run(batches):
        import pandas as pd

        now, seq, ids, xs = None, 0, [], []
        for batch in batches:
            out = []
            for dim, cell, i, x in zip(batch["dim"], batch["cell"], batch["id"], batch["x"]):
                at = (dim, cell if by_cell else 0)
                if ids and (at != now or len(ids) == rows):
                    out.append(row(*now, seq, ids, xs))
                    ids, xs, seq = [], [], seq + 1
                if at != now:
                    now, seq = at, 0
                ids.append(i)
                xs.append(x)
            if out:
                yield pd.DataFrame(out, columns=names)
        if ids:
            yield pd.DataFrame([row(*now, seq, ids, xs)], columns=names)

    return materialize(cells.mapInPandas(run, "dim int, name string, cell long, seq int, n int, ids binary, data binary, low binary, high binary, center binary, radius double"), tag)


def bounds_of(q: np.ndarray, low: np.ndarray, high: np.ndarray, center: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and block a number that no score exceeds: the less of the summed term maxima, and the centre's
    score plus what a vector ``radius`` away can add; a hair more for rounding."""
    q = q.astype(np.float64)
    box = np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)
    ball = q @ center.T.astype(np.float64) + np.sqrt((q * q).sum(1))[:, None] * radius
    bound = np.minimum(box, ball)
    return bound + np.abs(bound) * 1e-9 + 1


def top_of(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each query ``at``, ties to smaller ids."""
    order = np.lexsort((ids, -scores, at))
    start = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]])) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def score_blocks(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, blocks: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query places, ids, scores) that can be in a top k, and how many (query, vector) pairs were scored for that.

    ``blocks``: (ids, matrix, low, high, center, radius). Every query takes the blocks in the order of its own bounds,
    until they fall below its k-th score: ``floor``, or the k-th of what it has found.
    """
    bound = bounds_of(q, *(np.concatenate([b[i] for b in blocks]) for i in (2, 3, 4)), np.array([b[5] for b in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    kth, scored = floor.copy(), 0
    at, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    alive = np.arange(len(q))
    for turn in range(len(blocks)):
        alive = alive[bound[alive, order[alive, turn]] >= kth[alive]]
        if not len(alive):
            break
        which, found = order[alive, turn], []
        for b in np.unique(which):
            asks = alive[which == b]
            b_ids, matrix = blocks[b][0], blocks[b][1]
            product = _product(q[asks], matrix)
            scored += product.size
            row, col = np.nonzero(product >= kth[asks, None])
            other = b_ids[col] != q_ids[asks[row]]
            row, col = row[other], col[other]
            found.append((asks[row], b_ids[col], product[row, col]))
        at, ids, scores = (np.concatenate([x, *(f[i] for f in found)]) for i, x in enumerate((at, ids, scores)))
        top = top_of(at, ids, scores, k)
        at, ids, scores = at[top], ids[top], scores[top]
        # the last of k rows of a query is its k-th
        full = np.flatnonzero(np.bincount(at, minlength=len(q)) == k)
        last = np.searchsorted(at, full, side="right") - 1
        kth[full] = np.maximum(kth[full], scores[last])
    return at, ids, scores, scored


def _unpacked(b) -> tuple:
    return np.frombuffer(b["ids"], np.int64), _ints(b["data"], b["n"]), _ints(b["low"], 1), _ints(b["high"], 1), _ints(b["center"], 1), b["radius"]


def _score(rows: DataFrame, k: int) -> DataFrame:
    """Best of each (chunk, lane) row: ``q_n, q_ids, q_data, floor`` (8 bytes a query, or null) and ``blocks``."""

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids = np.frombuffer(r.q_ids, np.int64)
                floor = np.full(len(q_ids), NO_FLOOR) if r.floor is None else np.frombuffer(r.floor, np.int64)
                at, ids, scores, _ = score_blocks(_ints(r.q_data, r.q_n), q_ids, floor, [_unpacked(b) for b in r.blocks], k)
                yield pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "score": scores})

    return rows.select("q_n", "q_ids", "q_data", "floor", "blocks").mapInPandas(run, "query_id long, vec_id long, score long")


def exact_top_k(df: DataFrame, queries: DataFrame, *, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``df`` with the highest inner product for every row of ``queries``.

    A query's own id is no candidate; ties go to the smaller id; vectors of another length than the query's are no
    candidates. Rows that repeat an id are candidates each, and queries that repeat an id are one query with the rows of
    all. Empty tables give an empty result.

    Vectors are cut into blocks of neighbours. A query first meets a few blocks of its own cell (an equi-join), which
    gives a k-th score; then chunks of queries meet all lanes of blocks, and a block is scored for the queries whose
    bound of it reaches their k-th. Nothing is kept for a (chunk, block) pair.
    """
    prepared = materialize(quantize(df, key, vector), "topk-vectors")
    total = prepared.count()
    drawn = prepared.orderBy(F.xxhash64("id", "x"), "id").limit(min(PIVOTS, -(-total // BLOCK)) * SAMPLE_OF_PIVOT).collect() if total else []
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(r["x"]) for r in drawn}:
        sample = np.array([r["x"] for r in drawn if len(r["x"]) == dim], np.float64)
        pivots[dim] = learn_pivots(sample, max(1, -(-len(sample) // SAMPLE_OF_PIVOT)))
    in_cells = lambda x: _cells(x, pivots).repartitionByRange("dim", "cell", "id").sortWithinPartitions("dim", "cell", "id")
    # the first of two pivots names the cell of a block
    of_first = F.expr("CASE dim " + " ".join(f"WHEN {d} THEN cell div {len(p)}" for d, p in pivots.items()) + " ELSE 0 END") if pivots else F.lit(0)
    blocks = _pack(in_cells(prepared).withColumn("cell", of_first.cast("long")), BLOCK, True, "topk-blocks")
    asked = in_cells(quantize(queries, key, vector).distinct()).withColumn("cell", of_first.cast("long"))
    part = F.struct("n", "ids", "data", "low", "high", "center", "radius")

    def as_queries(packed: DataFrame) -> DataFrame:
        return packed.select("dim", "cell", F.col("name").alias("chunk"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    # blocks of a cell that its queries meet first
    of_cell = Window.partitionBy("dim", "cell").orderBy("name")
    near = blocks.filter(F.col("seq") < FIRST_BLOCKS).withColumn("r", F.row_number().over(of_cell)).filter(F.col("r") <= FIRST_BLOCKS).groupBy("dim", "cell").agg(F.collect_list(part).alias("blocks"))
    first = _score(as_queries(_pack(asked, CHUNK, True, "topk-cell-queries")).join(near, ["dim", "cell"]).withColumn("floor", F.lit(None).cast("binary")), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    kth = materialize(kth, "topk-floors")

    chunks = _chunks(asked.join(kth.withColumnRenamed("id", "k_id"), F.col("id") == F.col("k_id"), "left").drop("k_id"))
    lanes = max(1, -(-blocks.count() // LANE))
    lane = F.pmod(F.xxhash64("name"), F.lit(lanes)).cast("int")
    in_lanes = blocks.groupBy("dim", lane.alias("lane")).agg(F.collect_list(part).alias("blocks"))
    spread = chunks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    found = _score(spread.join(in_lanes, ["dim", "lane"]), k)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunks(asked: DataFrame) -> DataFrame:
    """``dim, q_n, q_ids, q_data, floor`` from ``dim, id, x, floor``: up to ``CHUNK`` queries of one length in a row."""

    def run(batches):
        import pandas as pd

        held: dict[int, list] = {}

        def row(dim, found):
            floor = np.array([NO_FLOOR if f is None or f != f else int(f) for _, _, f in found], np.int64)
            return dim, len(found), np.array([i for i, _, _ in found], np.int64).tobytes(), _bytes(np.array([x for _, x, _ in found], np.int64).reshape(len(found), dim)), floor.tobytes()

        names = ["dim", "q_n", "q_ids", "q_data", "floor"]
        for batch in batches:
            out = []
            for dim, i, x, floor in zip(*(batch.column(c).to_pylist() for c in range(4))):
                rows = held.setdefault(dim, [])
                rows.append((i, x, floor))
                if len(rows) == CHUNK:
                    out.append(row(dim, held.pop(dim)))
            if out:
                yield pa_batch(pd.DataFrame(out, columns=names))
        out = [row(dim, rows) for dim, rows in held.items()]
        if out:
            yield pa_batch(pd.DataFrame(out, columns=names))

    def pa_batch(frame):
        import pyarrow as pa

        return pa.RecordBatch.from_pandas(frame, pa.schema([("dim", pa.int32()), ("q_n", pa.int32()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("floor", pa.binary())]), preserve_index=False)

    packed = asked.select("dim", "id", "x", "floor").mapInArrow(run, "dim int, q_n int, q_ids binary, q_data binary, floor binary")
    return materialize(packed, "topk-chunks")

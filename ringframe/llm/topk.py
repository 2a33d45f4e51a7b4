"""Exact top-k inner products: blocks of documents in the order of their bounds, scored until the bound falls below the k-th score."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, checkpoint, process_cache, sliced
from .vectors import steps, usable

K = 20
EVERY = 20
# Vectors of a block, blocks that a task orders at once, and vectors of a range of blocks (about); ranges are MOST_RANGES at most.
BLOCK = 512
WINDOW = 64
RANGE = 2048
MOST_RANGES = 1024
# Vectors that the order of the index is fitted on, its cells, and bytes of queries that are broadcast at once.
SAMPLE = 8192
CELLS = 64
QUERY_BYTES = 8_000_000
NO_KEY = np.iinfo(np.int64).max
LOW = -NO_KEY


def limit(width: int) -> int:
    """The largest entry with which no score passes 62 bits."""
    return min(2**30, int((2.0**62 / max(1, width)) ** 0.5))


def cells(rows: DataFrame, width: int) -> np.ndarray:
    """Centres of cells by a few rounds of k-means over SAMPLE vectors, the first by a hash; they only order the index."""
    found = rows.select("vector", F.xxhash64("key", "vector").alias("_h")).orderBy("_h").limit(SAMPLE).select("vector").toArrow()
    sample = np.asarray(found.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
    centres = sample[: min(CELLS, max(1, len(sample) // 32))]
    for _ in range(5):
        own = nearest(sample, centres)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The numbers of the two nearest centres of each vector (twice the same if there is one)."""
    far = (centres**2).sum(1) - 2 * vectors @ centres.T
    first = far.argmin(1)
    far[np.arange(len(far)), first] = np.inf if far.shape[1] > 1 else 0
    return np.stack([first, far.argmin(1)], 1)


def blocks(rows: DataFrame, width: int, ranges: int) -> DataFrame:
    """The forward index: blocks of up to BLOCK vectors that follow each other by (nearest cell, second cell, key), in ranges.

    Columns: range, block (int, within the range), keys, matrix (32-bit entries, a row for each vector), high and low (greatest
    and least entry of each dimension).
    """
    centres, most = cells(rows, width), limit(width)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8192, 4_000_000):
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            near = nearest(vectors, centres)
            whole = steps(batch.column(1), width, most).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array((near[:, 0] * CELLS + near[:, 1]).astype(np.int32)), batch.column(0), pa.array([v.tobytes() for v in whole], pa.binary())], names=["cell", "key", "entries"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, left = TaskContext.get().partitionId(), 0, []

        def row(part: pa.Table) -> pa.RecordBatch:
            keys, entries = (part.column(i).combine_chunks() for i in (0, 1))
            matrix = np.frombuffer(b"".join(entries.to_pylist()), "<i4").reshape(-1, width)
            columns = [pa.array([number], pa.int32()), pa.array([block], pa.int32()), pa.array([keys.to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.max(0)]), pa.array([matrix.min(0)])]
            return pa.RecordBatch.from_arrays(columns, names=["range", "block", "keys", "matrix", "high", "low"])

        for batch in batches:
            left.append(batch)
            while sum(b.num_rows for b in left) >= BLOCK:
                whole = pa.Table.from_batches(left)
                yield row(whole.slice(0, BLOCK))
                left, block = whole.slice(BLOCK).to_batches(), block + 1
        if sum(b.num_rows for b in left):
            yield row(pa.Table.from_batches(left))

    dealt = rows.mapInArrow(placed, "cell int, key long, entries binary").repartitionByRange(ranges, "cell", "key").sortWithinPartitions("cell", "key")
    return dealt.select("key", "entries").mapInArrow(packed, "range int, block int, keys array<long>, matrix binary, high array<int>, low array<int>")


def summaries(index: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the ranges and the greatest and least entry of each dimension in them; at most MOST_RANGES rows each way."""
    ends = index.select("range", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "end"))
    found = ends.groupBy("range", "dim").agg(F.max("end.high").alias("high"), F.min("end.low").alias("low")).toPandas().sort_values(["range", "dim"])
    numbers = found.range.to_numpy().reshape(-1, width)[:, 0]
    return numbers, found.high.to_numpy().reshape(-1, width), found.low.to_numpy().reshape(-1, width)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No vector with entries between low and high has a larger inner product with the query (rows: queries)."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def arithmetic(width: int, greatest: int) -> type:
    """The numbers in which sums of `width` products are exact whole numbers."""
    most = width * (greatest + 1) ** 2
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Best:
    """The best k (score, key, row) of each query so far; by falling score, then key, null keys last, then row."""

    def __init__(self, n: int, k: int, score: np.ndarray, key: np.ndarray) -> None:
        self.k, self.floor, self.floor_key = k, score.copy(), key.copy()
        self.at = np.empty(0, np.int64)
        self.score, self.key, self.row = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, keys: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        """Scores of the queries `at` (rows) with the vectors `keys`, `rows` (columns); a query's own row is left out."""
        scores = scores.astype(np.int64)
        floor, floor_key = self.floor[at][:, None], self.floor_key[at][:, None]
        good = (scores > floor) | ((scores == floor) & (keys[None, :] <= floor_key))
        good &= own[:, None] != rows[None, :]
        if len(keys) > self.k + 1:  # own rows may be among the best k + 1
            good &= scores >= np.partition(scores, -self.k - 1, axis=1)[:, [-self.k - 1]]
        i, j = np.nonzero(good)
        if not len(i):
            return
        all_at, all_score, all_key, all_row = (np.concatenate(v) for v in ((self.at, at[i]), (self.score, scores[i, j]), (self.key, keys[j]), (self.row, rows[j])))
        order = np.lexsort((all_row, all_key, -all_score, all_at))
        at_, start = all_at[order], np.searchsorted(all_at[order], all_at[order])
        rank = np.arange(len(order)) - start
        kept = order[rank < self.k]
        self.at, self.score, self.key, self.row = all_at[kept], all_score[kept], all_key[kept], all_row[kept]
        full = order[rank == self.k - 1]
        better = (all_score[full] > self.floor[all_at[full]]) | ((all_score[full] == self.floor[all_at[full]]) & (all_key[full] < self.floor_key[all_at[full]]))
        full = full[better]
        self.floor[all_at[full]], self.floor_key[all_at[full]] = all_score[full], all_key[full]


def score_blocks(index: DataFrame, width: int, greatest: int, sent, name: str, k: int) -> DataFrame:
    """Each task's best k of the blocks whose turn it is, for all queries sent: (query, score, key, row).

    `sent` has the queries (numbers, rows, matrix), each one's floor (the k-th score so far and its key), the ranges'
    ends and the bounds of ranges between which this round lies.
    """
    kind = arithmetic(width, greatest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = process_cache("topk")
        if name not in store:
            store.clear()
            store[name] = {k: v.astype(kind) if k in ("matrix", "high", "low") else v for k, v in sent.value.items()}
        q = store[name]
        n, place = len(q["rows"]), {int(r): i for i, r in enumerate(q["ranges"])}
        of_range = bounds(q["matrix"], q["high"], q["low"]).astype(np.int64)
        turn = (of_range >= q["from"][:, None]) & (of_range < q["to"][:, None])
        best = Best(n, k, q["floor"], q["floor_key"])

        def window(some: list[dict]) -> None:
            if not (wanted := turn[:, [place[b["range"]] for b in some]]).any():
                return
            high, low = (np.stack([b[c] for b in some]).astype(kind) for c in ("high", "low"))
            bound = np.where(wanted, bounds(q["matrix"], high, low).astype(np.int64), LOW)
            order = np.argsort(-bound, axis=1, kind="stable")
            active = np.arange(n)
            for step in range(len(some)):
                now = order[active, step]
                at_step = bound[active, now]
                going = (at_step > LOW) & (at_step >= best.floor[active])
                active, now = active[going], now[going]
                if not len(active):
                    return
                for b in np.unique(now):
                    at, block = active[now == b], some[b]
                    matrix = np.frombuffer(block["matrix"], "<i4").reshape(-1, width).astype(kind)
                    keys = np.array([NO_KEY if v is None else v for v in block["keys"]], np.int64)
                    rows = (np.int64(block["range"]) << 40) + (np.int64(block["block"]) << 12) + np.arange(len(keys))
                    best.add(at, q["matrix"][at] @ matrix.T, keys, rows, q["rows"][at])

        some: list[dict] = []
        for batch in sliced(batches, WINDOW, 16_000_000):
            for block in batch.to_pylist():
                some.append(block)
                if len(some) == WINDOW:
                    window(some)
                    some = []
        if some:
            window(some)
        if len(best.at):
            yield pa.RecordBatch.from_arrays([pa.array(q["numbers"][best.at]), pa.array(best.score), pa.array(best.key), pa.array(best.row)], names=["query", "score", "key", "row"])

    return index.mapInArrow(run, "query long, score long, key long, row long")


def queries_of(index: DataFrame, width: int, every: int) -> DataFrame:
    """(query: its row in the index, key, entries) of the vectors whose key is divisible by `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16, 4_000_000):
            for block in batch.to_pylist():
                matrix = np.frombuffer(block["matrix"], "<i4").reshape(-1, width)
                at = [i for i, v in enumerate(block["keys"]) if v is not None and v % every == 0]
                rows = [(block["range"] << 40) + (block["block"] << 12) + i for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([block["keys"][i] for i in at], pa.int64()), pa.array([matrix[i].tobytes() for i in at], pa.binary())], names=["query", "key", "entries"])

    return index.select("range", "block", "keys", "matrix").mapInArrow(run, "query long, key long, entries binary")


def top_inner_products(rows: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k vectors with the largest inner products for each vector whose key is divisible by `every`, itself left out.

    Entries become floor(64 c). Vectors are put into ranges of blocks by a coarse clustering, and each block has a forward
    index and its greatest and least entries. A query's bound for a block is the sum over dimensions of its entry times the
    one of these that gives more. Queries are broadcast `query_bytes` at a time. A query's ranges are ordered by
    bound: the first thirty-second of them is scored in the first round, then up to a quarter, then all; inside a task blocks
    go by falling bound until it is below the query's k-th score, which starts as that of the rounds before.

    Returns query_id, rank (int, from 1), vec_id, score (long). Ties go to the smaller key, null keys last. Fewer than k
    other vectors give fewer rows. Vectors that are null or have null, NaN or infinite entries, and those not of the most
    common length, take no part. Rows with null keys are candidates only; rows with equal keys are rows of their own, and
    queries too. Entries so large that a score would pass 62 bits count as the largest allowed. Other columns are not read. No
    vectors or vectors without entries give no rows.
    """
    spark = rows.sparkSession
    rows, width = usable(rows, key, vector)
    rows = rows.withColumn("key", F.col("key").cast("long"))
    total = rows.count() if width else 0
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    with Tables(spark) as tables:
        index = tables.keep("index", blocks(rows, width, min(MOST_RANGES, max(1, total // RANGE))))
        ranges, high, low = summaries(index, width)
        greatest = int(max(np.abs(high).max(), np.abs(low).max()))
        asked = tables.keep("queries", queries_of(index, width, every))
        lots = max(1, -(-asked.count() * width * 8 // query_bytes))
        turns = sorted({min(len(ranges), t) for t in (-(-len(ranges) // 32), -(-len(ranges) // 4), len(ranges))})
        results = None
        for lot in range(lots):
            mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(lots)) == lot).orderBy("query").toArrow()
            n = mine.num_rows
            if not n:
                continue
            numbers = mine.column("query").to_numpy()
            matrix = np.frombuffer(b"".join(mine.column("entries").to_pylist()), "<i4").reshape(n, width)
            ordered = np.sort(bounds(matrix.astype(np.int64), high.astype(np.int64), low.astype(np.int64)), axis=1)[:, ::-1]
            floor, floor_key, upper = np.full(n, LOW), np.full(n, NO_KEY), np.full(n, NO_KEY)
            best = None
            for turn in turns:
                lower = ordered[:, turn - 1] if turn < len(ranges) else np.full(n, LOW + 1)
                sent = spark.sparkContext.broadcast({"numbers": numbers, "rows": numbers, "matrix": matrix, "ranges": ranges, "high": high, "low": low, "floor": floor, "floor_key": floor_key, "from": lower, "to": upper})
                found = score_blocks(index, width, greatest, sent, uuid4().hex, k)
                found = found if best is None else best.unionByName(found)
                order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key", "row")
                best = tables.keep(f"best_{lot}", found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
                upper = lower
                if turn < len(ranges):
                    full = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((-F.col("score")).alias("s"), "key")).alias("last")).where(F.col("n") == k)
                    at = full.select("query", "last.s", "last.key").toPandas()
                    place = np.searchsorted(numbers, at["query"].to_numpy())
                    floor, floor_key = floor.copy(), floor_key.copy()
                    floor[place], floor_key[place] = -at.s.to_numpy(), at.key.to_numpy()
            results = best if results is None else results.unionByName(best)
        if results is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key", "row")
        ranked = results.withColumn("rank", F.row_number().over(order)).join(asked.select("query", F.col("key").alias("query_id")), "query")
        return checkpoint(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("key") != NO_KEY, F.col("key")).alias("vec_id"), "score"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against those whose vec_id is divisible by 20; cases as in top_inner_products()."""
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

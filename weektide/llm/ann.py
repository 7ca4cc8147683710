"""Nearest neighbours with a forest of hash prefixes.

A tree gives each vector a string of 64 bits, one for each random plane, and keeps the
strings sorted. A query goes down each tree to the longest prefix it shares with anything
and then up all trees at once, one bit at a time, until the vectors under its prefixes are
enough; these are compared exactly.

The rows are dealt into shards of bounded size, each with its own forest, and the queries
go to all shards in blocks of bounded size, so neither the vectors nor the candidates are
shuffled: a shard answers with at most k rows for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 12
BITS = 64
# Rows of a shard, queries in one broadcast, and rows of the sample that the planes are fitted on.
SHARD_ROWS = 8192
BLOCK_QUERIES = 20_000
SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 256
# Shares of a shard that may be asked for; the smallest that reaches the recall on the sample is taken.
SHARES = [1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0]
RECALL = 0.96


class Planes:
    """Random planes for all trees, each cutting the sample at a random rank, and the share of candidates."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.normals = random.standard_normal((sample.shape[1], TREES * BITS))
        ranks = random.uniform(0.3, 0.7, TREES * BITS)
        places = np.sort(sample @ self.normals, axis=0)
        self.cuts = places[(ranks * len(sample)).astype(int), np.arange(TREES * BITS)]
        self.share = self.needed_share(sample, k)

    def needed_share(self, sample: np.ndarray, k: int) -> float:
        """Smallest share whose candidates hold the true neighbours of sample rows often enough."""
        if len(sample) <= 16 * k:
            return 1.0
        forest = Forest(sample, self)
        queries = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample) // 4)).astype(int)
        for share in SHARES[:-1]:
            found = 0
            for at, candidates in zip(queries, forest.candidates(sample[queries], share)):
                distance = ((sample - sample[at]) ** 2).sum(axis=1)
                distance[at] = np.inf
                true = np.argpartition(distance, k)[:k]
                found += np.isin(true, candidates).sum()
            if found >= RECALL * k * len(queries):
                return share
        return 1.0

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """The 64-bit string of each row in each tree."""
        bits = rows @ self.normals > self.cuts
        return np.packbits(bits.reshape(len(rows), TREES, BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64)


class Forest:
    def __init__(self, rows: np.ndarray, planes: Planes):
        self.planes, self.n = planes, len(rows)
        strings = planes.strings(rows)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def candidates(self, queries: np.ndarray, share: float):
        """Rows under the longest prefixes that hold ``share`` of all rows together, for each query in turn."""
        target = int(np.ceil(share * self.n))
        strings = self.planes.strings(queries)
        depth = np.arange(BITS + 1)
        rest = np.array([(1 << (BITS - d)) - 1 for d in depth.tolist()], np.uint64)
        for string in strings:
            low = np.empty((TREES, BITS + 1), np.int64)
            high = np.empty((TREES, BITS + 1), np.int64)
            for tree in range(TREES):
                low[tree] = np.searchsorted(self.sorted[:, tree], string[tree] & ~rest, side="left")
                high[tree] = np.searchsorted(self.sorted[:, tree], string[tree] | rest, side="right")
            sizes = (high - low).sum(axis=0)
            taken = np.zeros(self.n, bool)
            at = int(np.flatnonzero(sizes >= target).max())
            while True:
                for tree in range(TREES):
                    taken[self.order[low[tree, at] : high[tree, at], tree]] = True
                if at == 0 or taken.sum() >= target:
                    break
                at -= 1
            yield np.flatnonzero(taken)


def nearest(rows: np.ndarray, ids: np.ndarray, norms: np.ndarray, candidates: np.ndarray, query: np.ndarray, own: int, k: int):
    """The k nearest candidates other than the query's own, by exact distance and then by id."""
    candidates = candidates[ids[candidates] != own]
    if len(candidates) > k:
        # A cheaper form of the distance, with room for its rounding, leaves a few to be computed exactly.
        rough = norms[candidates] - 2 * (rows[candidates] @ query)
        limit = np.partition(rough, k - 1)[k - 1]
        candidates = candidates[rough <= limit + 1e-9 * (1 + np.abs(limit) + query @ query)]
    distance = np.sqrt(((rows[candidates] - query) ** 2).sum(axis=1))
    best = np.lexsort((ids[candidates], distance))[:k]
    return ids[candidates[best]], distance[best]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(embedding: Column, size: int | None) -> Column:
    """No missing or non-finite parts, not all zero, and of the common length."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    good = F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(good & (F.size(embedding) == size if size else F.lit(True)), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of each query row, nearest first.

    ``vectors`` has ``vec_id`` and ``embedding``. Rows without an id take no part, nor do
    vectors that are missing, zero, hold missing or non-finite parts, or differ in length
    from the most common one. Repeated rows count once. Ties go to the smaller id. Fewer
    rows than k give all of them; no rows give an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), None))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"))
    common = sizes.orderBy(F.desc("n"), "size").limit(1).first()
    result = "query_id bigint, vec_id bigint, score double"
    found = spark.createDataFrame([], result)
    n_rows, n_asking = (common["n"], common["asking"]) if common else (0, 0)
    if n_asking:
        rows = rows.where(F.size("embedding") == common["size"])
        n_shards = -(-n_rows // SHARD_ROWS)
        picked = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE_ROWS / n_rows)))
        sample = matrix(rows.where(picked).select("embedding").toArrow().column(0)) if n_rows > 1 else np.empty((0, common["size"]))
        if len(sample) == 0:
            sample = np.zeros((1, common["size"]))
        planes = spark.sparkContext.broadcast(Planes(sample, k))
        sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)))
        for number in range(-(-n_asking // BLOCK_QUERIES)):
            block = rows.where("asks").where(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(2)), F.lit(-(-n_asking // BLOCK_QUERIES))) == number)
            asked = block.select("vec_id", "embedding").distinct().toArrow()
            if asked.num_rows:
                queries = spark.sparkContext.broadcast((asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"))))
                found = found.union(sharded.groupBy("shard").applyInArrow(shard_search(planes, queries, k), result))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def shard_search(planes, queries, k: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        rows = matrix(group.column("embedding"))
        once = np.unique(np.c_[ids.view(np.uint64), rows.view(np.uint64)], axis=0, return_index=True)[1]
        ids, rows = ids[once], rows[once]
        norms = (rows**2).sum(axis=1)
        forest = Forest(rows, planes.value)
        asking, wanted = queries.value
        out = [(own, *nearest(rows, ids, norms, c, q, own, k)) for own, q, c in zip(asking, wanted, forest.candidates(wanted, planes.value.share))]
        return pa.table(
            {
                "query_id": pa.array(np.repeat(asking, [len(x[1]) for x in out]), pa.int64()),
                "vec_id": pa.array(np.concatenate([x[1] for x in out]), pa.int64()),
                "score": pa.array(np.concatenate([x[2] for x in out]), pa.float64()),
            }
        )

    return run

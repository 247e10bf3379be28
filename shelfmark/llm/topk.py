"""Exact top-k by inner product: tiles of queries times tiles of rows, partial selection per tile, merged lists.

Queries of QUERY_BYTES at most are broadcast, and each task multiplies them with
its rows tile by tile, keeping the k best of each query. More queries than that
never pass through the driver: they are dealt into tiles and the rows into
shards, each tile meets each shard in one group, and a group is multiplied in
the same way. The lists of tasks or groups meet in a two-step merge by query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import table

#: Bytes of query vectors that are broadcast or make a tile, of rows that make a shard, rows of a step of the product, and queries of a step.
QUERY_BYTES, SHARD_BYTES, ROW_TILE, QUERY_TILE = 16 << 20, 64 << 20, 4096, 1024

#: Components up to here multiply exactly as doubles; rows with larger ones take Python's integers.
EXACT_COMPONENT = float(1 << 20)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are."""
    inf = float("inf")
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf)), F.lit(False))


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v = floor(256 * x) of each component; vectors that take no part and null ids are left out."""
    x = F.col("embedding").cast("array<double>")
    kept = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(c * 256).cast("double")).alias("v")).where(finite(F.col("v")))


def matrices(batch: pa.RecordBatch | pa.Table, id_column: str, vector: str):
    """(ids, matrix) for each length of vector that occurs, rows by id."""
    ids = np.asarray(batch.column(id_column).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(id_column).to_numpy(), np.int64)
    lists = batch.column(vector)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.asarray(lists.value_lengths(), np.int64)
    flat = np.asarray(lists.flatten(), np.float64)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield ids[rows], flat[starts[rows][:, None] + np.arange(d)]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the limits of 64 bits."""
    out = (np.clip(queries, -EXACT_COMPONENT, EXACT_COMPONENT) @ np.clip(rows, -EXACT_COMPONENT, EXACT_COMPONENT).T).astype(np.int64)
    top = np.iinfo(np.int64).max
    exact = lambda a, b: [max(-top, min(top, sum(int(x) * int(y) for x, y in zip(u, w, strict=True)))) for u in a for w in b]
    for i in np.flatnonzero(np.abs(queries).max(axis=1, initial=0) > EXACT_COMPONENT):
        out[i] = exact(queries[i : i + 1], rows)
    for j in np.flatnonzero(np.abs(rows).max(axis=1, initial=0) > EXACT_COMPONENT):
        out[:, j] = exact(queries, rows[j : j + 1])
    return out


def first_of_equal(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of rows, by id, without those that can't be among the k best of any query for equal vectors before them.

    Of an id the first k count. Of what is left the first 2k do: k at most are
    a query's own.
    """
    if not rows.shape[1]:
        group = np.zeros(len(ids), np.int64)
    else:
        _, group = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)

    def nth(new: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(new)
        return np.arange(len(new)) - np.repeat(start, np.diff([*start, len(new)]))

    order = np.argsort(group, kind="stable")
    order = order[nth((np.diff(group[order], prepend=-1) != 0) | (np.diff(ids[order], prepend=0) != 0)) < k] if len(order) else order
    return np.sort(order[nth(np.diff(group[order], prepend=-1) != 0) < 2 * k])


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: highest score, then smaller id."""
    order = np.lexsort((ids, -score, query))
    start = np.flatnonzero(np.diff(query[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(start, np.diff([*start, len(order)]))
    return order[nth < k]


class Shard:
    """The k best of each query over the rows that one task has seen."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.query = np.zeros(0, np.int64)
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(len(query_ids), np.iinfo(np.int64).min)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        kept = first_of_equal(ids, rows, self.k)
        ids, rows = ids[kept], rows[kept]
        found = []
        for q in range(0, len(self.query_ids), QUERY_TILE):
            own = self.query_ids[q : q + QUERY_TILE, None] == ids[None, :]
            s = products(self.queries[q : q + QUERY_TILE], rows)
            floor = self.least[q : q + QUERY_TILE]
            if len(ids) > 2 * self.k:
                s[own] = np.iinfo(np.int64).min
                floor = np.maximum(floor, np.partition(s, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((s >= floor[:, None]) & ~own)
            found.append((i + q, s[i, j], ids[j]))
        self.query, self.score, self.ids = (np.concatenate([a, *b]) for a, b in zip((self.query, self.score, self.ids), zip(*found, strict=True), strict=True))
        top = best(self.query, self.score, self.ids, self.k)
        self.query, self.score, self.ids = self.query[top], self.score[top], self.ids[top]
        full = np.bincount(self.query, minlength=len(self.query_ids)) >= self.k
        last = np.searchsorted(self.query, np.arange(len(self.query_ids)), "right") - 1
        self.least = np.where(full, self.score[np.maximum(last, 0)] if len(self.score) else self.least, self.least)


def _lists(tiles: dict, batches, k: int) -> pa.Table:
    """(query_id, vec_id, score): the k best of each query over the batches' rows of its length."""
    shards = {d: Shard(i, m, k) for d, (i, m) in tiles.items()}
    for batch in batches:
        for ids, m in matrices(batch, "vec_id", "v"):
            if m.shape[1] in shards:
                for at in range(0, len(ids), ROW_TILE):
                    shards[m.shape[1]].add(ids[at : at + ROW_TILE], m[at : at + ROW_TILE])
    columns = [np.concatenate([np.zeros(0, np.int64), *(of(x) for x in shards.values())]) for of in (lambda x: x.query_ids[x.query], lambda x: x.ids, lambda x: x.score)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


LISTS = "query_id bigint, vec_id bigint, score bigint"


def broadcast_lists(rows: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each task."""
    shared = rows.sparkSession.sparkContext.broadcast({m.shape[1]: (i, m) for i, m in matrices(queries, "vec_id", "v")})
    return rows.mapInArrow(lambda batches: _lists(shared.value, batches, k).to_batches(), LISTS)


def tiled_lists(rows: DataFrame, queries: DataFrame, tiles: int, shards: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each shard; every tile of queries meets every shard of rows in one group.

    Rows are dealt by their place, so rows that repeat spread evenly.
    """
    place = lambda n, seed: F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # under names of their own, as both sides come from one table
    left = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).withColumn("tile", place(tiles, 1)).withColumn("shard", others(shards))
    right = rows.withColumn("shard", place(shards, 2)).withColumn("tile", others(tiles))

    def run(asked: pa.Table, met: pa.Table) -> pa.Table:
        both = asked.num_rows and met.num_rows  # a side without rows comes without columns
        return _lists({m.shape[1]: (i, m) for i, m in matrices(asked, "query_id", "q")} if both else {}, [met] if both else [], k)

    return left.groupBy("tile", "shard").cogroup(right.groupBy("tile", "shard")).applyInArrow(run, LISTS)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, query_bytes: int = QUERY_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner product for each query row.

    Rows with the query's vec_id are its own and no candidates; other rows
    that repeat count each. A vec_id that is a query more than once is asked
    with each of its rows, and has the best k of all their pairs. Vectors only
    meet vectors of their length. Null ids and vectors that are null or hold
    null or non-finite components take no part; extra columns are ignored. Ties
    go to the smaller vec_id; products beyond 64 bits stay at the limit; an
    empty table gives no rows.
    """
    rows, asked = quantised(vectors), quantised(vectors.where(is_query))
    size = F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0))
    need = asked.agg(size).first()[0]
    if need <= query_bytes:
        lists = broadcast_lists(rows, asked.toArrow(), k)
    else:
        lists = tiled_lists(rows, asked, math.ceil(need / query_bytes), math.ceil(rows.agg(size).first()[0] / shard_bytes), k)
    order = [F.col("score").desc(), F.col("vec_id")]
    for keys in (["query_id", "branch"], ["query_id"]):
        if "branch" in keys:
            lists = lists.withColumn("branch", F.spark_partition_id() % 16)
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_tiled_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is split into clusters of even size. A vector goes to the
list of its nearest centroid and, near a boundary, to those of further
centroids that are almost as near. Centroids are found by beam search in a
neighbour graph that every task holds in memory. A query reads the lists whose
centroids are within a ratio of its nearest one; the ratio is calibrated on
the sample, so that the lists hold TARGET of the nearest rows there.
Lists that lie close are scanned together in blocks of BLOCK_ROWS rows, where
replicas are measured once and a query's lists give one short list of best
rows; a longer list is dealt out to parts of that size, so no group is larger
however the data lie. Equal vectors are indexed once, with the
smallest of their ids, as many as a result can hold.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import table, written
from shelfmark.llm.topk import finite

#: Rows that the centroids are fitted on at most, about; centroids at most; rows that are scanned together.
SAMPLE_ROWS, MOST_CENTROIDS, BLOCK_ROWS = 20_000, 4096, 4096
#: Lists a vector is entered in at most, and how much farther than the nearest their centroids may be.
REPLICAS, REPLICA_RATIO = 4, 1.2
#: Lists a query reads at least; share of nearest rows that the pruning ratio is calibrated to reach; queries for that.
LEAST_PROBES, TARGET, CALIBRATION_QUERIES = 8, 0.975, 400
#: Neighbours of a centroid in the graph.
DEGREE = 24


def along(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Places of rows along their longest direction."""
    x = x - x.mean(axis=0)
    axis = rng.normal(size=x.shape[1])
    for _ in range(6):
        axis = x.T @ (x @ axis)
        axis /= np.linalg.norm(axis) or 1.0
    return x @ axis


def blocks_of(centroids: np.ndarray, sizes: dict[int, int]) -> tuple[np.ndarray, list[int]]:
    """The block of each list, and how many parts each block is dealt out to.

    Lists are halved along their longest direction until their rows fit into BLOCK_ROWS.
    """
    rng = np.random.default_rng(9)
    rows = np.array([sizes.get(c, 0) for c in range(len(centroids))])
    blocks, parts, waiting = np.zeros(len(centroids), np.int64), [], [np.arange(len(centroids))]
    while waiting:
        here = waiting.pop()
        if len(here) == 1 or rows[here].sum() <= BLOCK_ROWS:
            blocks[here] = len(parts)
            parts.append(max(1, math.ceil(int(rows[here].sum()) / BLOCK_ROWS)))
        else:
            order = here[np.argsort(along(centroids[here].astype(np.float64), rng), kind="stable")]
            waiting += [order[: len(order) // 2], order[len(order) // 2 :]]
    return blocks, parts


def balanced_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Means of ``count`` even parts: the largest is halved at the median along its longest direction, again and again; then two rounds of k-means."""
    rng = np.random.default_rng(7)
    parts = [np.arange(len(sample))]
    while len(parts) < min(count, len(sample)):
        i = max(range(len(parts)), key=lambda p: len(parts[p]))
        part = parts.pop(i)
        order = part[np.argsort(along(sample[part], rng), kind="stable")]
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]
    centroids = np.stack([sample[p].mean(axis=0) for p in parts])
    for _ in range(2):
        nearest = np.concatenate([np.argmin((centroids**2).sum(1) - 2 * sample[i : i + 2048] @ centroids.T, axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        n = np.bincount(nearest, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


class CentroidGraph:
    """Each centroid linked to its nearest ones; searched from a few that lie far apart."""

    def __init__(self, centroids: np.ndarray):
        # distances keep their order and ratios when all vectors are scaled, and single precision keeps its range
        self.scale = float(np.abs(centroids).max(initial=0)) or 1.0
        self.centroids = (centroids / self.scale).astype(np.float32)
        self.norms = (self.centroids**2).sum(axis=1)
        n, degree = len(centroids), min(DEGREE, len(centroids) - 1)
        self.links = np.zeros((n, degree), np.int64)
        for i in range(0, n, 512):
            d = self.norms - 2 * self.centroids[i : i + 512] @ self.centroids.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            self.links[i : i + 512] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        entries, far = [0], np.full(n, np.inf)
        while len(entries) < min(n, 16):
            far = np.minimum(far, ((self.centroids - self.centroids[entries[-1]]) ** 2).sum(axis=1))
            entries.append(int(np.argmax(far)))
        self.entries = np.array(sorted(set(entries)))
        self.ratio, self.beam = 1.0, LEAST_PROBES

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of the nearest centroids found, nearest first."""
        x = (x / self.scale).astype(np.float32)
        rows, n = np.arange(len(x))[:, None], len(self.centroids)
        beam = min(beam, n)
        own = (x**2).sum(axis=1)[:, None]
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries))).copy()
        dist = own + self.norms[ids] - 2 * x @ self.centroids[self.entries].T
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entries] = True
        open_ = np.ones(ids.shape, bool)
        while True:
            waiting = np.where(open_, dist, np.inf)
            take = np.argsort(waiting, axis=1, kind="stable")[:, :4]
            chosen = np.isfinite(np.take_along_axis(waiting, take, 1))
            active = chosen.any(axis=1)
            if not active.any():
                break
            open_[rows, take] = False
            i = np.flatnonzero(active)
            near = self.links[np.take_along_axis(ids[i], take[i], 1)].reshape(len(i), -1)
            fresh = ~seen[i[:, None], near] & np.repeat(chosen[i], self.links.shape[1], axis=1)
            order = np.sort(np.where(fresh, near, n), axis=1)  # each once
            fresh = (order < n) & (np.diff(order, axis=1, prepend=-1) > 0)
            near = np.where(fresh, order, 0)
            seen[i[:, None], near] |= fresh
            d = own[i] + self.norms[near] - 2 * np.einsum("bd,bkd->bk", x[i], self.centroids[near])
            more_ids = np.zeros((len(x), near.shape[1]), np.int64)
            more_dist = np.full((len(x), near.shape[1]), np.inf, np.float32)
            more_ids[i], more_dist[i] = near, np.where(fresh, d, np.inf)
            ids, dist = np.concatenate([ids, more_ids], 1), np.concatenate([dist, more_dist], 1)
            open_ = np.concatenate([open_, np.isfinite(more_dist)], 1)
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, open_ = (np.take_along_axis(a, best, 1) for a in (ids, dist, open_))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs in which vectors are entered."""
        ids, dist = self.search(x, REPLICAS * 3)
        width = min(ids.shape[1], REPLICAS * 3)
        chosen = np.zeros((len(x), width), bool)
        chosen[:, 0] = True
        for j in range(1, width):
            near = np.isfinite(dist[:, j]) & (dist[:, j] <= REPLICA_RATIO**2 * dist[:, 0] + 1e-12) & (chosen.sum(axis=1) < REPLICAS)
            chosen[:, j] = near
        row, at = np.nonzero(chosen)
        return row, ids[row, at]

    def probes_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs that queries read."""
        ids, dist = self.search(x, self.beam)
        near = np.isfinite(dist) & ((dist <= self.ratio**2 * dist[:, :1]) | (np.arange(ids.shape[1]) < LEAST_PROBES))
        row, at = np.nonzero(near)
        return row, ids[row, at]

    def calibrate(self, sample: np.ndarray, k: int) -> None:
        """Sets the ratio within which TARGET of the k nearest sample rows have a list, and a beam that holds so many lists."""
        if len(sample) < 2:
            return
        lists = np.full((len(sample), REPLICAS), -1)
        for i in range(0, len(sample), 1024):
            row, at = self.lists_of(sample[i : i + 1024])
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            lists[row + i, nth] = at
        asked = sample[:: max(1, len(sample) // CALIBRATION_QUERIES)]
        needed, counts = [], []
        norms = (sample**2).sum(axis=1)
        for q in asked:
            near = np.argsort(norms - 2 * sample @ q, kind="stable")[1 : k + 1]
            to_all = ((self.centroids - (q / self.scale).astype(np.float32)) ** 2).sum(axis=1)
            ratios = np.sqrt(to_all / max(float(to_all.min()), 1e-12))
            needed.append(np.where(lists[near] >= 0, ratios[lists[near]], np.inf).min(axis=1))
            counts.append(ratios)
        self.ratio = float(np.quantile(np.concatenate(needed), TARGET))
        self.beam = int(max(LEAST_PROBES, np.quantile([(c <= self.ratio).sum() for c in counts], 0.99))) + 8


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    kept = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    return kept.select("vec_id", v.alias("v"))


def _spread(rows: DataFrame, shared, pairs: str) -> DataFrame:
    """rows with a column ``list``, a row for each (row, list) of the graph's method ``pairs``."""

    def run(batches):
        graph = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.asarray(part.column("v").flatten(), np.float64).reshape(part.num_rows, -1)
                row, lists = getattr(graph, pairs)(x)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(lists.astype(np.int32))], [*part.schema.names, "list"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, list int")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, by Euclidean distance.

    Rows with the query's vec_id are its own. Vectors of each length are
    searched among their own, with an index for each. Ties go to the smaller
    vec_id; repeated rows of one vec_id and vector count once; a query's vec_id
    with several vectors of a length is asked with the least of them; null ids
    and vectors that are null, zero or hold null or non-finite components take
    no part; an empty table gives no rows.
    """
    every = usable(vectors)
    lengths = every.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked")).where("asked > 0").orderBy("d").collect()  # a row a length
    parts = [_nearest_of(every.where(F.size("v") == r["d"]), is_query, k, sample_rows, r["d"], r["n"]) for r in lengths]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) == 1:
        return found
    # one vec_id with vectors of several lengths has a list of each
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of(every: DataFrame, is_query: Column, k: int, sample_rows: int, length: int, n: int) -> DataFrame:
    """nearest() of the n usable vectors of one length."""
    spark = every.sparkSession
    sample = every.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(max(1, math.ceil(n / sample_rows)))) == 0).select("v").distinct().toArrow()
    drawn = np.asarray(sample.column("v").combine_chunks().flatten(), np.float64).reshape(-1, length)
    if not len(drawn):
        drawn = np.zeros((1, length))
    drawn = drawn[np.lexsort(drawn.T[::-1])]
    count = max(1, min(MOST_CENTROIDS, int(2 * math.sqrt(n)), len(drawn) // 4))
    graph = CentroidGraph(balanced_centroids(drawn, count))
    graph.calibrate(drawn[np.random.default_rng(5).permutation(len(drawn))], k)
    shared = spark.sparkContext.broadcast(graph)

    order = Window.partitionBy("v").orderBy("vec_id")
    firsts = every.select("vec_id", "v").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    index = firsts.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    postings = written(_spread(index, shared, "lists_of"), "postings")
    sizes = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a centroid
    blocks, parts = blocks_of(graph.centroids, sizes)
    block_of = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1)
    parts_of = F.element_at(F.array(*[F.lit(n) for n in parts]), F.col("block") + 1)
    postings = postings.withColumn("block", block_of).withColumn("part", F.pmod(F.xxhash64("v"), parts_of).cast("int"))
    asked = every.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = _spread(asked, shared, "probes_of").withColumn("block", block_of).groupBy("query_id", "block").agg(F.first("v").alias("v"), F.collect_set("list").alias("lists"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - 1)))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            rows = np.asarray(left.column("v").combine_chunks().flatten(), np.float64).reshape(left.num_rows, -1)
            _, first, number = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
            rows, number = rows[first], number.ravel()
            ids = left.column("ids").take(pa.array(first)).to_pylist()
            low = np.array([i[0] for i in ids])
            of_list = left.column("list").to_numpy()
            order = np.argsort(of_list, kind="stable")
            names, begins = np.unique(of_list[order], return_index=True)
            members = dict(zip(names.tolist(), np.split(number[order], begins[1:]), strict=True))
            asked_v = np.asarray(right.column("v").combine_chunks().flatten(), np.float64).reshape(right.num_rows, -1)
            norms = (rows**2).sum(axis=1)
            for begin in range(0, len(asked_v), 256):
                some, part = asked_v[begin : begin + 256], right.slice(begin, 256)
                rough = norms - 2 * some @ rows.T  # squared distances less the query's norm; rounding stays far below the slack
                slack = 1e-10 * ((some**2).sum(axis=1) + norms.max())
                for query_id, q, lists, far, eps in zip(part.column("query_id").to_pylist(), some, part.column("lists").to_pylist(), rough, slack, strict=True):
                    held = [members[c] for c in lists if c in members]
                    if not held:
                        continue
                    at = np.unique(np.concatenate(held))
                    if len(at) > k + 1 and np.isfinite(far).all() and np.isfinite(eps):
                        at = at[far[at] <= np.partition(far[at], k)[k] + eps]
                    d = np.sqrt(((rows[at] - q) ** 2).sum(axis=1))
                    found += [(query_id, float(d[i]), ids[at[i]]) for i in np.lexsort((low[at], d))[: k + 1]]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "score": pa.array([f[1] for f in found], pa.float64()), "ids": pa.array([f[2] for f in found], pa.list_(pa.int64()))})

    met = postings.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(scan, "query_id bigint, score double, ids array<bigint>")
    found = met.withColumn("vec_id", F.explode("ids")).where(F.col("vec_id") != F.col("query_id"))
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_posting_list_search(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

"""Mixing sources to target weights by weighted fair queueing.

Every document enters a queue of its source once per epoch, in hash-shuffled
order. Its virtual finish time is the words of its source up to and with it,
divided by the source's target; sorted by that time the sources interleave in
proportion to their targets, and the mix is the longest prefix within the
budget. Running sums are taken in two steps, over hash or range buckets and
then inside each, so that no task sees a whole source.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, table, written

#: Rows that one bucket of a running sum holds, about.
ROWS_PER_BUCKET = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """(source, source_size, target) for sized(source, size).

    Sources in code-point order, null last, take ``weights`` in turn. The sum
    of all sizes is shared by weight; a target stops at ``max_repeats`` times
    its source's size and what is left over is shared again, until none is
    above. That fixed point is the water level min(cap, weight * level): with
    the sources sorted by cap / weight, it is the largest level at which the
    source it is computed for isn't capped. Both windows see one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    everyone = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.sum(F.col("source_size").cast("double")).over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards),
    )
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everyone))
    return per.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def schedule(sized: DataFrame, targets: DataFrame, max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """The queue in order: sized's columns, epoch, finish (virtual time) and end_at (words of the mix up to and with the entry).

    sized holds rid (unique), doc_id, source, size; empty documents aren't
    queued. Ties go by source, doc_id, epoch and rid.
    """
    n = sized.count()
    digits = max(1, math.ceil(math.log(max(1, n / ROWS_PER_BUCKET), 16)))
    lanes = max(1, n * max_repeats // ROWS_PER_BUCKET)
    queued = (
        sized.where("size > 0")
        .join(F.broadcast(targets) if targets.count() <= 100_000 else targets, sized["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string"))))
        .withColumn("bucket", F.substring("key", 1, digits))
    )
    sums = queued.groupBy("source", "epoch", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).drop("in_bucket")
    sums = sums.withColumnsRenamed({"source": "s", "epoch": "e", "bucket": "b"})
    queued = queued.join(sums, queued["source"].eqNullSafe(sums["s"]) & (queued["epoch"] == sums["e"]) & (queued["bucket"] == sums["b"])).drop("s", "e", "b")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    queued = queued.withColumn(
        "finish", (F.col("epoch") * F.col("source_size") + F.col("ahead") + F.sum("size").over(inside)).cast("double") / F.col("target")
    ).drop("ahead", "bucket", "key")
    queued = queued.withColumn("lane", F.floor(F.col("finish") * lanes))
    lane_sums = queued.groupBy("lane").agg(F.sum("size").alias("in_lane"))
    lane_sums = lane_sums.withColumn("before", F.coalesce(F.sum("in_lane").over(Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("lane").orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "epoch", "size", "rid")
    return (
        queued.join(lane_sums.select("lane", "before"), "lane")
        .withColumn("end_at", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("before", "lane")
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, source, size) of every row, written out: rid must not change under a retry."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """(rid, doc_id, source, size, source_size, target, taken) of each row of docs; taken counts words, repeats included.

    An empty table gives no rows; a null text has size 0 and takes 0; a
    repeated row is queued once for each occurrence; a null source is a source
    of its own, last in order.
    """
    sized = sized_documents(docs)
    targets = written(source_targets(sized, weights, max_repeats), "targets")
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    taken = schedule(sized, targets, max_repeats, seed).where(F.col("end_at") <= budget).groupBy("rid").agg(F.sum("size").alias("taken"))
    return (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .join(taken, "rid", "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
    )


def op10_fair_queue_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def fair_queue_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of docs as rows: a document stands once for each epoch that takes it.

    The documents are written once with a row number, so that sizes and texts
    agree on it; clashing extra columns stay as they are. Null and empty texts
    take no words and go; each row that repeats is queued; an empty table gives
    no rows.
    """
    rid, times_of = ("".join((name, uuid.uuid4().hex[:8])) for name in ("rid_", "times_"))
    held = written(docs.withColumn(rid, F.monotonically_increasing_id()), "held")
    sized = written(held.select(F.col(rid).alias("rid"), "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = written(source_targets(sized), "targets")
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    times = schedule(sized, targets).where(F.col("end_at") <= budget).groupBy(F.col("rid").alias(rid)).agg(F.count("*").cast("int").alias(times_of))
    return held.join(times, rid).select(F.explode(F.array_repeat(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(times_of))).alias("doc")).select("doc.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * CAST(source_size AS DOUBLE) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM per
), levels AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM levels WHERE level <= cap / weight)) AS target FROM levels
), queued AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, e.epoch, md5('0:' || e.epoch || ':' || s.doc_id) AS key
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e WHERE s.size > 0
), timed AS (
  SELECT *, CAST(epoch * source_size + sum(size) OVER (PARTITION BY source, epoch ORDER BY key, doc_id) AS DOUBLE) / target AS finish FROM queued
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS end_at FROM timed
), taken AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM ordered WHERE end_at <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken, s.source
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON s.doc_id = k.doc_id
"""

"""Pages of a long sorted listing: written once in ranges of the order, read by the ranges that a page touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a range, about.
RANGE_ROWS = 100_000


@dataclass
class Page:
    """Rows in order, whether more follow, rows of the whole listing, ranges that were read, and where the next page goes on."""

    rows: list
    has_more: bool
    total: int
    ranges_read: int
    last: tuple | None


def _order(by: str, key: str, descending: bool) -> list[Column]:
    return [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), F.col(key).asc()]


def write_listing(rows: DataFrame, path: str, by: str, key: str, descending: bool = True, range_rows: int = RANGE_ROWS) -> None:
    """Writes rows in the order of ``by`` (nulls last), then ``key``, in ranges, and how many each holds. Keys are unique and not null."""
    n = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(n, *_order(by, key, descending)).sortWithinPartitions(*_order(by, key, descending))
    dealt.withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    held = spark.read.parquet(f"{path}/rows") if n and rows.columns and not rows.isEmpty() else None
    counts = held.groupBy("range").agg(F.count("*").alias("n")) if held is not None else spark.createDataFrame([], "range int, n bigint")
    counts.coalesce(1).write.parquet(f"{path}/ranges")


def _read(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where(F.col("range").between(first, last)).drop("range")


def _ranges(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(range, rows) in order: a row for RANGE_ROWS of the listing."""
    return [(r["range"], r["n"]) for r in spark.read.parquet(f"{path}/ranges").orderBy("range").collect()]


def page_at(spark: SparkSession, path: str, offset: int, limit: int, by: str, key: str, descending: bool = True) -> Page:
    """The page that begins at ``offset``; only ranges with rows of it, or with the row that follows it, are read."""
    ranges, before, wanted = _ranges(spark, path), 0, []
    total = sum(n for _, n in ranges)
    skipped = None
    for number, n in ranges:
        if before + n > offset and before <= offset + limit and n:
            skipped = before if skipped is None else skipped
            wanted.append(number)
        before += n
    if not wanted:
        return Page([], False, total, 0, None)
    rows = _read(spark, path, wanted[0], wanted[-1]).orderBy(*_order(by, key, descending)).offset(offset - skipped).limit(limit + 1).collect()
    return _page(rows, limit, total, len(wanted), by, key)


def page_after(spark: SparkSession, path: str, last: tuple | None, limit: int, by: str, key: str, descending: bool = True) -> Page:
    """The page behind ``last`` (value, key), or the first one. Rows that came to the listing meanwhile don't shift it.

    Ranges are tried from the one that holds ``last`` on: its files are found
    by the statistics of their columns.
    """
    ranges = _ranges(spark, path)
    total = sum(n for _, n in ranges)
    if not total:
        return Page([], False, 0, 0, None)
    at, begin = F.col(by), 0
    behind = F.lit(True)
    if last is not None:
        value, own = last
        tie = at.eqNullSafe(F.lit(value)) & (F.col(key) > F.lit(own))
        behind = tie if value is None else tie | at.isNull() | (at < F.lit(value) if descending else at > F.lit(value))
        here = spark.read.parquet(f"{path}/rows").where(at.eqNullSafe(F.lit(value)) & (F.col(key) == F.lit(own))).agg(F.min("range")).first()[0]
        begin = next((i for i, (number, _) in enumerate(ranges) if number >= (here or 0)), len(ranges))
    seen, end = 0, begin
    while end < len(ranges) and (seen <= limit or end == begin):
        seen += ranges[end][1] if end > begin or last is None else 0
        end += 1
    rows = _read(spark, path, ranges[begin][0], ranges[max(begin, end - 1)][0]).where(behind).orderBy(*_order(by, key, descending)).limit(limit + 1).collect()
    return _page(rows, limit, total, end - begin, by, key)


def _page(rows: list, limit: int, total: int, read: int, by: str, key: str) -> Page:
    shown = rows[:limit]
    return Page(shown, len(rows) > limit, total, read, (shown[-1][by], shown[-1][key]) if shown else None)

"""File events: noise filter, debounced batches, minimal rescan targets, incremental upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.catalogue import owners

#: Endings of temporary files and journals. Fixed values.
NOISE = (".tmp", ".part", ".crdownload", ".swp", ".swx", "~", ".db-journal", ".db-wal", ".db-shm")

#: Targets beyond which all roots are scanned instead.
MOST_TARGETS = 24


#: Folders whose events are left out. Fixed values.
EXCLUDED = (".git", "node_modules", "__pycache__")


def is_quiet(path: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a path is neither noise nor below an excluded folder; folders are told by whole names, case aside."""
    noise = F.lit(False)
    for ending in NOISE:
        noise = noise | F.lower(path).endswith(ending)
    return ~noise & ~F.arrays_overlap(F.transform(F.split(path, "/"), F.lower), F.array(*[F.lit(x) for x in excluded]))


def quiet_events(events: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """events(path, ts[, dest]) without noise or excluded folders; a move counts for both of its ends."""
    if "dest" in events.columns:
        events = events.withColumn("path", F.explode(F.array_compact(F.array("path", "dest")))).drop("dest")
    return events.where(is_quiet(F.col("path"), excluded))


def sessions(events: DataFrame, key: str, quiet_seconds: float) -> DataFrame:
    """(key, batch, first_ts, last_ts, n_events): a batch ends where the next event is quiet_seconds or more away."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    begun = events.withColumn("begins", F.coalesce((gap >= int(quiet_seconds * 1e6)).cast("long"), F.lit(0)))
    batch = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("batch", batch).groupBy(key, "batch").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))


def capped_sessions(events: DataFrame, key: str, quiet_seconds: float, most_seconds: float) -> DataFrame:
    """(key, batch, first_us, last_us, n_events) as sessions(), but a batch also ends at the first event most_seconds or more after its first one.

    The cap only matters inside a session, so sessions are cut one by one: a
    fold over a session's sorted times, in the engine.
    """
    order = Window.partitionBy(key).orderBy("us", "event_id")
    timed = events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    begins = F.coalesce((F.col("us") - F.lag("us").over(order) >= int(quiet_seconds * 1e6)).cast("long"), F.lit(0))
    timed = timed.withColumn("begins", begins).withColumn("session", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    times = timed.groupBy(key, "session").agg(F.array_sort(F.collect_list("us")).alias("times"))
    piece = lambda first, last, n: F.struct(first.alias("first_us"), last.alias("last_us"), n.alias("n_events"))
    one = F.lit(1).cast("long")

    def step(state: Column, us: Column) -> Column:
        new = us - state["open"]["first_us"] >= int(most_seconds * 1e6)
        grown = piece(state["open"]["first_us"], us, state["open"]["n_events"] + 1)
        return F.struct(F.when(new, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"), F.when(new, piece(us, us, one)).otherwise(grown).alias("open"))

    head = F.element_at("times", 1)
    start = F.struct(F.array().cast("array<struct<first_us:bigint,last_us:bigint,n_events:bigint>>").alias("done"), piece(head, head, one).alias("open"))
    batches = F.aggregate(F.slice("times", F.lit(2), F.size("times")), start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    found = times.select(key, F.explode(batches).alias("b")).select(key, "b.*")
    return found.withColumn("batch", F.row_number().over(Window.partitionBy(key).orderBy("first_us", "last_us")).cast("long") - 1).select(key, "batch", "first_us", "last_us", "n_events")


def rescan_targets(changed: DataFrame, assets: DataFrame, roots: DataFrame) -> DataFrame:
    """(target) of changed(path): the innermost asset, else the innermost root; a root absorbs its assets; too many targets give all roots; paths outside are dropped."""
    by_asset = owners(changed, assets).withColumnRenamed("owner", "asset")
    by_root = owners(changed, roots).withColumnRenamed("owner", "in_root")
    met = by_root.join(by_asset, "path", "left").select(F.coalesce("asset", "in_root").alias("target"), F.col("asset").isNull().alias("is_root"), "in_root").distinct()
    whole = met.where("is_root").select(F.col("target").alias("in_root")).distinct()
    targets = met.where("is_root").select("target").union(met.where("not is_root").join(whole, "in_root", "left_anti").select("target")).distinct()
    many = targets.agg((F.count("*") > MOST_TARGETS).alias("many"))
    return targets.where(~F.col("target").isNull() & ~many.scalar()).union(roots.select(F.col("root").alias("target")).where(many.scalar())).distinct()


def coalesced_stream(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour", key: Column | str = "path") -> DataFrame:
    """Streaming batches: events of a key in windows of event time, late ones dropped beyond the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", window), key).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


def apply_incrementally(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what has arrived through ``apply`` (batch, number) and stops; the checkpoint makes a restart go on where it ended."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Models found installed in several places, by what their files look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.units import dealt

#: Bytes of an asset that is reported, at least, and files that stand for its layout, at most. Fixed values.
LEAST_BYTES, LISTED_FILES = 256 * 1024, 64


def layouts(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(asset_id, signature, verified) of assets(asset_id, size_bytes, file_count) with files(asset_id, relpath, size_bytes, sha256).

    Where every file of an asset has a digest, the signature is that of its
    digests. Else it is that of its bytes, the number of its files and the first
    LISTED_FILES names and sizes in order of the names: these are picked
    by rank before they are gathered, so an asset of many files needs no row
    that holds them all, and the digests of such are combined sum by sum.
    """
    name = F.lower(F.substring_index(F.translate("relpath", "\\", "/"), "/", -1))
    rows = dealt(files, "asset_id").select("asset_id", name.alias("file"), F.coalesce("size_bytes", F.lit(0)).alias("bytes"), "sha256")
    # order doesn't matter to a sum, and a row hash of a digest is as good as the digest
    pieces = [F.sum(F.conv(F.substring("sha256", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    whole = rows.groupBy("asset_id").agg(F.count("*").alias("n"), F.count("sha256").alias("n_digests"), *pieces)
    order = Window.partitionBy("asset_id").orderBy("file", "bytes")
    few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LISTED_FILES)
    listed = few.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("nth", "file", "bytes"))).alias("l"))
    shape = F.concat_ws("|", F.transform("l", lambda x: F.concat_ws(":", x["file"], x["bytes"].cast("string"))))
    verified = (F.col("n") > 0) & (F.col("n_digests") == F.col("n"))
    signature = F.when(verified, F.sha2(F.concat_ws("|", "n", *[f"s{i}" for i in range(5)]), 256)).otherwise(F.sha2(F.concat_ws("|", F.col("size_bytes").cast("string"), F.col("n").cast("string"), shape), 256))
    return assets.select("asset_id", "size_bytes").join(whole, "asset_id").join(listed, "asset_id").select("asset_id", signature.alias("signature"), verified.alias("verified"))


def duplicate_installations(assets: DataFrame, files: DataFrame, least_bytes: int = LEAST_BYTES, across_applications: bool = False) -> DataFrame:
    """(signature, verified, install_count, unit_bytes, reclaimable_bytes, sources, name, keeper) of assets that look alike.

    assets(asset_id, name, size_bytes, is_missing, application[, physical_bytes]):
    missing ones, those under least_bytes and those without files take no part.
    Reclaimable is all but one copy, an upper bound; the name is the longest, then the
    first; the keeper of the least id. ``across_applications`` leaves out what one
    application keeps for itself.
    """
    live = assets.where(~F.coalesce("is_missing", F.lit(False)) & (F.col("size_bytes") >= least_bytes))
    unit = F.coalesce("physical_bytes", "size_bytes") if "physical_bytes" in assets.columns else F.col("size_bytes")
    signed = live.join(layouts(live, files), "asset_id")
    groups = signed.groupBy("signature", "verified").agg(
        F.count("*").alias("install_count"), F.max(unit).alias("unit_bytes"), F.array_sort(F.collect_set("application")).alias("sources"), F.min(F.struct(-F.length("name"), "name")).alias("first"), F.min("asset_id").alias("keeper"),
    ).where("install_count > 1")
    if across_applications:
        groups = groups.where(F.size("sources") > 1)
    return groups.select("signature", "verified", "install_count", "unit_bytes", (F.col("unit_bytes") * (F.col("install_count") - 1)).alias("reclaimable_bytes"), "sources", F.col("first.name").alias("name"), "keeper")

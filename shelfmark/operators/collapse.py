"""The tree of an inventory, without rungs that hold one asset only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapsed_tree(items: DataFrame, levels: list[str], key: str = "asset_id", size: str = "size_bytes", protected: int = 2) -> DataFrame:
    """(path, parent, depth, level, label, asset_id, n_assets, total_bytes) of the nodes over ``levels`` and of the assets as leaves.

    A level at which an asset says nothing, null or empty, is skipped. Nodes of
    one asset are left out beyond the first ``protected`` levels, and what is
    below them hangs from the nearest node that stays. As a node holds what its
    descendants hold, all below a node that goes go too, so the deepest that
    stays is found by one aggregate, not by climbing. path joins the labels of
    a node's chain, depth counts the nodes that stay above it, the root is path ''.
    """
    said = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(F.lit(i).alias("at"), F.col(c).cast("string").alias("label"))) for i, c in enumerate(levels)]
    rows = items.select(F.col(key).alias("_id"), F.col(size).alias("_size"), F.array_compact(F.array(*said)).alias("chain"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("chain")), lambda n: F.slice("chain", F.lit(1), n))
    spread = rows.select("_id", "_size", F.explode(prefixes).alias("node"))
    nodes = spread.groupBy("node").agg(F.count("*").alias("n_assets"), F.sum("_size").alias("total_bytes"))
    level = F.coalesce(F.try_element_at("node", F.lit(-1))["at"], F.lit(-1))
    nodes = nodes.withColumn("at", level).where((F.col("at") < protected) | (F.col("n_assets") > 1))
    path = lambda node: F.array_join(F.transform(node, lambda x: x["label"]), "/")
    # the deepest node of each asset that stays; nodes above it that go were left out by their own count
    kept = nodes.select(F.col("node").alias("above"))
    own = spread.join(kept, F.col("node") == F.col("above")).groupBy("_id").agg(F.max_by("above", F.size("above")).alias("above"), F.first("_size").alias("_size"))
    upper = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.size("node")), lambda n: F.slice("node", F.lit(1), n))).alias("above")).where(F.size("above") < F.size("node")).join(kept, "above")
    upper = upper.groupBy("node").agg(F.max_by("above", F.size("above")).alias("above"), F.count("*").alias("depth"))
    names = F.array(*[F.lit(c) for c in levels])
    inner = nodes.join(upper, "node", "left").select(
        path("node").alias("path"), path("above").alias("parent"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce(F.get(names, F.col("at")), F.lit("root")).alias("level"),
        F.try_element_at("node", F.lit(-1))["label"].alias("label"), F.lit(None).cast(items.schema[key].dataType).alias(key), "n_assets", "total_bytes",
    )
    depths = upper.select("node", "depth").union(nodes.where("at = -1").select("node", F.lit(0).cast("bigint")))
    leaves = own.join(depths, F.col("above") == F.col("node")).select(
        F.concat_ws("/", F.nullif(path("above"), F.lit("")), F.col("_id").cast("string")).alias("path"), path("above").alias("parent"), (F.col("depth") + 1).alias("depth"), F.lit("asset").alias("level"),
        F.col("_id").cast("string").alias("label"), F.col("_id").alias(key), F.lit(1).cast("bigint").alias("n_assets"), F.col("_size").alias("total_bytes"),
    )
    return inner.unionByName(leaves)

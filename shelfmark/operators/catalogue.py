"""Filters, joins, aggregates and reports over asset and file tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.units import ancestors


@dataclass
class AssetFilter:
    """AND over facets, OR within one. values: column to accepted values; related: (details, key, column, values) semi joins; excluded: (ids, key) anti joins."""

    values: dict[str, list] = field(default_factory=dict)
    least_size: float | None = None
    most_size: float | None = None
    year: int | None = None
    text: str | None = None
    text_columns: tuple[str, ...] = ()
    related: list[tuple[DataFrame, str, Column]] = field(default_factory=list)
    excluded: list[tuple[DataFrame, str]] = field(default_factory=list)

    def apply(self, assets: DataFrame) -> DataFrame:
        for column, accepted in self.values.items():
            assets = assets.where(F.col(column).isin(accepted))
        if self.least_size is not None:
            assets = assets.where(F.col("size_bytes") >= self.least_size)
        if self.most_size is not None:
            assets = assets.where(F.col("size_bytes") <= self.most_size)
        if self.year is not None:  # a range, so that it reaches the scan
            assets = assets.where(F.col("modified_at").between(F.lit(f"{self.year}-01-01").cast("timestamp_ntz"), F.lit(f"{self.year}-12-31 23:59:59.999999").cast("timestamp_ntz")))
        if self.text:
            hit = F.lit(False)
            for column in self.text_columns:
                hit = hit | F.col(column).ilike(f"%{self.text}%")
            assets = assets.where(hit)
        for details, key, wanted in self.related:
            assets = assets.join(details.where(wanted).select(key), key, "left_semi")
        for ids, key in self.excluded:
            assets = assets.join(ids.select(key), key, "left_anti")
        return assets


def page(assets: DataFrame, by: str, descending: bool = True, limit: int = 50, offset: int = 0, key: str = "asset_id") -> DataFrame:
    """One page in a total order: ties go by ascending id."""
    return assets.orderBy(F.desc(by) if descending else F.asc(by), F.asc(key)).offset(offset).limit(limit)


def storage_by(assets: DataFrame, column: str) -> DataFrame:
    """(key, total_bytes, n_assets), null keys as 'unknown'."""
    return assets.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("key")).agg(F.round(F.sum("size_bytes"), 2).alias("total_bytes"), F.count("*").alias("n_assets"))


def summary(items: DataFrame, dimensions: list[str], size: str = "size_bytes") -> DataFrame:
    """One pass for the totals and each dimension: (dimension, value, n_assets, total_bytes)."""
    sets = items.groupingSets([[F.col(d)] for d in dimensions] + [[]], *dimensions).agg(
        F.grouping_id(*dimensions).alias("gid"), F.count("*").alias("n_assets"), F.round(F.sum(size), 2).alias("total_bytes")
    )
    full = (1 << len(dimensions)) - 1
    name, value = F.lit("all"), F.lit("")
    for i, d in enumerate(dimensions):
        here = F.col("gid") == full - (1 << (len(dimensions) - 1 - i))
        name, value = F.when(here, F.lit(d)).otherwise(name), F.when(here, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n_assets", "total_bytes")


def tree(items: DataFrame, levels: list[str], size: str = "size_bytes") -> DataFrame:
    """(path, depth, n_assets, total_bytes) of each node over levels that aren't null, root left out."""
    parts = F.array_compact(F.array(*[F.col(c) for c in levels]))
    return (
        items.select(F.explode(ancestors(F.array_join(parts, "/"), itself=True)).alias("path"), size)
        .groupBy("path")
        .agg(F.count("*").alias("n_assets"), F.round(F.sum(size), 2).alias("total_bytes"))
        .withColumn("depth", F.size(F.split("path", "/")))
    )


def best_facts(facts: DataFrame) -> DataFrame:
    """The value of each (asset_id, key) from the highest source rank, then confidence; the first one wins ties."""
    order = Window.partitionBy("asset_id", "key").orderBy(F.desc("source_rank"), F.desc("confidence"), F.asc("seq"))
    return facts.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds, in the order given."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


#: Points that a finding costs. Fixed values.
PENALTIES = {"error": 25, "warning": 10, "info": 3}


def findings(profiles: DataFrame, rules: list[tuple[str, str, Column]], key: str = "asset_id") -> DataFrame:
    """(key, code, severity) of each rule that holds, each code once a row."""
    found = F.array(*[F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, holds in _by_code(rules)])
    return profiles.select(key, F.explode(F.array_compact(found)).alias("f")).select(key, "f.code", "f.severity")


def _by_code(rules: list[tuple[str, str, Column]]) -> list[tuple[str, str, Column]]:
    """Rules of one code as one, with the first one's severity; nulls don't hold."""
    out: dict[str, tuple[str, Column]] = {}
    for code, severity, holds in rules:
        first, before = out.get(code, (severity, F.lit(False)))
        out[code] = first, before | F.coalesce(holds, F.lit(False))
    return [(code, severity, holds) for code, (severity, holds) in out.items()]


def health(profiles: DataFrame, rules: list[tuple[str, str, Column]], key: str = "asset_id") -> DataFrame:
    """(key, score, status): 100 less the penalties of distinct codes, 0 at least; the worst severity. One projection, no shuffle."""
    rules = _by_code(rules)
    has = lambda s: F.array_contains(F.array(*[F.when(h, F.lit(v)).otherwise(F.lit("")) for _, v, h in rules]), s)
    cost = sum((F.when(h, F.lit(PENALTIES[s])).otherwise(F.lit(0)) for _, s, h in rules), F.lit(0))
    status = F.when(has("error"), "error").when(has("warning"), "warning").otherwise("ok")
    return profiles.select(key, F.greatest(F.lit(0), 100 - cost).alias("score"), status.alias("status"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def owners(paths: DataFrame, containers: DataFrame) -> DataFrame:
    """paths(path, ...) with their innermost container(root): each path's folders meet the roots by equality, the longest wins."""
    met = paths.withColumn("above", F.explode(ancestors(F.col("path")))).join(containers.select(F.col("root").alias("above")).distinct(), "above")
    return met.groupBy("path").agg(F.max_by("above", F.length("above")).alias("owner"))


def surviving_claims(hits: DataFrame) -> DataFrame:
    """hits(path, claims) without those below a claiming hit; one anti join is enough, as the topmost claim always survives."""
    claims = hits.where("claims").select(F.col("path").alias("above")).distinct()
    below = hits.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(claims, "above").select("path").distinct()
    return hits.join(below, "path", "left_anti")


def upsert(target: DataFrame, staged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Merged rows and what happened to each: inserted, updated, unchanged or kept (not staged)."""
    t, s = target.select(F.struct(key, *columns).alias("t")), staged.select(F.struct(key, *columns).alias("s"))
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    action = F.when(F.col("t").isNull(), "inserted").when(F.col("s").isNull(), "kept").when(F.to_json("t") == F.to_json("s"), "unchanged").otherwise("updated")
    return both.select(F.coalesce("s", "t").alias("row"), action.alias("action")).select("row.*", "action")


def fingerprints(files: DataFrame, group: str, parts: list[Column]) -> DataFrame:
    """(group, fingerprint): a digest of the sorted rows of each group; a null part is a zero character."""
    line = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])
    return files.groupBy(group).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("fingerprint"))


#: Columns of items that come from model or dataset details.
MODEL_COLUMNS = ("architecture", "param_count", "param_count_is_exact", "quantization", "precision", "context_length", "repo_id", "author", "license", "base_model", "model_type")
DATASET_COLUMNS = ("dataset_format", "num_images", "num_videos", "num_annotations", "num_classes", "splits")


def items(assets: DataFrame, models: DataFrame, datasets: DataFrame, statistics: DataFrame | None = None, key: str = "asset_id") -> DataFrame:
    """assets with the columns of their model and dataset details, one row each; details hold the key once.

    The display name goes before the name, a model's licence before the
    dataset's, and declared numbers of images and videos, where there are any,
    before those that statistics counted. Columns that the details lack are
    left out.
    """
    m = [c for c in MODEL_COLUMNS if c in models.columns and c != "license"]
    n = [c for c in DATASET_COLUMNS if c in datasets.columns]
    licence = [F.col(c).alias(a) for d, c, a in ((models, "license", "_l1"),) if c in d.columns], [F.col("license").alias("_l2")] if "license" in datasets.columns else []
    out = assets.join(models.select(key, *m, *licence[0]), key, "left").join(datasets.select(key, *n, *licence[1]), key, "left")
    if "display_name" in assets.columns:
        out = out.withColumn("name", F.coalesce(F.nullif("display_name", F.lit("")), "name")).drop("display_name")
    shown = [F.nullif(F.col(c), F.lit("")) for c in ("_l1", "_l2") if c in out.columns]
    if shown:
        out = out.withColumn("license", F.coalesce(*shown)).drop("_l1", "_l2")
    if statistics is not None:
        out = out.join(statistics.select(key, F.col("statistics").alias("_s")), key, "left")
        for column, name in (("num_images", "images"), ("num_videos", "videos")):
            if column in n:
                out = out.withColumn(column, F.coalesce(F.nullif(F.col(column).cast("long"), F.lit(0)), F.try_element_at("_s", F.lit(name)).cast("long")))
        out = out.drop("_s")
    return out


def mark_missing(assets: DataFrame, seen: DataFrame, roots: DataFrame) -> DataFrame:
    """assets(path, is_missing, ...) after a scan of roots(root) that saw seen(path): those below a root that weren't seen are missing, seen ones aren't, others stay as they were."""
    below = assets.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(roots.select("root").distinct(), "root").select("path").distinct().withColumn("_below", F.lit(True))
    marked = assets.join(seen.select("path").distinct().withColumn("_seen", F.lit(True)), "path", "left").join(below, "path", "left")
    state = F.when(F.col("_seen"), False).when(F.col("_below"), True).otherwise(F.col("is_missing"))
    return marked.withColumn("is_missing", state).drop("_seen", "_below")


def carry_over(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("asset_id", "relpath")) -> DataFrame:
    """new files with the digests quick_sig and sha256 of the old rows of the same keys, size and time of change; null where a file is new or changed."""
    kept = old.select(*keys, F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"), "quick_sig", "sha256")
    same = F.col("size_bytes").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    joined = new.drop("quick_sig", "sha256").join(kept, list(keys), "left")
    return joined.withColumns({c: F.when(same, F.col(c)) for c in ("quick_sig", "sha256")}).drop("_size", "_mtime")


def links_of(links: DataFrame, labels: dict[str, tuple[str, str]], most: int = 8) -> DataFrame:
    """(asset, label, other, rank): the first ``most`` distinct links of each asset, seen from both ends; labels: (forward, backward) of each relation.

    Repeated links share a rank, so what lies beyond the first ones is left out before the shuffle, and repeats go when few are left.
    """
    name = lambda i: F.element_at(F.create_map(*[F.lit(x) for r, pair in labels.items() for x in (r, pair[i])]), F.col("relation"))
    ends = links.select(F.col("source").alias("asset"), name(0).alias("label"), F.col("target").alias("other")).unionAll(links.select("target", name(1), "source"))
    order = Window.partitionBy("asset").orderBy("label", "other")
    return ends.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= most).distinct()


def known_columns(text: Column, known: tuple[str, ...], looked_at: int = 8192) -> Column:
    """How many known column names the first line of a table's beginning holds."""
    header = F.substring_index(F.substring(text, 1, looked_at), "\n", 1)
    return F.size(F.array_intersect(F.split(F.lower(header), r"[,;\t| ]+"), F.array(*[F.lit(k) for k in known])))


def has_json_keys(text: Column, keys: tuple[str, ...], looked_at: int = 65_536) -> Column:
    """Whether the beginning of a JSON text names all keys."""
    head = F.substring(text, 1, looked_at)
    return reduce(Column.__and__, [F.contains(head, F.lit(f'"{k}"')) for k in keys])


def facet_values(assets: DataFrame, column: str) -> DataFrame:
    """(value): the distinct values of a column, null and empty ones left out."""
    return assets.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(F.col(column).alias("value")).distinct()


def suggested(assets: DataFrame, column: str, prefix: str, by: Column, key: str, limit: int) -> DataFrame:
    """(value, rank) of the values with a prefix, case aside, among the first ``limit`` assets in order."""
    top = assets.where(F.col(column).ilike(f"{prefix}%")).orderBy(by, key).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(by, key)))  # limit rows at most
    return ranked.groupBy(F.col(column).alias("value")).agg(F.min("rank").alias("rank"))

"""A catalogue kept as Parquet tables: scans write a new version of it, reports read the last whole one."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.units import drive
from shelfmark.operators import dedup, installations, textindex
from shelfmark.operators.boundary import guarded
from shelfmark.operators.catalogue import best_facts, carry_over, fingerprints, owners, summary, surviving_claims
from shelfmark.operators.health import file_summary, findings, health, prepared, statistics
from shelfmark.operators.identity import identified
from shelfmark.operators.recognise import candidate_hits, coco_folders, directory_profiles, discovered, mot_folders, name_of
from shelfmark.operators.search import Query, parse
from shelfmark.operators.security import security_hits, table_families
from shelfmark.operators.taxonomy import classified, resolve, vocabulary
from shelfmark.plugins import Plugins, checked, hits_of, load
from shelfmark.sources.filesystem import full_digests, quick_signatures, walk
from shelfmark.sources.headers import facts
from shelfmark.sources.versions import Draft, Store

#: Columns that reports may be sorted by; bytes where another is asked for.
SORTS = {"size": "size_bytes", "files": "n_files", "name": "name", "date": "modified_at", "category": "category", "kind": "kind", "health": "health_score"}

#: Columns of assets that a search looks at, by the names of the query language.
SEARCHED = {
    "model_type": "model_type", "framework": "framework", "author": "author", "license": "license", "quantization": "quantization", "source": "source", "vendor": "vendor", "product": "product", "kind": "kind", "category": "category", "family": "family", "detector": "detector", "health": "health_status", "status": "health_status",
}
#: Facts that a full-text search looks at.
TOLD = ("name", "repo_id", "author", "architecture", "model_type", "description", "license", "task", "pipeline_tag", "library", "library_name", "base_model", "tags", "language", "datasets", "dataset_format", "class_names")

#: Facts that stand beside an asset's own columns, as text.
DETAILS = (
    "architecture", "architecture_type", "model_type", "framework", "base_model", "param_count", "quantization", "context_length", "repo_id", "author", "license", "pipeline_tag", "library", "tags", "description", "num_images", "num_annotations",
    "class_names",
)


def under(paths: list[str], column: str = "path") -> Column:
    """Whether a path is one of these or lies below it; Spark pushes it down to the files of a table."""
    path = F.col(column)
    return reduce(Column.__or__, [(path == p) | path.startswith("/" if p == "/" else f"{p}/") for p in paths], F.lit(False))


def owner_key(rows: DataFrame) -> Column:
    """What a row of files, facts or warnings is dealt into buckets by: its asset, else its folder."""
    return F.coalesce("asset_id", F.xxhash64(F.regexp_replace("path", "/[^/]*$", ""))) if "asset_id" in rows.columns else F.xxhash64("path")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table (files, assets, facts, warnings, roots) of the last whole version; ValueError where there is none.

    The action of an asset that the last scan didn't look at is ``kept``.
    """
    store = Store(spark, folder)
    rows = store.table(name)
    if name == "assets" and "version" in rows.columns:
        rows = rows.withColumn("action", F.when(F.col("version") == store.manifest().applied.get("scan", 0), F.col("action")).otherwise("kept")).drop("version")
    return rows


def scan(spark: SparkSession, roots: list[str], folder: str, exclude: str = "", plugins: str | None = None) -> DataFrame:
    """Walks the roots, publishes what became of them, and returns the assets.

    A file belongs to the innermost asset above it; an asset's id follows from
    its path, so it is the same in each scan. Digests of files whose size and
    time of change are those of the last scan are kept, and facts of their
    headers aren't read again. ``action`` tells what became of an asset:
    inserted, updated or unchanged by its fingerprint, missing if it was below
    a root and isn't there any more, kept if it is elsewhere. Folders that
    can't be read stay in files with their error, and among the warnings, as
    do rules of the folder ``plugins`` that don't work.
    """
    rescan(spark, folder, roots, exclude, add_roots=True, plugins=plugins)
    return table(spark, folder, "assets")


def rescan(spark: SparkSession, folder: str, targets: list[str], exclude: str = "", stream: str | None = None, batch: int = 0, add_roots: bool = False, plugins: str | None = None) -> bool:
    """Brings what lies at or below the targets up to date; True if that made a version.

    Only buckets with rows of the targets, before or now, are rewritten, each
    in one version of all tables. With ``stream``, a batch up to the last one
    that went in changes nothing: the version names it.
    """
    store = Store(spark, folder)
    draft, targets = store.draft(), [t.rstrip("/") or "/" for t in targets]
    known = "files" in draft.before.schemas
    if not targets or stream is not None and draft.before.applied.get(stream, -1) >= batch:
        return False
    here = lambda column="path": under(targets, column)
    old = {name: store.table(name).where(here()) for name in ("files", "facts", "warnings", "assets")} if known else {}
    seen = walk(spark, ",".join(targets), exclude=exclude).where(~(F.col("path").isin(targets) & F.col("error").eqNullSafe(F.lit("FileNotFoundError"))))
    none = F.lit(None).cast("string")
    seen = carry_over(seen, old["files"], ("path",)) if known and old["files"].columns else seen.withColumns({"quick_sig": none, "sha256": none})
    walked = draft.scratch("walked", seen)
    found = _recognised(draft, walked, here, old, load(plugins))
    number = F.lit(draft.number)
    assets = found["assets"].withColumn("version", number)
    if known:
        before = old["assets"].select("asset_id", F.col("fingerprint").alias("_was"), F.lit(True).alias("_known"))
        assets = assets.join(before, "asset_id", "left").withColumn("action", F.when(F.col("_known").isNull(), "inserted").when(F.col("fingerprint").eqNullSafe(F.col("_was")), "unchanged").otherwise("updated")).drop("_was", "_known")
        gone = old["assets"].join(found["assets"].select("asset_id"), "asset_id", "left_anti").withColumns({"is_missing": F.lit(True), "action": F.lit("missing"), "version": number})
        assets = assets.unionByName(gone, allowMissingColumns=True)
    else:
        assets = assets.withColumn("action", F.lit("inserted"))
    fresh = {"files": found["files"], "facts": found["facts"], "warnings": found["warnings"], "assets": assets}
    tables = {}
    for name, rows in fresh.items():
        rows = draft.scratch(f"new_{name}", rows)
        key = F.col("asset_id") if name == "assets" else owner_key(rows)
        touched = rows.select(draft.bucket(key).alias("b"))
        if known and old[name].columns:
            touched = touched.union(old[name].select(draft.bucket(key).alias("b")))
        buckets = {r["b"] for r in touched.distinct().collect()}  # as many as there are buckets, at most
        if known and old[name].columns:
            rows = rows.unionByName(store.table(name, buckets).where(~here()), allowMissingColumns=True)
        tables[name] = (rows, key, buckets)
    applied = {"scan": draft.number} | ({stream: batch} if stream is not None else {})
    if add_roots:
        scanned = spark.createDataFrame([(r,) for r in targets], "root string").withColumns({"enabled": F.lit(True), "scanned_at": F.current_timestamp()})
        tables["roots"] = (store.table("roots").where(~F.col("root").isin(targets)).unionByName(scanned) if "roots" in draft.before.schemas else scanned, F.lit(0), None)
    draft.publish(tables, applied)
    return True


def details_of(known: DataFrame) -> DataFrame:
    """(asset_id, DETAILS...): of each detail the value of the best fact of known(asset_id, key, value, source_rank, confidence, seq)."""
    best = best_facts(known.where(F.col("asset_id").isNotNull() & F.col("key").isin(*DETAILS)))
    return best.groupBy("asset_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in DETAILS])


def _recognised(draft: Draft, walked: DataFrame, here: Callable[..., Column], old: dict[str, DataFrame], own: Plugins) -> dict[str, DataFrame]:
    """The tables files, facts, warnings and assets of walked files; nothing above ``here`` is an asset."""
    read = walked.where("error is null")
    listed = read.select("path", "size_bytes")
    profiles = draft.scratch("profiles", guarded(directory_profiles(listed)).where(here("dir")))
    # a file that is as it was isn't opened again
    asked = read.select("path", "size_bytes", "mtime")
    if old and old["facts"].columns:
        same = old["files"].select("path", "size_bytes", "mtime")
        news = facts(asked.join(same, ["path", "size_bytes", "mtime"], "left_anti")).unionByName(old["facts"].drop("asset_id").join(asked.join(same, ["path", "size_bytes", "mtime"]).select("path"), "path", "left_semi"))
    else:
        news = facts(asked)
    news = draft.scratch("facts", news)
    security = security_hits(listed, table_families(listed))
    own = checked(own, profiles=profiles)
    found = draft.scratch("candidates", candidate_hits(profiles, mot_folders(profiles), coco_folders(news), security, *hits_of(own.detectors, profiles)).where(here()))
    hits = draft.scratch("hits", surviving_claims(found).withColumn("asset_id", F.xxhash64("path")))
    owned = owners(walked.select("path"), hits.select(F.col("path").alias("root")))
    files = walked.join(owned, "path", "left").withColumn("asset_id", F.when(F.col("owner").isNotNull(), F.xxhash64("owner")))
    files = draft.scratch("files", files.withColumn("relpath", F.substring("path", F.length("owner") + 2, F.length("path"))).drop("owner"))
    known_facts = draft.scratch("known_facts", news.join(files.select("path", "asset_id"), "path"))
    told = draft.scratch("details", details_of(known_facts))
    mine = files.where("error is null and asset_id is not null")
    sizes = mine.groupBy("asset_id").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("n_files"), F.timestamp_seconds(F.max("mtime")).alias("modified_at"))
    prints = fingerprints(mine, "asset_id", [F.col("relpath"), F.col("size_bytes"), F.floor("mtime")])
    described = hits.join(profiles.withColumnRenamed("dir", "path").withColumnRenamed("n_files", "file_count").drop("bytes", "refused", "branching"), "path").withColumn("name", name_of(F.col("path")))
    words = F.concat_ws(" ", "repo_id", "base_model", "tags", "class_names", "pipeline_tag")
    described = draft.scratch("described", described.join(told.withColumn("haystack", words), "asset_id", "left"))
    numbers = [F.col(c).try_cast("bigint").alias(c) for c in ("num_images", "num_annotations", "param_count")]
    summary_of = draft.scratch("summaries", described.select("asset_id", "kind", "name", "base_model", "framework", "architecture", *numbers).join(file_summary(mine.select("asset_id", "relpath", "size_bytes")), "asset_id", "left"))
    own = checked(own, summaries=prepared(summary_of)) if own.rules or own.statistics else own
    marks = health(summary_of, own=own.rules).select("asset_id", F.col("score").alias("health_score"), F.col("status").alias("health_status"))
    codes = findings(summary_of, own=own.rules).groupBy("asset_id").agg(F.array_sort(F.collect_list("code")).alias("health_findings"))
    assets = described.select("asset_id", "path", "name", "kind", "detector").join(sizes, "asset_id", "left").join(prints, "asset_id", "left").join(classified(described), "asset_id")
    assets = assets.join(marks, "asset_id").join(codes, "asset_id", "left").join(statistics(summary_of, own=own.statistics), "asset_id").na.fill(0, ["size_bytes", "n_files"]).withColumn("is_missing", F.lit(False))
    whose = identified(described.select("asset_id", "path", "name")).drop("task", "component")
    assets = assets.join(draft.scratch("identities", whose), "asset_id", "left").join(told, "asset_id", "left")
    unread = files.where("error is not null").select("path", "asset_id", F.lit("unreadable").alias("code"), F.col("error").alias("message"))
    wrong = known_facts.where("key = 'error'").select("path", "asset_id", F.lit("header").alias("code"), F.col("value").alias("message"))
    warnings = unread.unionByName(wrong)
    if own.problems:
        warnings = warnings.unionByName(draft.store.spark.createDataFrame([(where, None, "plugin", why) for where, why in own.problems], warnings.schema))
    return {"files": files, "facts": known_facts, "warnings": warnings, "assets": assets}


def set_root(spark: SparkSession, folder: str, root: str, enabled: bool | None) -> None:
    """Adds a root or sets whether it is scanned and watched; None removes it, what was found below stays in the catalogue."""
    if not root:
        raise ValueError("which root?")
    store, root = Store(spark, folder), root.rstrip("/") or "/"
    columns = "root string, enabled boolean, scanned_at timestamp"
    old = store.table("roots") if store.manifest() else spark.createDataFrame([], columns)
    rows = old.where(F.col("root") != root)
    if enabled is not None:
        mine = old.where(F.col("root") == root).withColumn("enabled", F.lit(enabled))
        rows = rows.unionByName(mine if not mine.isEmpty() else spark.createDataFrame([(root, enabled, None)], columns))
    store.draft().publish({"roots": (rows, F.lit(0), None)})


def present(spark: SparkSession, folder: str) -> DataFrame:
    """The assets that aren't missing."""
    return table(spark, folder, "assets").where("not is_missing")


def inventory(spark: SparkSession, folder: str, selector: str = "all", sort: str = "size", ascending: bool = False) -> DataFrame:
    """Assets of the categories that a selector names, in a total order; ValueError for an unknown selector."""
    wanted = resolve(selector)
    if wanted is None:
        raise ValueError(f"no category, group, section or domain is called {selector!r}")
    by = F.col(SORTS.get(sort, "size_bytes"))
    found = present(spark, folder).where(F.col("category").isin(wanted))
    return found.orderBy(by.asc() if ascending or sort in ("name", "health") else by.desc(), F.asc("asset_id"))


def reindex(spark: SparkSession, folder: str) -> str:
    """The path of the full-text index of the last scan, which is built if there is none yet; those of earlier scans go.

    An asset's text is its name, path, kind, category, family, detector, and
    what headers, sidecars and cards say of it.
    """
    store = Store(spark, folder)
    held = store.manifest()
    if held is None:
        raise ValueError(f"no catalogue in {folder}")
    top = f"{folder.rstrip('/')}/_index"
    place = f"{top}/{held.applied.get('scan', 0)}"
    if not store.exists(f"{place}/_DONE"):
        store.delete(top)
        told = store.table("facts").where(F.col("key").isin(*TOLD)).groupBy("asset_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set(F.substring("value", 1, 2000)))).alias("told"))
        texts = store.table("assets").join(told, "asset_id", "left").select("asset_id", F.concat_ws(" ", "name", "path", "kind", "category", "family", "detector", "told").alias("text"))
        textindex.build(texts, "text", "asset_id", place)
        store.put(f"{place}/_DONE", "")
    return place


def items(assets: DataFrame) -> DataFrame:
    """Assets of a catalogue as items of reports: what they are, hold and weigh, under the names of an export's columns."""
    words = vocabulary(assets.sparkSession).select(F.col("id").alias("category"), "section", "domain", F.col("label").alias("category_label"))
    held = lambda *names: F.coalesce(*[F.try_element_at("statistics", F.lit(n)).try_cast("bigint") for n in names])
    # the vocabulary is a fixed table
    return assets.join(F.broadcast(words), "category", "left").withColumns({
        "name": F.coalesce("display_name", "name"), "subcategory": F.col("kind"), "format": F.col("detector"), "parameters": F.col("param_count"), "file_count": F.col("n_files"), "last_modified": F.col("modified_at"), "drive": drive(F.col("path")),
        "images": F.coalesce(F.col("num_images").try_cast("bigint"), held("images")), "videos": held("videos"), "annotations": F.coalesce(F.col("num_annotations").try_cast("bigint"), held("annotations", "label_files")),
        "root_folder": F.regexp_replace("path", "/[^/]*$", ""), "task": F.coalesce("task", "pipeline_tag"),
    })


def search(spark: SparkSession, folder: str, query: str, limit: int | None = None, offset: int = 0, sort: str = "relevance") -> DataFrame:
    """Assets that a query of the small language asks for, in order; with ``limit``, that page of them.

    Words rank the assets that hold a word beginning with each of them, by
    BM25 over the stored index (column score); facets restrict what is ranked.
    Other orders are those of SORTS; without words relevance is size. An empty
    query asks for all.
    """
    q: Query = parse(query, tuple(SEARCHED))
    found = table(spark, folder, "assets") if q.missing else present(spark, folder)
    words = [w for t in q.terms for w in re.findall(r"[^\W_]+", t.lower())]
    q.terms = [t for t in q.terms if not re.search(r"[^\W_]", t)]  # signs alone aren't in the index
    found = found.where(q.condition(SEARCHED, "size_bytes", "modified_at", ["name", "path"]))
    by, up = (F.col(SORTS.get(sort, "size_bytes")), sort in ("name", "health"))
    order = [by.asc() if up else by.desc(), F.asc("asset_id")]
    if words:
        wanted = offset + limit if limit is not None and sort == "relevance" else (1 << 31) - 1
        best = textindex.ranked(spark, reindex(spark, folder), words, wanted, prefixes=True, every=True, allowed=found.select("asset_id")).rows
        found = found.join(best.withColumnRenamed("key", "asset_id"), "asset_id")
        order = [F.desc("score"), F.asc("asset_id")] if sort == "relevance" else order
    found = found.orderBy(*order)
    return found.offset(offset).limit(limit) if limit is not None else found


def locate(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Assets whose name or path holds a text, case aside, largest first."""
    hit: Column = F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("path"), F.lit(text.lower()))
    return present(spark, folder).where(hit).orderBy(F.desc("size_bytes"), F.asc("asset_id"))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(dimension, value, n_assets, total_bytes) for all assets and by category, kind, detector and health."""
    return summary(present(spark, folder), ["category", "kind", "detector", "health_status"])


def candidates(spark: SparkSession, roots: list[str], folder: str | None = None) -> DataFrame:
    """(dir, score) of promising folders below roots that no catalogued root holds, best first."""
    files = walk(spark, ",".join(roots)).where("error is null").select("path", "size_bytes")
    found = discovered(directory_profiles(files))
    if folder and Store(spark, folder).manifest():
        managed = table(spark, folder, "roots").select("root")
        inside = owners(found.select(F.col("dir").alias("path")), managed).select(F.col("path").alias("dir")).union(managed)
        found = found.join(inside, "dir", "left_anti")
    return found.orderBy(F.desc("score"), "dir")


def hash_files(spark: SparkSession, folder: str, least: int = 1 << 20, asked: Column | None = None) -> DataFrame:
    """The files, after those (``asked``, or all of ``least`` bytes or more) of colliding sizes are signed and those of colliding signatures hashed in full.

    What an earlier pass signed or hashed isn't read again, and only buckets
    with new digests are rewritten.
    """
    store = Store(spark, folder)
    draft, kept = store.draft(), store.table("files")
    real = kept.where(F.col("error").isNull() & ~F.col("is_symlink")).where(F.col("size_bytes") >= least if asked is None else asked)
    shared = real.groupBy("size_bytes").count().where("count > 1").select("size_bytes")
    same = real.join(shared, "size_bytes", "left_semi")
    signed = same.where("quick_sig is not null").unionByName(quick_signatures(same.where("quick_sig is null").drop("quick_sig")))
    signed = draft.scratch("signed", signed.where("quick_sig is not null"))
    often = signed.groupBy("size_bytes", "quick_sig").count().where("count > 1").drop("count")
    collide = signed.join(often, ["size_bytes", "quick_sig"], "left_semi")
    hashed = collide.where("sha256 is not null").unionByName(full_digests(collide.where("sha256 is null").drop("sha256")))
    _store_digests(draft, signed.select("path", "quick_sig"), hashed.select("path", "sha256"))
    return store.table("files")


def _store_digests(draft: Draft, signed: DataFrame, hashed: DataFrame) -> None:
    """Publishes signed(path, quick_sig) and hashed(path, sha256) in the buckets of files to which they add."""
    store = draft.store
    hashed = draft.scratch("hashed", hashed.select("path", "sha256").where("sha256 is not null"))
    found = draft.scratch("found", signed.withColumnRenamed("quick_sig", "_sig").join(hashed.withColumnRenamed("sha256", "_sha"), "path", "full"))
    files = store.table("files")
    news = files.join(found, "path").where("quick_sig is null and _sig is not null or sha256 is null and _sha is not null")
    buckets = {r["b"] for r in news.select(draft.bucket(owner_key(files)).alias("b")).distinct().collect()}
    if buckets:
        rows = store.table("files", buckets).join(found, "path", "left")
        rows = rows.withColumns({"quick_sig": F.coalesce("_sig", "quick_sig"), "sha256": F.coalesce("_sha", "sha256")}).drop("_sig", "_sha").select(files.columns)
        draft.publish({"files": (rows, owner_key(rows), buckets)})


def duplicates(spark: SparkSession, folder: str, least: int = 1 << 20) -> DataFrame:
    """(size_bytes, sha256, n_files, n_copies, wasted_bytes, shared_bytes, keeper, paths) of files of equal content; hard links of one file are one copy."""
    hashed = hash_files(spark, folder, least).where(F.col("sha256").isNotNull() & (F.col("size_bytes") >= least))
    return dedup.file_groups(hashed)


def duplicate_assets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(groups of assets of equal content, pairs of alike ones).

    Payload files are signed and hashed where their sizes and signatures
    collide, and also the rest of the payload of any asset that shares a
    digest: alike assets are told by what they don't share too. Assets of
    equal payload are then compared by their small defining files, which are
    hashed for these only.
    """
    live = present(spark, folder).select("asset_id")

    def own():
        return Store(spark, folder).table("files").where("asset_id is not null and error is null and not is_symlink").join(live, "asset_id", "left_semi").withColumn("is_payload", dedup.is_payload(F.col("relpath")))

    hash_files(spark, folder, asked=F.col("asset_id").isNotNull() & dedup.is_payload(F.col("relpath")))
    draft = Store(spark, folder).draft()
    payload = own().where("is_payload")
    shared = payload.where("sha256 is not null").groupBy("sha256").agg(F.min("asset_id").alias("a"), F.max("asset_id").alias("b")).where("a < b").select("sha256")
    sharing = payload.join(shared, "sha256", "left_semi").select("asset_id").distinct()
    open_ones = payload.where("sha256 is null").join(sharing, "asset_id", "left_semi")
    _store_digests(draft, open_ones.select("path", F.lit(None).cast("string").alias("quick_sig")), full_digests(open_ones.drop("sha256")))
    draft = Store(spark, folder).draft()
    colliding = dedup.equal_payloads(own()).select("asset_id")
    small = own().where(~F.col("is_payload") & dedup.is_defining(F.col("relpath"), F.col("size_bytes")) & F.col("sha256").isNull()).join(colliding, "asset_id", "left_semi")
    _store_digests(draft, small.select("path", F.lit(None).cast("string").alias("quick_sig")), full_digests(small.drop("sha256")))
    files = own()
    return dedup.asset_groups(files), dedup.near_assets(files)


def duplicate_installations(spark: SparkSession, folder: str, least_bytes: int = installations.LEAST_BYTES, across_applications: bool = False) -> DataFrame:
    """Assets that are installed several times, by digests where all their files have them, else by what they look like; see operators.installations."""
    assets = table(spark, folder, "assets").withColumn("application", F.coalesce("product", "source"))
    files = table(spark, folder, "files").where("asset_id is not null and error is null and not is_symlink")
    return installations.duplicate_installations(assets, files, least_bytes, across_applications).orderBy(F.desc("reclaimable_bytes"), F.desc("install_count"), "keeper")

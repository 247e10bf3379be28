"""Command line: ``python -m shelfmark scan [ROOT...] | watch | roots | discover ROOT... | list | search QUERY | where TEXT | show PATH | health | stats | duplicates | installations | warnings | status | facts``."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import library
from shelfmark.plans.export import csv_rows, export
from shelfmark.sources import stores
from shelfmark.sources.headers import facts
from shelfmark.sources.locations import known_locations
from shelfmark.streaming.service import MOST_SECONDS, QUIET_SECONDS, Watch


def shown(rows: DataFrame, limit: int) -> None:
    """Prints the first rows, and of how many they are where there are more."""
    rows.show(limit, truncate=False)
    total = rows.count()
    if total > limit:
        print(f"{limit} of {total} rows; --limit shows more")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    top.add_argument("--catalog", default="catalog", help="folder of the catalogue's tables")
    top.add_argument("--limit", type=int, default=50, help="rows shown; exports hold all")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="walk folders and write the catalogue")
    scan.add_argument("roots", nargs="*", help="the enabled roots of the catalogue, if none is given")
    scan.add_argument("--exclude", default="", help="folder names, comma-separated")
    scan.add_argument("--plugins", help="folder of Python files with further rules")
    watch = commands.add_parser("watch", help="keep the catalogue in step with its folders")
    watch.add_argument("--exclude", default="", help="folder names, comma-separated")
    watch.add_argument("--quiet", type=float, default=QUIET_SECONDS, help="seconds without a change after which a batch is taken in")
    watch.add_argument("--most", type=float, default=MOST_SECONDS, help="seconds after which a batch is taken in anyway")
    watch.add_argument("--once", action="store_true", help="catch up with what changed since the last time, and end")
    watch.add_argument("--stop", action="store_true", help="ask a running watcher to stop")
    watch.add_argument("--status", action="store_true", help="what a watcher does and has done")
    roots = commands.add_parser("roots", help="managed folders")
    roots.add_argument("action", nargs="?", choices=("list", "add", "remove", "enable", "disable"), default="list")
    roots.add_argument("path", nargs="?")
    listed = commands.add_parser("list", help="assets of a category, group, section or domain")
    listed.add_argument("selector", nargs="?", default="all")
    listed.add_argument("--sort", choices=sorted(library.SORTS), default="size")
    listed.add_argument("--ascending", action="store_true")
    listed.add_argument("--limit", type=int, default=argparse.SUPPRESS, help="rows shown; exports hold all")
    listed.add_argument("--format", choices=("table", "csv", "json", "markdown"), default="table")
    listed.add_argument("--out", help="folder of an export")
    commands.add_parser("stats", help="counts and bytes by category, kind and detector")
    discover = commands.add_parser("discover", help="promising folders that no catalogued root holds; without roots, known places of tools")
    discover.add_argument("roots", nargs="*")
    discover.add_argument("--homes", nargs="*", default=[os.path.expanduser("~")], help="homes in which known places are looked for")
    commands.add_parser("search", help="assets by words and key:value pairs").add_argument("query")
    commands.add_parser("where", help="assets whose name or path holds a text").add_argument("text")
    commands.add_parser("show", help="all that is known of an asset").add_argument("path")
    commands.add_parser("health", help="assets with findings, the worst first")
    commands.add_parser("status", help="roots, when they were scanned, and what the last scan changed")
    commands.add_parser("duplicates", help="files of equal content").add_argument("--least", type=int, default=1 << 20)
    installed = commands.add_parser("installations", help="assets that are installed several times")
    installed.add_argument("--least", type=int, default=library.installations.LEAST_BYTES)
    installed.add_argument("--across", action="store_true", help="only those of different applications")
    commands.add_parser("warnings", help="what couldn't be read, and rules that don't work")
    commands.add_parser("facts", help="facts from the headers of the catalogued files").add_argument("--under", default="", help="path prefix")
    return top


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(words)
    spark = spark or SparkSession.builder.appName("shelfmark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command == "scan":
        print(f"{library.scan(spark, args.roots or Watch(spark, args.catalog).roots(), args.catalog, args.exclude, args.plugins).count()} assets")
    elif args.command == "watch":
        watch = Watch(spark, args.catalog, args.quiet, args.most, args.exclude)
        if args.stop:
            print("asked to stop" if watch.request_stop() else "no watcher runs")
        elif args.once:
            print("caught up" if watch.catch_up() else "a watcher runs, or the last time is too recent")
        else:
            print(json.dumps(watch.status() if args.status else watch.run(ready=lambda roots: print("watching", *roots)), indent=2))
    elif args.command == "roots":
        if args.action != "list":
            library.set_root(spark, args.catalog, args.path, {"add": True, "enable": True, "disable": False, "remove": None}[args.action])
        shown(library.table(spark, args.catalog, "roots").orderBy("root"), args.limit)
    elif args.command == "list":
        found = library.inventory(spark, args.catalog, args.selector, args.sort, args.ascending)
        if args.format != "table":
            rows = csv_rows(library.items(found)) if args.format == "csv" else found
            export(rows, args.format, args.out or f"{args.catalog}/{args.format}")
            if args.format != "csv":  # what the rows come to, beside them
                export(library.totals(spark, args.catalog).orderBy("dimension", F.desc("total_bytes"), "value"), args.format, f"{args.out or f'{args.catalog}/{args.format}'}-summary", "Summary")
        else:
            shown(found.select("name", "category", "family", "size_bytes", "n_files", "path"), args.limit)
    elif args.command == "discover":
        if args.roots:
            shown(library.candidates(spark, args.roots, args.catalog), args.limit)
        else:
            shown(known_locations(spark, args.homes, dict(os.environ)).orderBy("group", "path"), args.limit)
    elif args.command in ("search", "where"):
        found = library.search(spark, args.catalog, args.query) if args.command == "search" else library.locate(spark, args.catalog, args.text)
        shown(found.select("name", "category", "family", "size_bytes", "n_files", "path"), args.limit)
    elif args.command == "show":
        asset = library.table(spark, args.catalog, "assets").where(F.col("path") == args.path)
        asset.show(1, truncate=False, vertical=True)
        for name, columns in (("facts", ("path", "key", "value", "confidence")), ("warnings", ("path", "code", "message"))):
            shown(library.table(spark, args.catalog, name).join(asset.select("asset_id"), "asset_id", "left_semi").select(*columns).orderBy(*columns[:2]), args.limit)
    elif args.command == "health":
        shown(library.inventory(spark, args.catalog, sort="health").where("health_findings is not null").select("health_score", "health_status", "health_findings", "path"), args.limit)
    elif args.command == "status":
        shown(library.table(spark, args.catalog, "roots").orderBy("root"), args.limit)
        library.table(spark, args.catalog, "assets").groupBy("action").count().orderBy("action").show()
    elif args.command == "stats":
        shown(library.totals(spark, args.catalog).orderBy("dimension", F.desc("total_bytes"), "value"), args.limit)
    elif args.command == "installations":
        shown(library.duplicate_installations(spark, args.catalog, args.least, args.across), args.limit)
    elif args.command == "warnings":
        shown(library.table(spark, args.catalog, "warnings").orderBy("path", "code"), args.limit)
    elif args.command == "duplicates":
        shown(library.duplicates(spark, args.catalog, args.least).orderBy(F.desc("wasted_bytes"), "sha256"), args.limit)
    else:
        files = library.table(spark, args.catalog, "files").where(F.col("error").isNull() & F.startswith("path", F.lit(args.under)))
        # folders of assets are the roots of their datasets
        inside = files.join(library.present(spark, args.catalog).select("asset_id", F.col("path").alias("root")), "asset_id").select("root", "path")
        found = facts(files).unionByName(stores.hub_caches(files.select("path", F.col("size_bytes").alias("size"), "mtime"))).unionByName(stores.ollama_models(files.select("path", F.col("size_bytes").alias("size"))))
        found = found.unionByName(stores.yolo_datasets(inside)).unionByName(stores.voc_datasets(inside))
        shown(found.orderBy("path", "seq"), args.limit)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

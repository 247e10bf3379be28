"""Rules of others, and installations."""

from shelfmark import library
from shelfmark.operators.installations import duplicate_installations

GOOD = '''
from pyspark.sql import functions as F
from shelfmark.operators.health import HealthRule

HEALTH_RULES = [
    HealthRule("own.many_files", "warning", F.col("file_count") > 2, "many files"),
    HealthRule("own.unresolved", "error", F.col("no_such_column") > 1, "never"),
    HealthRule("own.raises", "error", F.raise_error(F.concat(F.lit("bad "), "name")).cast("boolean"), "never"),
    HealthRule("own.number", "error", F.col("file_count"), "never"),
]
STATISTICS = [("own", {"own_files": F.col("file_count").cast("string"), "own_bad": F.col("nothing")})]
DETECTORS = [("own_kind", 99, "model", True, F.array_contains("names", "own.marker")), ("own_broken", 99, "model", True, F.col("nope") > 1)]
'''


def test_plugins_are_isolated(spark, tmp_path):
    plugins, root, out = tmp_path / "plugins", tmp_path / "in", str(tmp_path / "cat")
    plugins.mkdir()
    (plugins / "good.py").write_text(GOOD)
    (plugins / "broken.py").write_text("this is no python")
    (plugins / "raises.py").write_text("raise RuntimeError('at import')")
    (plugins / "other.py").write_text("HEALTH_RULES = ['a string']")
    for name, files in (("m", ("config.json", "model.safetensors", "README.md")), ("own", ("own.marker", "x.txt"))):
        (root / name).mkdir(parents=True)
        for f in files:
            (root / name / f).write_text("{}")
    library.scan(spark, [str(root)], out, plugins=str(plugins))
    rows = {r["name"]: r for r in library.table(spark, out, "assets").collect()}
    assert "own.many_files" in rows["m"]["health_findings"] and rows["own"]["detector"] == "own_kind"
    assert rows["m"]["statistics"]["own_files"] == "3" and "own_bad" not in rows["m"]["statistics"]
    told = {r["path"]: r["message"] for r in library.table(spark, out, "warnings").where("code = 'plugin'").collect()}
    assert set(told) == {"broken.py", "raises.py", "other.py", "rule own.unresolved", "rule own.raises", "rule own.number", "statistic own_bad", "detector own_broken"}
    assert "at import" in told["raises.py"] and "UNRESOLVED" in told["rule own.unresolved"] and "bigint" in told["rule own.number"]


def test_installations(spark):
    mib = 1 << 20

    def found(rows, **options):
        assets = spark.createDataFrame([(i, f"n{i}", size, missing, app) for i, (app, size, missing, _) in enumerate(rows)], "asset_id long, name string, size_bytes long, is_missing boolean, application string")
        files = spark.createDataFrame([(i, path, n, sha) for i, (*_, of) in enumerate(rows) for path, n, sha in of], "asset_id long, relpath string, size_bytes long, sha256 string")
        return [tuple(r) for r in duplicate_installations(assets, files, **options).select("verified", "install_count", "unit_bytes", "reclaimable_bytes", "sources").collect()]

    one = [("a/model.tflite", 8 * mib, None)]
    assert found([(app, 8 * mib, False, one) for app in ("Chrome", "Edge", "Cursor")]) == [(False, 3, 8 * mib, 16 * mib, ["Chrome", "Cursor", "Edge"])]
    digests = lambda *x: [(f"{i}.bin", 4 * mib, d * 64) for i, d in enumerate(x)]
    assert found([("a", 8 * mib, False, digests("f", "e")), ("b", 8 * mib, False, digests("e", "f"))]) == [(True, 2, 8 * mib, 8 * mib, ["a", "b"])]
    assert found([("a", 8 * mib, False, digests("a")), ("b", 8 * mib, False, digests("b"))]) == []
    assert found([("a", 8 * mib, False, one), ("b", 8 * mib, False, [("enc", 4 * mib, None), ("dec", 4 * mib, None)])]) == []
    assert found([("a", 1024, False, [("m", 1024, None)])] * 2) == [] and found([("a", 8 * mib, False, one), ("b", 8 * mib, True, one)]) == []
    assert len(found([("Chrome", 8 * mib, False, one)] * 2)) == 1 and found([("Chrome", 8 * mib, False, one)] * 2, across_applications=True) == []
    many = [(f"f{i:03}", i, None) for i in range(300)]
    assert len(found([("a", 8 * mib, False, many), ("b", 8 * mib, False, many[::-1])])) == 1
    assert found([]) == []


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as G

    from shelfmark.functions import units
    from shelfmark.operators.installations import layouts
    from shelfmark.operators.recognise import archive_kind

    monkeypatch.setattr(units, "TASK_ROWS", 10)
    members = spark.range(170).select((G.col("id") % 40).alias("archive"), G.lit("a.csv").alias("name"), G.lit(1).alias("size"))
    kinds = archive_kind(members)
    assert kinds.rdd.getNumPartitions() == 17 and kinds.groupBy().agg(G.sum("members_listed")).first()[0] == 170
    files = spark.range(170).selectExpr("id % 40 AS asset_id", "concat('d/', id) AS relpath", "id AS size_bytes", "CAST(NULL AS STRING) AS sha256")
    signed = layouts(spark.range(40).selectExpr("id AS asset_id", "1L AS size_bytes"), files)
    assert "hashpartitioning(asset_id" in signed._jdf.queryExecution().executedPlan().toString() and ", 17)" in signed._jdf.queryExecution().executedPlan().toString() and signed.count() == 40

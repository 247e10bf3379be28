"""Registered queries of the catalogue operators over the driver's tables, each with its SQL.

The tables play the catalogue's parts: documents are files (doc_id, n_chars as
size, lang as extension, source as owner), orders are assets (status as drive,
priority as kind, price as size, date as modification), lineitem their files,
part and supplier details, labels tags, page URLs paths, events file events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.units import ancestors, drive, format_bytes, parse_size, segments
from shelfmark.operators import catalogue as C
from shelfmark.operators import dedup as D
from shelfmark.operators import recognise as R
from shelfmark.operators import search as S
from shelfmark.operators import textindex
from shelfmark.sources.places import new_place
from shelfmark.streaming import watch as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, d) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("size_bytes"), F.col("lang").alias("extension"), F.col("source").alias("asset"), F.col("text").alias("content"))


def assets(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("asset_id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("drive"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("size_bytes"), F.col("o_orderdate").alias("modified_at")
    )


def paths(spark, d) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("path"))


ASSETS = "(SELECT o_orderkey AS asset_id, o_custkey AS owner, o_orderstatus AS drive, o_orderpriority AS kind, o_totalprice AS size_bytes, o_orderdate AS modified_at FROM orders)"
PATHS = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
ABOVE = f"(SELECT page_id, path, array_to_string(string_split(path, '/')[1:n], '/') AS above, n FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS n FROM {PATHS}))"


@query("""SELECT sha256(text) AS group_hash, count(*) AS member_count, max(n_chars) AS unit_size_bytes, CAST(sum(n_chars) - max(n_chars) AS BIGINT) AS wasted_bytes, min(doc_id) AS keeper
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    return D.duplicate_groups(files(spark, d))


@query("""SELECT doc_id AS file_id, group_hash, member_count, nth = 1 AS is_keeper FROM (SELECT doc_id, sha256(text) AS group_hash, count(*) OVER (PARTITION BY sha256(text)) AS member_count,
row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM documents) WHERE member_count > 1""")
def duplicate_members(spark, d):
    return D.duplicate_members(files(spark, d)).select("file_id", "group_hash", "member_count", "is_keeper")


@query("SELECT CAST(coalesce(sum(w), 0) AS BIGINT) AS wasted_bytes, count(*) AS n_groups FROM (SELECT sum(n_chars) - max(n_chars) AS w FROM documents GROUP BY sha256(text) HAVING count(*) > 1)")
def duplicate_total_waste(spark, d):
    return D.duplicate_groups(files(spark, d)).agg(F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"), F.count("*").alias("n_groups"))



SIGNATURE = "count(*) || ':' || string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus)"


@query(f"""WITH s AS (SELECT l_orderkey, {SIGNATURE} AS signature FROM lineitem GROUP BY 1)
SELECT signature, count(*) AS member_count, max(o_totalprice) AS unit_bytes, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS sources, round(max(o_totalprice) * (count(*) - 1), 2) AS reclaimable_bytes
FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) > 1""")
def duplicate_installations(spark, d):
    flags = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))), lambda x: F.concat(x["l_returnflag"], x["l_linestatus"]))
    signed = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("asset_id")).agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.array_join(flags, ",")).alias("shape"))
    return D.installations(assets(spark, d).join(signed, "asset_id"), F.col("shape"), "size_bytes", "drive")


@query(f"""SELECT a.* FROM {ASSETS} a WHERE drive IN ('F', 'O') AND kind IN ('1-URGENT', '2-HIGH') AND size_bytes BETWEEN 1000 AND 400000 AND modified_at >= '1995-01-01' AND modified_at < '1996-01-01'
AND owner IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def asset_filter(spark, d):
    details = t(spark, d, "customer").withColumnRenamed("c_custkey", "owner")
    f = C.AssetFilter({"drive": ["F", "O"], "kind": ["1-URGENT", "2-HIGH"]}, 1000, 400000, 1995, related=[(details, "owner", F.col("c_mktsegment") == "BUILDING")])
    return f.apply(assets(spark, d))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def negated_tag(spark, d):
    toxic = t(spark, d, "labels").where("toxic = 1")
    return C.AssetFilter({"lang": ["en"]}, excluded=[(toxic, "doc_id")]).apply(t(spark, d, "documents")).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 1)")
def tag_any(spark, d):
    return C.AssetFilter(related=[(t(spark, d, "labels"), "doc_id", (F.col("toxic") == 1) | (F.col("quality") == 1))]).apply(t(spark, d, "documents")).select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%1%' OR p_brand ILIKE '%a%1%' OR p_type ILIKE '%a%1%'")
def free_text(spark, d):
    return C.AssetFilter(text="a%1", text_columns=("p_name", "p_brand", "p_type")).apply(t(spark, d, "part")).select("p_partkey", "p_name")


@query(f"SELECT asset_id, size_bytes FROM {ASSETS} ORDER BY size_bytes DESC, asset_id LIMIT 25 OFFSET 50")
def list_page(spark, d):
    return C.page(assets(spark, d), "size_bytes", limit=25, offset=50).select("asset_id", "size_bytes")



@query(f"SELECT coalesce(drive, 'unknown') AS key, round(sum(size_bytes), 2) AS total_bytes, count(*) AS n_assets FROM {ASSETS} GROUP BY 1")
def storage_by_drive(spark, d):
    return C.storage_by(assets(spark, d), "drive")



@query(f"""SELECT CASE WHEN grouping(drive) = 0 THEN 'drive' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'all' END AS dimension,
CASE WHEN grouping(drive) = 0 THEN coalesce(drive, 'unknown') WHEN grouping(kind) = 0 THEN coalesce(kind, 'unknown') ELSE '' END AS value, count(*) AS n_assets, round(sum(size_bytes), 2) AS total_bytes
FROM {ASSETS} GROUP BY GROUPING SETS ((drive), (kind), ())""")
def inventory_summary(spark, d):
    return C.summary(assets(spark, d), ["drive", "kind"])


@query("""WITH x AS (SELECT r_name AS a, n_name AS b, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT a AS path, 1 AS depth, c_acctbal FROM x UNION ALL SELECT a || '/' || b, 2, c_acctbal FROM x UNION ALL SELECT a || '/' || b || '/' || c, 3, c_acctbal FROM x WHERE c IS NOT NULL)
SELECT path, depth, count(*) AS n_assets, round(sum(c_acctbal), 2) AS total_bytes FROM p GROUP BY 1, 2""")
def inventory_tree(spark, d):
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = t(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("segment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return C.tree(x, ["r_name", "n_name", "segment"], "c_acctbal")



@query("""SELECT l_orderkey AS asset_id, l_returnflag AS key, l_extendedprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag
ORDER BY CASE l_linestatus WHEN 'F' THEN 100 ELSE 60 END DESC, l_discount DESC, l_linenumber * 10000000 + l_partkey) AS nth FROM lineitem) WHERE nth = 1""")
def best_facts(spark, d):
    facts = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_returnflag").alias("key"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_linestatus") == "F", 100).otherwise(60).alias("source_rank"), F.col("l_discount").alias("confidence"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("seq")
    )
    return C.best_facts(facts).select("asset_id", "key", "value")


@query("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'brass' WHEN lower(p_name) LIKE '%1%' AND p_size > 25 THEN 'large_one' WHEN p_retailprice > 1500 THEN 'costly' ELSE 'unclassified' END AS category FROM part""")
def classify(spark, d):
    rules = [("brass", F.lower("p_type").contains("brass")), ("large_one", F.lower("p_name").contains("1") & (F.col("p_size") > 25)), ("costly", F.col("p_retailprice") > 1500)]
    return t(spark, d, "part").select("p_partkey", C.first_match(rules, "unclassified").alias("category"))


def health_rules():
    return [("asset.missing", "error", F.col("drive") == "P"), ("asset.small", "warning", F.col("size_bytes") < 50000), ("asset.old", "info", F.year("modified_at") < 1994), ("asset.unsure", "warning", F.col("kind") == "4-NOT SPECIFIED")]


HEALTH = f"(SELECT asset_id, drive = 'P' AS e, size_bytes < 50000 AS w, year(modified_at) < 1994 AS i, kind = '4-NOT SPECIFIED' AS u FROM {ASSETS})"


@query(f"""SELECT asset_id, greatest(0, 100 - 25 * e::INT - 10 * w::INT - 3 * i::INT - 10 * u::INT) AS score, CASE WHEN e THEN 'error' WHEN w OR u THEN 'warning' ELSE 'ok' END AS status FROM {HEALTH}""")
def health_scores(spark, d):
    return C.health(assets(spark, d), health_rules())


@query(f"""SELECT asset_id, 'asset.missing' AS code, 'error' AS severity FROM {HEALTH} WHERE e UNION ALL SELECT asset_id, 'asset.small', 'warning' FROM {HEALTH} WHERE w
UNION ALL SELECT asset_id, 'asset.old', 'info' FROM {HEALTH} WHERE i UNION ALL SELECT asset_id, 'asset.unsure', 'warning' FROM {HEALTH} WHERE u""")
def health_findings(spark, d):
    return C.findings(assets(spark, d), health_rules())


@query("""SELECT source, lang, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE rank <= 3""")
def top_extensions(spark, d):
    return C.top_per_group(t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), ["source"], [F.desc("n"), F.col("lang")], 3)


@query(f"SELECT path, max_by(above, length(above)) AS owner FROM {ABOVE} WHERE above IN (SELECT above FROM {ABOVE} GROUP BY above HAVING count(DISTINCT page_id) >= 2) GROUP BY path")
def innermost_container(spark, d):
    p = paths(spark, d)
    roots = p.select("page_id", F.explode(ancestors(F.col("path"))).alias("root")).groupBy("root").agg(F.countDistinct("page_id").alias("n")).where("n >= 2")
    return C.owners(p.select("path"), roots)


@query(f"""WITH h AS (SELECT DISTINCT path, page_id % 2 = 0 AS claims FROM {PATHS} UNION SELECT DISTINCT above, false FROM {ABOVE} WHERE n = 2 UNION SELECT DISTINCT above, above LIKE '%.org' FROM {ABOVE} WHERE n = 1)
SELECT * FROM h WHERE path NOT IN (SELECT path FROM h, (SELECT path AS c FROM h WHERE claims) WHERE starts_with(path, c || '/'))""")
def claim_suppression(spark, d):
    p = paths(spark, d)
    above = p.select(F.split("path", "/").alias("s"))
    hits = p.select("path", (F.col("page_id") % 2 == 0).alias("claims")).union(above.where(F.size("s") > 2).select(F.array_join(F.slice("s", 1, 2), "/"), F.lit(False)))
    hits = hits.union(above.where(F.size("s") > 1).select(F.col("s")[0], F.col("s")[0].endswith(".org"))).distinct()
    return C.surviving_claims(hits)


@query("""WITH b AS (SELECT p_partkey AS base_id, p_brand || '/' || p_name AS repo, p_name AS name FROM part WHERE p_partkey % 3 = 0), c AS (SELECT p_partkey AS child_id, p_brand || '/' || p_name AS wanted, p_name AS tail FROM part WHERE p_partkey % 3 < 2),
r AS (SELECT lower(repo) AS key, min(base_id) AS id FROM b GROUP BY 1), n AS (SELECT lower(name) AS tail, min(base_id) AS id FROM b GROUP BY 1 HAVING count(*) = 1)
SELECT child_id, coalesce(r.id, n.id) AS base_id, CASE WHEN r.id IS NOT NULL THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM c LEFT JOIN r ON r.key = lower(wanted) LEFT JOIN n ON n.tail = lower(c.tail) WHERE coalesce(r.id, n.id) IS NOT NULL""")
def base_model_links(spark, d):
    p = t(spark, d, "part").withColumn("repo", F.concat_ws("/", "p_brand", "p_name"))
    return D.base_links(p.where("p_partkey % 3 < 2").select(F.col("p_partkey").alias("child_id"), F.col("repo").alias("wanted")), p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("base_id"), "repo", F.col("p_name").alias("name")))



@query(f"SELECT asset_id FROM {ASSETS} WHERE lower(drive) = 'f' AND lower(kind) IN ('1-urgent', '5-low') AND size_bytes >= 100000 AND size_bytes <= 300000 AND year(modified_at) = 1995 AND kind ILIKE '%low%'")
def query_language(spark, d):
    q = S.parse("drive:F kind:1-urgent kind:5-low size:>100k max:300k year:1995 low", ("drive", "kind"))
    return assets(spark, d).where(q.condition({"drive": "drive", "kind": "kind"}, "size_bytes", "modified_at", ["kind"])).select("asset_id")



@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS drive, len(list_filter(string_split(url, '/'), lambda s: s <> '')) AS depth FROM pages")
def path_parts(spark, d):
    return t(spark, d, "pages").select("page_id", drive(F.col("url")).alias("drive"), F.size(segments(F.col("url"))).cast("long").alias("depth"))


@query("SELECT l_orderkey, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT l_orderkey, l_linenumber || '|' || l_partkey || '|' || l_returnflag AS line FROM lineitem) GROUP BY 1")
def fingerprints(spark, d):
    return C.fingerprints(t(spark, d, "lineitem"), "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_returnflag")])


@query(f"""WITH o AS (SELECT asset_id, drive, kind FROM {ASSETS}), tgt AS (SELECT * FROM o WHERE asset_id % 5 <> 0), st AS (SELECT asset_id, CASE WHEN asset_id % 7 = 0 THEN 'X' ELSE drive END AS drive, kind FROM o WHERE asset_id % 3 <> 0)
SELECT coalesce(s.asset_id, x.asset_id) AS asset_id, coalesce(s.drive, x.drive) AS drive, coalesce(s.kind, x.kind) AS kind,
CASE WHEN x.asset_id IS NULL THEN 'inserted' WHEN s.asset_id IS NULL THEN 'kept' WHEN s.drive = x.drive AND s.kind = x.kind THEN 'unchanged' ELSE 'updated' END AS action FROM tgt x FULL JOIN st s USING (asset_id)""")
def upsert(spark, d):
    o = assets(spark, d).select("asset_id", "drive", "kind")
    staged = o.where("asset_id % 3 <> 0").withColumn("drive", F.when(F.col("asset_id") % 7 == 0, "X").otherwise(F.col("drive")))
    return C.upsert(o.where("asset_id % 5 <> 0"), staged, "asset_id", ["drive", "kind"])


@query("""SELECT user_id, batch, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS batch
FROM (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 7200000000 THEN 1 ELSE 0 END AS b FROM events)) GROUP BY 1, 2""")
def debounce_batches(spark, d):
    return W.sessions(t(spark, d, "events"), "user_id", 7200)



@query(f"""WITH c AS (SELECT path FROM {PATHS} WHERE page_id % 4 = 0), a AS (SELECT DISTINCT above AS root FROM {ABOVE} WHERE n = 2), r AS (SELECT DISTINCT above AS root FROM {ABOVE} WHERE n = 1),
m AS (SELECT c.path, r.root AS in_root, a.root AS asset FROM c JOIN r ON starts_with(c.path, r.root || '/') LEFT JOIN a ON starts_with(c.path, a.root || '/')),
tg AS (SELECT DISTINCT coalesce(asset, in_root) AS target FROM m WHERE asset IS NULL OR in_root NOT IN (SELECT in_root FROM m WHERE asset IS NULL)) SELECT target FROM tg WHERE (SELECT count(*) FROM tg) <= 24 UNION SELECT root FROM r WHERE (SELECT count(*) FROM tg) > 24""")
def rescan_targets(spark, d):
    p = paths(spark, d)
    parts = p.select(F.split("path", "/").alias("s"))
    roots = parts.where(F.size("s") > 1).select(F.col("s")[0].alias("root")).distinct()
    kept = parts.where(F.size("s") > 2).select(F.array_join(F.slice("s", 1, 2), "/").alias("root")).distinct()
    return W.rescan_targets(p.where("page_id % 4 = 0").select("path"), kept, roots)


@query("""SELECT page_id, marker, product FROM (SELECT page_id, marker, product, row_number() OVER (PARTITION BY page_id ORDER BY pos DESC, seq) AS nth FROM (SELECT page_id, unnest(regexp_split_to_array(lower(path), '[/.\\-_:]+')) AS marker, generate_subscripts(regexp_split_to_array(lower(path), '[/.\\-_:]+'), 1) AS pos FROM """ + PATHS + """)
JOIN (VALUES ('blog', 'journal', 1), ('en', 'english', 2), ('example', 'sample', 3)) v(marker, product, seq) USING (marker)) WHERE nth = 1""")
def identity_markers(spark, d):
    markers = spark.createDataFrame([("blog", "journal", 1), ("en", "english", 2), ("example", "sample", 3)], "marker string, product string, seq int")
    p = paths(spark, d)
    found = R.deepest_marker(p.select("path").distinct(), markers)
    return p.join(found, "path").select("page_id", "marker", "product")


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%tin%' THEN 'Tin' WHEN lower(p_type) LIKE '%steel%' THEN 'Steel' WHEN lower(p_type) LIKE '%e%' THEN 'E' END AS label FROM part")
def marker_families(spark, d):
    markers = spark.createDataFrame([(1, "tin", "Tin"), (2, "steel", "Steel"), (3, "e", "E")], "seq int, marker string, label string")
    return R.marker_of(t(spark, d, "part"), markers, "p_partkey", "p_type")



@query("""SELECT p_partkey AS asset_id, CASE k WHEN 'adapter' THEN 'adapter' WHEN 'paper' THEN 'paper' WHEN 'checkpoint' THEN CASE p_partkey % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'segmentation' WHEN 2 THEN 'speech' ELSE 'checkpoint' END
ELSE CASE p_partkey % 5 WHEN 0 THEN 'detection_dataset' WHEN 1 THEN 'segmentation_dataset' WHEN 2 THEN 'malware_dataset' WHEN 3 THEN 'tracking_dataset' ELSE 'other_dataset' END END AS category
FROM (SELECT *, ['adapter', 'paper', 'checkpoint', 'dataset'][p_size % 4 + 1] AS k FROM part)""")
def taxonomy_categories(spark, d):
    from shelfmark.operators.taxonomy import classified

    choose = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    profiles = t(spark, d, "part").select(
        F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), choose(("adapter", "paper", "checkpoint", "dataset"), F.col("p_size")).alias("kind"),
        choose(("llm", "segmentation", "speech_recognition", None), F.col("p_partkey")).alias("model_type"), choose(("coco", "ade20k", "malware", "mot", None), F.col("p_partkey")).alias("dataset_format"),
    )
    profiles = profiles.withColumn("dataset_format", F.when(F.col("kind") == "dataset", F.col("dataset_format")))
    return classified(profiles).select("asset_id", "category")


@query(f"""SELECT v.ord, v.id AS category, count(p.p_partkey) AS n_assets FROM (SELECT * FROM (VALUES (200, 'detection_dataset'), (210, 'segmentation_dataset'), (240, 'video_dataset')) x(ord, id)) v
LEFT JOIN part p ON v.id = ['detection_dataset', 'segmentation_dataset', 'other_dataset'][CAST(p.p_partkey % 3 AS INTEGER) + 1] GROUP BY 1, 2""")
def taxonomy_order(spark, d):
    """Counts of chosen categories in the vocabulary's order; the vocabulary has 52 rows and is broadcast."""
    from shelfmark.operators.taxonomy import resolve, vocabulary

    named = F.element_at(F.array(F.lit("detection_dataset"), F.lit("segmentation_dataset"), F.lit("other_dataset")), (F.col("p_partkey") % 3 + 1).cast("int"))
    counts = t(spark, d, "part").groupBy(named.alias("id")).count()
    chosen = [c for s in ("detection-datasets", "segmentation_dataset", "videos") for c in resolve(s)]
    return F.broadcast(vocabulary(spark)).where(F.col("id").isin(chosen)).join(counts, "id", "left").select("ord", F.col("id").alias("category"), F.coalesce("count", F.lit(0)).alias("n_assets"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) >= 5),
reps AS (SELECT min(doc_id) AS id, s FROM sets GROUP BY s), l AS (SELECT id, len(s) AS n, unnest(s) AS item FROM reps),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS n_a, b.n AS n_b, count(*) AS k FROM l a JOIN l b ON a.item = b.item AND a.id < b.id GROUP BY ALL)
SELECT left_id, right_id, round(k / (n_a + n_b - k), 4) AS similarity FROM p WHERE k / (n_a + n_b - k) >= 0.8""")
def near_duplicate_sets(spark, d):
    """Pairs of documents whose sets of five-word runs are alike; documents of fewer words have none."""
    return D.similar_runs(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 5, 0.8)


def word_runs(spark, d) -> DataFrame:
    """(id, s): the hashes of each document's runs of five words, sorted; made in its row, so that no text is shuffled."""
    return D.run_sets(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 5)


@query(r"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), r AS (SELECT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS item FROM w WHERE len(w) >= 5),
s AS (SELECT id, list_sort(list_distinct(list(item))) AS s FROM r GROUP BY 1) SELECT id, min(id) OVER (PARTITION BY s) AS rep FROM s""")
def near_duplicate_members(spark, d):
    """Which document stands for each in the pairs of near_duplicate_sets."""
    return D.members(word_runs(spark, d))


@query(r"""SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: starts_with(w, 'th'))) > 0 AND len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: starts_with(w, 'an'))) > 0""")
def fulltext_match(spark, d):
    return S.match_all(t(spark, d, "documents"), "text", "doc_id", ["th", "an"])


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), i AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM i GROUP BY 1),
m AS (SELECT count(*) AS n, avg(len) AS mean FROM l), h AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM i WHERE term IN ('the', 'und', 'idiot'))
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN l USING (doc_id), m GROUP BY 1""")
def fulltext_rank(spark, d):
    return S.bm25(t(spark, d, "documents"), "text", "doc_id", ["the", "und", "idiot"])


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), i AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS len FROM i GROUP BY 1),
m AS (SELECT count(*) AS n, avg(len) AS mean FROM l), h AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM i WHERE term IN ('und', 'der', 'idiot'))
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN l USING (doc_id), m GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 25""")
def fulltext_top(spark, d):
    """The 25 best documents from a stored index, which is made here first."""
    place = new_place(spark, "index")
    textindex.build(t(spark, d, "documents"), "text", "doc_id", place)
    return textindex.ranked(spark, place, ["und", "der", "idiot"], 25).rows.withColumnRenamed("key", "doc_id")


@query("""SELECT doc_id, times, CASE WHEN n >= 1125899906842624 THEN printf('%.1f', n / 1125899906842624) || ' PiB' WHEN n >= 1099511627776 THEN printf('%.1f', n / 1099511627776) || ' TiB' WHEN n >= 1073741824 THEN printf('%.1f', n / 1073741824) || ' GiB'
WHEN n >= 1048576 THEN printf('%.1f', n / 1048576) || ' MiB' WHEN n >= 1024 THEN printf('%.1f', n / 1024) || ' KiB' ELSE n || ' B' END AS shown, CAST(n_chars * 1000 AS BIGINT) AS parsed
FROM (SELECT doc_id, n_chars, times, n_chars * times AS n FROM documents, (SELECT unnest([1, 512, 1048576, 1073741824, 549755813888]) AS times))""")
def sizes_shown(spark, d):
    """Sizes of documents, and of up to half a tebi of each, in every unit."""
    docs = t(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 512, 1048576, 1073741824, 549755813888)])).alias("times"))
    return docs.select("doc_id", "times", format_bytes(F.col("n_chars") * F.col("times")).alias("shown"), parse_size(F.concat(F.col("n_chars").cast("string"), F.lit(" kB"))).cast("long").alias("parsed"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def known_passages(spark, d):
    return S.passages(t(spark, d, "documents"), "doc_id", "text", t(spark, d, "benchmark"), "item_id", "text")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, us, us AS first, 0::BIGINT AS batch FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.n, e.us, CASE WHEN e.us - r.us >= 7200000000 OR e.us - r.first >= 21600000000 THEN e.us ELSE r.first END, r.batch + CASE WHEN e.us - r.us >= 7200000000 OR e.us - r.first >= 21600000000 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, batch, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM r GROUP BY 1, 2""")
def debounce_capped(spark, d):
    return W.capped_sessions(t(spark, d, "events"), "user_id", 7200, 21600)

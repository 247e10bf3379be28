"""Registered queries of streams, of identity, of the boundaries of assets and of installations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import boundary
from shelfmark.operators import identity as I
from shelfmark.operators import installations, pages
from shelfmark.operators.collapse import collapsed_tree
from shelfmark.operators.recognise import ASKED_FOLDERS, archive_kind, detected, directory_profiles
from shelfmark.plans.catalogue import ABOVE, PATHS, paths, query, t
from shelfmark.sources.places import new_place
from shelfmark.streaming import debounce


@query("""WITH RECURSIVE e AS (SELECT event_type AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, n, us, us AS first, 0::BIGINT AS batch FROM e WHERE n = 1 UNION ALL
SELECT e.key, e.n, e.us, CASE WHEN e.us - r.us >= 1800000000 OR e.us - r.first >= 7200000000 THEN e.us ELSE r.first END, r.batch + CASE WHEN e.us - r.us >= 1800000000 OR e.us - r.first >= 7200000000 THEN 1 ELSE 0 END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1),
u AS (SELECT key, n AS m, us, (SELECT user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) x WHERE x.event_type = r.key AND x.k = r.n) AS user_id, batch FROM r)
SELECT key, batch, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events, count(DISTINCT user_id) AS n_paths FROM u GROUP BY 1, 2""")
def debounce_stream(spark, d):
    """The event table replayed as a stream, in three parts and a last one that flushes: pending sets and timers, over restarts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", debounce.PROVIDER)
    place = new_place(spark, "replayed")
    events = t(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.lit("modified").alias("kind"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3

    def run():
        stream = spark.readStream.schema(events.schema).parquet(f"{place}/in")  # what has come since the last run, as one micro-batch
        rows = debounce.debounced(stream, 1800, 7200, "1 hour")
        rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()

    for i in range(3):
        part = events.where((F.col("ts") >= first + i * third) & ((F.col("ts") < first + (i + 1) * third) | F.lit(i == 2)))
        part.write.mode("append").parquet(f"{place}/in")
        run()
    events.select("key").distinct().select("key", F.lit("").alias("path"), F.lit(last).alias("ts"), F.lit("flush").alias("kind")).coalesce(1).write.mode("append").parquet(f"{place}/in")
    run()
    return debounce.batches_of(spark.read.parquet(f"{place}/out"))


#: Markers of the hosts and folders of pages, as tables of vendors and components.
HOSTS = ((("ththre", "ththan", "spam-farm"), "Farm", "Spam", "farm"), (("blog",), "Journal", None, "journal"), (("fr", "es"), "Langue", "Roman", "roman"), (("examplenet", "example"), "Sample", None, "sample"))
TOPICS = ((("tion", "therin"), "Notions", "N"), (("ther", "www"), "Others", "O"), (("m.th",), "Mobile", "M"))


def _values(entries) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({seq}, '{m}', {', '.join(map(text, values))})" for seq, (markers, *values) in enumerate(entries) for m in markers)


@query(rf"""WITH p AS (SELECT page_id, string_split(path, '/') AS parts FROM {PATHS}), s AS (SELECT page_id, unnest(range(len(list_filter(parts, lambda x: x <> '')))) AS pos, len(list_filter(parts, lambda x: x <> '')) AS n, unnest(list_filter(parts, lambda x: x <> '')) AS shown FROM p),
l AS (SELECT page_id, pos, n, lower(shown) AS part, regexp_replace(lower(shown), '[^a-z0-9]+', '', 'g') AS squashed FROM s),
v AS (SELECT * FROM (VALUES {_values(HOSTS)}) x(seq, marker, vendor, product, source)), c AS (SELECT * FROM (VALUES {_values(TOPICS)}) x(seq, marker, component, task)),
h AS (SELECT l.page_id, pos, v.*, row_number() OVER (PARTITION BY page_id ORDER BY regexp_matches(part, '^[a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9.-]*$'), pos DESC, seq) AS nth FROM l JOIN v
ON part = marker OR list_contains(string_split_regex(part, '[^a-z0-9]+'), marker) OR length(marker) >= 6 AND (contains(part, marker) OR contains(squashed, regexp_replace(marker, '[^a-z0-9]+', '', 'g')))),
b AS (SELECT * FROM h WHERE nth = 1), k AS (SELECT l.page_id, c.component, c.task, row_number() OVER (PARTITION BY l.page_id ORDER BY l.pos DESC, c.seq) AS nth FROM l LEFT JOIN b USING (page_id) JOIN c
ON l.pos >= coalesce(b.pos, greatest(l.n - 4, 0)) AND (contains(l.part, c.marker) OR contains(l.squashed, regexp_replace(c.marker, '[^a-z0-9]+', '', 'g'))))
SELECT p.page_id, b.vendor, b.product, k.component, k.task, coalesce(b.source, 'unknown') AS source FROM p LEFT JOIN b USING (page_id) LEFT JOIN (SELECT * FROM k WHERE nth = 1) k USING (page_id)""")
def identity_of_paths(spark, d):
    """Vendor, product, source, and the component that the table knows, of page paths."""
    found = I.identified(paths(spark, d).withColumn("name", F.lit("0")), "page_id", vendors=HOSTS, components=TOPICS)
    return found.select("page_id", "vendor", "product", F.when(F.col("task").isNotNull(), F.col("component")).alias("component"), "task", "source")


@query(rf"""WITH a AS (SELECT DISTINCT above AS dir FROM {ABOVE}), p AS (SELECT dir, regexp_replace(dir, '/?[^/]*$', '') AS parent, lower(string_split(dir, '/')[-1]) AS own FROM a),
k AS (SELECT parent AS dir, list(own) AS dirs FROM p WHERE parent <> '' GROUP BY 1), n AS (SELECT array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') AS dir, list(lower(string_split(path, '/')[-1])) AS names FROM {PATHS} GROUP BY 1),
b AS (SELECT p.parent AS dir, count(*) AS branching FROM p JOIN k ON k.dir = p.dir GROUP BY 1),
f AS (SELECT p.dir, p.own, coalesce(k.dirs, []) AS dirs, coalesce(n.names, []) AS names, coalesce(b.branching, 0) AS branching FROM p LEFT JOIN k USING (dir) LEFT JOIN n USING (dir) LEFT JOIN b USING (dir)),
r AS (SELECT dir, branching, CASE WHEN len(list_filter(string_split(lower(dir), '/'), lambda x: x = 'de' OR contains(x, 'spam') OR contains(x, 'blog.th'))) > 0 THEN 'application state'
WHEN len(list_filter(names, lambda x: x IN ('index.html', '404.html', '25') OR ends_with(x, '7.html'))) > 0 THEN NULL WHEN own IN ('en', 'es') THEN 'container' WHEN branching >= 2 THEN 'structured children' END AS refused FROM f)
SELECT dir, branching, refused, refused IS NULL AS may_claim FROM r""")
def boundary_guard(spark, d):
    """Which folders of page paths generic detectors may claim, under rules made for them; files that end in 7.html stand for data."""
    files = paths(spark, d).select(F.regexp_replace("path", r"7\.html$", "7.html.npz").alias("path"), F.lit(1).cast("long").alias("size_bytes"))
    rows = boundary.guarded(directory_profiles(files), ("en", "es"), ("de",), ("spam", "blog.th"), ("index.html", "404.html", "25"))
    return rows.select("dir", "branching", "refused", "may_claim")


@query("""WITH f AS (SELECT l_orderkey AS asset_id, lower(l_returnflag || l_linestatus) AS file, CAST(floor(l_quantity) AS BIGINT) % 4 AS bytes, row_number() OVER (PARTITION BY l_orderkey ORDER BY lower(l_returnflag || l_linestatus), CAST(floor(l_quantity) AS BIGINT) % 4) AS nth, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
s AS (SELECT asset_id, any_value(n) AS n, string_agg(file || ':' || bytes, '|' ORDER BY file, bytes) AS shape FROM f WHERE nth <= 64 GROUP BY 1), a AS (SELECT o_orderkey AS asset_id, CAST(floor(o_totalprice) AS BIGINT) % 3 + 300000 AS size_bytes, o_orderstatus AS application, o_orderpriority AS name FROM orders WHERE o_totalprice >= 1000)
SELECT sha256(size_bytes || '|' || n || '|' || shape) AS signature, false AS verified, count(*) AS install_count, max(size_bytes) AS unit_bytes, max(size_bytes) * (count(*) - 1) AS reclaimable_bytes, array_to_string(list_sort(list_distinct(list(application))), ';') AS sources, arg_min(name, (-length(name), name)) AS name, min(asset_id) AS keeper
FROM a JOIN s USING (asset_id) GROUP BY size_bytes, n, shape HAVING count(*) > 1 AND count(DISTINCT application) > 1""")
def installations_by_shape(spark, d):
    """Orders as assets, line items as their files: those that look alike and belong to different applications."""
    number = F.col("o_totalprice").cast("bigint")
    assets = t(spark, d, "orders").where("o_totalprice >= 1000").select(F.col("o_orderkey").alias("asset_id"), (number % 3 + 300000).alias("size_bytes"), F.col("o_orderstatus").alias("application"), F.col("o_orderpriority").alias("name"), F.lit(False).alias("is_missing"))
    files = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.concat(F.lit("d/"), "l_returnflag", "l_linestatus").alias("relpath"), (F.col("l_quantity").cast("bigint") % 4).alias("size_bytes"), F.lit(None).cast("string").alias("sha256"))
    return installations.duplicate_installations(assets, files, across_applications=True).withColumn("sources", F.array_join("sources", ";"))


@query("""WITH RECURSIVE x AS (SELECT p_partkey AS id, [p_brand, CASE WHEN p_size % 5 <> 0 THEN 's' || p_size END, p_type, nullif(CAST(p_partkey % 7 AS VARCHAR), '0')] AS said, CAST(floor(p_retailprice) AS BIGINT) AS size FROM part),
c AS (SELECT id, size, list_filter(list_transform([1, 2, 3, 4], lambda i: {'at': i, 'label': said[i]}), lambda y: y.label IS NOT NULL) AS chain FROM x),
e AS (SELECT id, size, chain, chain[1:0] AS node, 0 AS n FROM c UNION ALL SELECT id, size, chain, chain[1:n + 1], n + 1 FROM e WHERE n < len(chain)),
g AS (SELECT node, any_value(n) AS n, count(*) AS n_assets, CAST(sum(size) AS BIGINT) AS total_bytes FROM e GROUP BY node), k AS (SELECT * FROM g WHERE n = 0 OR node[n].at <= 2 OR n_assets > 1),
own AS (SELECT e.id, any_value(e.size) AS size, max(k.n) AS n, count(*) AS depth FROM e JOIN k ON e.node = k.node GROUP BY e.id),
u AS (SELECT k.node, max(a.n) AS above, count(*) AS depth FROM k JOIN k a ON a.n < k.n AND a.node = k.node[1:a.n] GROUP BY k.node)
SELECT array_to_string(list_transform(k.node, lambda y: y.label), '/') AS path, CASE WHEN k.n > 0 THEN array_to_string(list_transform(k.node[1:u.above], lambda y: y.label), '/') END AS parent, coalesce(u.depth, 0) AS depth,
CASE WHEN k.n = 0 THEN 'root' ELSE ['p_brand', 'measure', 'p_type', 'rest'][k.node[k.n].at] END AS level, CASE WHEN k.n > 0 THEN k.node[k.n].label END AS label, n_assets, total_bytes FROM k LEFT JOIN u ON u.node = k.node
UNION ALL SELECT concat_ws('/', nullif(array_to_string(list_transform(c.chain[1:own.n], lambda y: y.label), '/'), ''), own.id), array_to_string(list_transform(c.chain[1:own.n], lambda y: y.label), '/'), own.depth, 'asset', CAST(own.id AS VARCHAR), 1, own.size FROM own JOIN c ON c.id = own.id""")
def inventory_tree_collapsed(spark, d):
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), "p_brand", F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("measure"), "p_type", F.nullif((F.col("p_partkey") % 7).cast("string"), F.lit("0")).alias("rest"), F.floor("p_retailprice").cast("bigint").alias("size_bytes"))
    return collapsed_tree(parts, ["p_brand", "measure", "p_type", "rest"]).drop("asset_id")


@query("SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 40 OFFSET 120")
def listing_page(spark, d):
    """The fourth page of documents by size, from a listing that is written in ranges first."""
    place = new_place(spark, "listing")
    docs = t(spark, d, "documents").select("doc_id", "n_chars", "source")
    pages.write_listing(docs, place, "n_chars", "doc_id", range_rows=100)
    return spark.createDataFrame(pages.page_at(spark, place, 120, 40, "n_chars", "doc_id").rows, docs.schema)


#: What a line item stands for in an archive and in a folder, by a number that its keys make.
MEMBERS = (
    "w/model.bin", "config.json", "tokenizer.json", "images/1.jpg", "images/2.jpg", "labels/1.txt", "a.csv", "b.csv", "c.tsv", "cap.pcap", "x.evtx", "y.evtx", "src/a.py", "setup.py", "readme.md", "notes.txt",
)
FILES = (
    "config.json", "model.safetensors", "adapter_config.json", "data.yaml", "notes.txt", "events.out.tfevents.1", "hparams.yaml", "task.json", "annotations.xml", "model_index.json", "saved_model.pb", "readme.md", "a.wav", "b.wav", "weights.onnx", "x.zip",
)
NUMBER = "(l_orderkey * 7 + l_linenumber * 3 + l_partkey * 5) % 16"


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH m AS (SELECT l_orderkey AS archive, {_listed(MEMBERS)}[{NUMBER} + 1] AS name FROM lineitem), e AS (SELECT archive, name, regexp_extract(name, '[.]([a-z]+)$', 1) AS ext FROM m),
c AS (SELECT archive, count(*) AS n, count_if(ext = 'bin') AS weights, count_if(name = 'config.json') AS declared, count_if(name = 'tokenizer.json') AS companions, count_if(ext = 'jpg') AS images, count_if(starts_with(name, 'labels/')) AS labels,
count_if(ext = 'pcap') AS captures, count_if(ext = 'evtx') AS events, count_if(ext = 'py') AS sources, count_if(name = 'setup.py') AS project, count_if(ext IN ('csv', 'tsv')) AS tables FROM e GROUP BY 1),
k AS (SELECT archive, n, CASE WHEN weights > 0 AND declared + companions > 0 THEN 'model_archive' WHEN images > 0 AND labels > 0 THEN 'yolo_dataset_archive' WHEN captures > 0 THEN 'network_dataset_archive' WHEN events >= 2 THEN 'host_log_dataset_archive'
WHEN sources >= 5 AND project > 0 THEN 'code_archive' WHEN tables >= 3 THEN 'tabular_dataset_archive' ELSE 'archive' END AS kind, declared, companions FROM c)
SELECT archive, kind, CASE kind WHEN 'model_archive' THEN CASE WHEN declared > 0 AND companions > 0 THEN 0.95 ELSE 0.85 END WHEN 'yolo_dataset_archive' THEN 0.8 WHEN 'network_dataset_archive' THEN 0.9 WHEN 'host_log_dataset_archive' THEN 0.85
WHEN 'code_archive' THEN 0.7 WHEN 'tabular_dataset_archive' THEN 0.65 ELSE 0.4 END::DOUBLE AS confidence, n AS members_listed FROM k""")
def archive_kinds_by_content(spark, d):
    """Orders as archives whose members follow from their line items: what the counts of members make of each."""
    members = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.element_at(F.array(*[F.lit(m) for m in MEMBERS]), F.expr(f"CAST({NUMBER} AS INT) + 1")).alias("name"), F.lit(1).cast("long").alias("size"))
    return archive_kind(members).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"""WITH f AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'r/runs/version_' ELSE 'r/set/o' END || l_orderkey AS path, {_listed(FILES)}[{NUMBER} + 1] AS name FROM lineitem),
n AS (SELECT path, list_distinct(list(name)) AS names FROM f GROUP BY 1), h AS (SELECT path, names, CASE WHEN list_contains(names, 'model_index.json') THEN 'diffusers' WHEN list_contains(names, 'adapter_config.json') THEN 'peft_adapter'
WHEN list_contains(names, 'config.json') AND (list_contains(names, 'model.safetensors') OR list_contains(names, 'weights.onnx')) THEN 'hf_repo' WHEN list_contains(names, 'events.out.tfevents.1') THEN 'tensorboard'
WHEN starts_with(path, 'r/runs/') AND list_contains(names, 'hparams.yaml') THEN 'lightning' WHEN list_contains(names, 'task.json') AND list_contains(names, 'annotations.xml') THEN 'cvat' WHEN list_contains(names, 'data.yaml') AND list_contains(names, 'notes.txt') THEN 'yolo_dataset'
WHEN list_contains(names, 'saved_model.pb') THEN 'tensorflow_savedmodel' WHEN list_contains(names, 'model.safetensors') OR list_contains(names, 'weights.onnx') THEN 'loose_weights' WHEN list_contains(names, 'x.zip') THEN 'archive' END AS detector FROM n)
SELECT path, detector FROM h WHERE detector IS NOT NULL""")
def folder_detectors_by_content(spark, d):
    """Orders as folders whose files follow from their line items: the detector that their names call for."""
    folder = F.concat(F.when(F.col("l_orderkey") % 3 == 0, "r/runs/version_").otherwise("r/set/o"), F.col("l_orderkey").cast("string"))
    rows = t(spark, d, "lineitem").select("l_orderkey", F.expr(f"CAST({NUMBER} AS INT) + 1").alias("number")).distinct()
    files = rows.select(F.concat(folder, F.lit("/"), F.element_at(F.array(*[F.lit(m) for m in FILES]), F.col("number"))).alias("path"), F.lit(10).cast("long").alias("size_bytes"))
    return detected(directory_profiles(files, ASKED_FOLDERS)).where("path like 'r/%/%'").select("path", "detector")

"""Operators that SQL can't express against plain re-computations, and the stages against what they promise."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ann, bpe, dartminhash, huffman, mixing, queries, secretscan, topk, toxicity, urlfilter

PROSE = "the house is old and we walk to the market every day for bread while rain falls on quiet streets".split()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.word_bpe_path())


@pytest.fixture(scope="module")
def documents(spark, tiny):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}


def test_token_file_and_bpe_queries(spark, tiny, documents, library):
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in documents.items()}
    packed = lambda x: np.array(x, "<u4").tobytes()
    start, wanted = 0, {}
    for i in sorted(ids):
        own = [*ids[i], 1]
        wanted[i] = (start, len(own), zlib.crc32(packed(own)))
        start += len(own)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op1_huffman_token_file"](spark, tiny).collect()} == wanted
    sha = lambda b: hashlib.sha256(b).hexdigest()
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op3_pair_index_bpe"](spark, tiny).collect()}
    assert found == {i: (len(x), sha(packed(x)), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}


def test_empty_tables(spark, tiny):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    path = bpe.word_bpe_path()
    from shelfmark.llm.common import new_path

    place = new_path(spark, "empty")
    huffman.write_ids(none, path, place)
    assert huffman.read_ids(spark, place).count() == 0
    assert bpe.digests(none, path).count() == 0
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    assert toxicity.scored(none, toxicity.trained(none, labels)).count() == 0
    assert secretscan.scanned(none, secretscan.trained(none)).count() == 0


def plain_model(urls):
    """log P of the symbol after two others, by Witten-Bell smoothing, from lists of symbols."""
    tri, seen = Counter(), defaultdict(set)
    counts = [Counter(), Counter(), Counter()]
    n = urlfilter.SYMBOLS
    for s in urls:
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            for order, context in enumerate(((), (b,), (a, b))):
                counts[order][context] += 1
                seen[context].add(c)
                tri[context, c] += 1

    def p(a, b, c):
        out = 1.0 / n
        for order, context in enumerate(((), (b,), (a, b))):
            total, kinds = counts[order][context], len(seen[context])
            if total >= (1 if order == 0 else urlfilter.LEAST_CONTEXT):
                out = (tri[context, c] + kinds * out) / (total + kinds)
        return math.log(out)

    return p


def test_url_scores_and_verdicts(spark):
    rng = random.Random(8)
    hosts = ["a.net", "x.org", "b.example.com", "news.example.net", "c.info", "shop.biz"]
    urls = [f"http{rng.choice(('', 's'))}://{rng.choice(hosts)}/{rng.choice(('fr', 'de', 'en', 'x'))}/{''.join(rng.choices('abcxyz019-', k=rng.randint(1, 12)))}{rng.choice(('', '?q=1', '#top'))}" for _ in range(300)]
    urls += ["http://c.info/" + "é" * 3, "no scheme", "", "http://" + "z" * 20_000 + ".info/", urls[0], urls[0]]
    frame = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(len(urls), None, "x", "x")], "page_id long, url string, host string, score string")
    rows = {r["page_id"]: r for r in urlfilter.judged(frame).collect()}
    assert len(rows) == len(urls) + 1

    def split(url):
        if not url or "://" not in url:
            return "", "", url or ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), re.split(r"[?#]", rest[len(host):])[0], rest

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    def symbols(rest):
        lowered = rest.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        return [urlfilter.BEGIN] * 2 + [urlfilter.ALPHABET.index(c) if c in urlfilter.ALPHABET else urlfilter.OTHER for c in lowered] + [urlfilter.END]

    made = []
    for u in [*urls, None]:
        host, path, rest = split(u)
        made.append((host, path, *rule(host, path), symbols(rest), zlib.crc32((u or "").encode()) % urlfilter.CALIBRATION_PARTS == 0))
    models = {v: plain_model([m[4] for m in made if m[3] == v and not m[5]]) for v in ("allow", "block")}
    scores = []
    for m in made:
        grams = list(zip(m[4], m[4][1:], m[4][2:], strict=False))
        scores.append(sum(models["allow"](*g) - models["block"](*g) for g in grams) / len(grams))
    for i, (host, path, name, verdict, _, _) in enumerate(made):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, name)
        assert abs(rows[i]["score"] - scores[i]) < 1e-9
        assert verdict is None or rows[i]["verdict"] == verdict
    free = [(scores[i], rows[i]["verdict"]) for i, m in enumerate(made) if m[3] is None]
    assert min([s for s, v in free if v == "allow"], default=math.inf) > max([s for s, v in free if v == "block"], default=-math.inf)
    held = [(s, m[3]) for s, m in zip(scores, made, strict=True) if m[3] and m[5]]
    wrong = sum((("allow" if s >= 0 else "block") != v) for s, v in held) / len(held)
    assert wrong < 0.2


def test_lexicon_hits_against_plain_matching():
    lexicon = toxicity.Lexicon({" scum ": 2.0, " idio": 1.5, " idiot ": 2.5, " rat": 1.2}, [" lab rat ", " rat pack "], (-3.0, 1.0, 0.5)).build()
    rng = random.Random(4)
    words = ["scum", "idiot", "idiotic", "rat", "lab", "pack", "rather", "the", "house"]
    for _ in range(300):
        text = toxicity.folded(" ".join(rng.choices(words, k=rng.randint(0, 12))))
        wanted = {}
        for at in [m.start() for m in re.finditer(r" (?=\S)", text)]:
            weights = [w for e, w in lexicon.weights.items() if text.startswith(e, at)]
            if weights:
                wanted[at] = max(weights)
        for phrase in lexicon.exceptions:
            for m in re.finditer(f"(?={re.escape(phrase)})", text):
                wanted = {b: w for b, w in wanted.items() if not m.start() <= b < m.start() + len(phrase) - 1}
        assert lexicon.hits(text) == wanted
    assert lexicon.score(toxicity.folded("1d10t")) > lexicon.score(toxicity.folded("house " * 50 + "idiot")) > lexicon.score(" ")


def test_toxicity_is_found_in_held_out_rows(spark, tiny):
    small = tiny.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op4_lexicon_toxicity"](spark, small).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    false = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean(caught) >= 0.6 and np.mean(false) <= 0.05


def plain_spans(text):
    found = []
    i = 0
    while i < len(text):  # assign: leftmost, non-overlapping
        m = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)").match(text, i)
        if m:
            found += [("assign", i, m.end())] if len(m[1]) >= 6 else []
            i = m.end()
        else:
            i += 1
    for kind, first, letters, least in (("access", "AKIA", string.ascii_uppercase + string.digits, 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            j = i + len(first)
            if text.startswith(first, i) and text[j : j + 1] and text[j] in letters:
                while j < len(text) and text[j] in letters:
                    j += 1
                found += [(kind, i, j)] if j - i >= least else []
                i = j
            else:
                i += 1
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def test_secrets_query(spark, tiny, documents):
    for r in queries.QUERIES["op6_crf_secrets"](spark, tiny).collect():
        wanted = plain_spans(documents[r["doc_id"]])
        text = ",".join(f"{k}:{i}:{j}" for k, i, j in wanted)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, _, _ in wanted) for kind in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert [s for s in spans if s[0] != "crf"] == [(k, str(i), str(j)) for k, i, j in wanted]


def test_field_finds_secrets_without_a_pattern(spark, tiny):
    field = secretscan.trained(spark.read.parquet(f"{tiny}/documents.parquet"))
    rng = random.Random(77)
    some = lambda letters, k: "".join(rng.choices(letters, k=k))
    alnum = string.ascii_letters + string.digits
    secrets = (
        lambda: ["use", "github_pat_" + some(alnum, 30)], lambda: ["Bearer", "eyJhbGciOiJIUzI1NiJ9." + some(alnum, 30) + "." + some(alnum, 27)], lambda: [f"postgresql://admin:{some(alnum, 12)}@db.internal:5432/app"], lambda: [f"pwd={some(alnum + '!$', 14)}"],
        lambda: ["glpat-" + some(alnum, 20)], lambda: ["the", "key", "is", some(alnum, 32) + "7aB"],
    )
    harmless = (
        lambda: ["see", f"https://www.example.org/{some(string.ascii_lowercase, 8)}/2024/index.html"], lambda: ["at", "10:30"], lambda: ["version", "2.14.3"], lambda: ["call", "+49-30-1234567"], lambda: ["id", "3f2504e0-4f89-41d3-9a0c-0305e82c3301"],
        lambda: ["mail", "jane.doe42@example.com"], lambda: ["GetUserName()"], lambda: ["room", "B-17"], lambda: ["author:", "Smith"], lambda: ["/var/log/syslog.1"],
    )
    hits = false = 0
    for n in range(240):
        put = (secrets[n % len(secrets)] if n % 2 else harmless[n // 2 % len(harmless)])()
        before = " ".join(rng.choices(PROSE, k=20))
        text = f"{before} {' '.join(put)} {' '.join(rng.choices(PROSE, k=20))}"
        _, spans = secretscan.all_spans(text, field)
        secret = put[-1]
        at = text.index(secret)
        hits += n % 2 and any(i <= at + 4 and j >= at + len(secret) - 4 for _, i, j in spans)
        false += n % 2 == 0 and bool(spans)
    assert hits >= 0.8 * 120 and hits / (hits + false) >= 0.8


def test_field_likelihood_and_gradient_against_all_paths():
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 2 ** len(secretscan.TRAITS), (4, 4))
    tags, mask = np.array([[0, 1, 2, 2], [2, 2, 0, 1], [2, 0, 2, 2], [2, 2, 2, 0]]), np.ones((4, 4))
    args = (bits, tags, mask, np.array([0, 1, 2, 5]), np.ones(4))

    def likelihood(field):
        total, start = 0.0, np.array([0.0, secretscan.FORBIDDEN, 0.0])
        e = field.emissions(bits, np.array([0, 1, 2, 5]))
        for w in range(4):
            def score(path, w=w):
                return start[path[0]] + sum(e[w, i, t] for i, t in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False))
            every = [score((a, b, c, d)) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
            total += score(tuple(tags[w])) - np.logaddexp.reduce(every)
        return total / 4

    values = [likelihood(secretscan.fitted(*args, rounds=r, rate=0.02)) for r in (1, 10, 40)]
    assert values[0] < values[1] < values[2] < 0


def test_top_k_in_tiles_and_shards(spark):
    import duckdb

    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 6))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(50, x[3].tolist(), 2)] * 40 + [(100, x[100].tolist(), 3)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding").toArrow())
    wanted = sorted(con.execute(topk.SQL).fetchall())
    for query_bytes, shard_bytes in ((1 << 20, 1 << 20), (300, 4000), (1, 1 << 20)):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_bytes, shard_bytes).collect())) == wanted


def test_nearest_asks_a_repeated_query_with_its_least_vector(spark):
    df = spark.createDataFrame([(0, [5.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [5.0, 1.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(3, 0.5), (1, 1.0)]


def test_near_duplicate_stage_tells_rows_apart(spark, tiny):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (2, near), (3, c), (None, c), (None, None), (4, ""), (5, ""), (3, c)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string").coalesce(1)
    kept = [(r["doc_id"], r["text"]) for r in dartminhash.near_duplicate_stage(spark, docs, tiny).collect()]
    assert Counter(kept) == Counter([(1, a), (1, b), (3, c), (None, None), (4, ""), (5, "")])
    # texts of one id are one document to the operator
    classes = Counter((r["doc_id"], r["class_id"]) for r in dartminhash.near_duplicates(docs.where("doc_id is not null").withColumn("doc_id", F.when(F.col("text") == near, 9).otherwise(F.col("doc_id")))).collect())
    assert classes == Counter([(1, 1), (1, 1), (9, 1), (3, 3), (3, 3), (4, 4), (5, 5)])


def test_measured_pairs_grow_with_the_group(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    measured, counts = dartminhash.measured, []

    def counting(pairs, sets):
        counts[-1] += pairs.count()
        return measured(pairs, sets)

    monkeypatch.setattr(dartminhash, "measured", counting)
    for n in (150, 300, 600):
        rows = []
        for i in range(n):
            words = list(base)
            for at in rng.sample(range(120), 3):
                words[at] = f"x{i}-{at}"
            rows.append((i, " ".join(words)))
        counts.append(0)
        found = dict(dartminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        sets = [set(" ".join(t.split()[k : k + 5]) for k in range(116)) for _, t in rows]
        links = [(a, b) for a in range(n) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        assert sum(found[a] == found[b] for a, b in links) >= 0.9 * len(links)
        assert len(set(found.values())) >= n - len(links)
    assert counts[1] <= 2.3 * counts[0] and counts[2] <= 2.3 * counts[1]


def test_mix_properties(spark):
    rows = [(i, "w " * (1 + i * 7919 % 23), f"s{i % 4}") for i in range(4000)] + [(4000, "w " * 900, "s9"), (4001, None, "s9"), (4002, "", None), (4003, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed(docs).toPandas()
    total = found["size"].sum()
    per = found.groupby(found["source"].fillna("~")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert abs(per["target"].sum() - total) < 1e-6 * total and (per["target"] <= 3 * per["size"] + 1e-6).all()
    assert (abs(per["taken"] - per["target"]) <= 2 * per["largest"] + 1).all() and (found["taken"] <= 3 * found["size"]).all()
    weights = dict(zip(sorted(set(per.index) - {"~"}) + ["~"], [5, 2, 1, 5, 2, 1], strict=True))
    level = {s: per["target"][s] / weights[s] for s in per.index if per["target"][s] < 3 * per["size"][s] - 1e-6}
    assert max(level.values()) - min(level.values()) < 1e-6 * total
    assert mixing.mixed(docs.repartition(7)).toPandas().set_index("doc_id")["taken"].sort_index().equals(found.set_index("doc_id")["taken"].sort_index())


def test_stages_keep_what_they_promise(spark, tiny):
    import corpus_pipeline

    text = " ".join(PROSE)
    rows = [(1, text, "s1", 5, 1, "a"), (1, text, "s1", 5, 1, "a"), (2, "say password=abcdef123 now " + " ".join(PROSE[::-1]), None, 6, 2, "b"), (3, None, "s1", 7, 3, "c"), (4, "", None, None, 4, "d"), (5, "long " * 20_000, "s2", 1, 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, times int, rid string").coalesce(1)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(stages["toxicity"](spark, docs, tiny)) == [1, 1, 2, 3, 4, 5]
    assert ids(stages["minhash_near_dedup"](spark, docs, tiny)) == [1, 2, 3, 4, 5]
    masked = {r["doc_id"]: r for r in stages["secret_scan"](spark, docs, tiny).collect()}
    assert masked[2]["text"].startswith("say [secret] now") and masked[2]["n_chars"] == len(masked[2]["text"]) and masked[1]["n_chars"] == 5 and masked[3]["text"] is None
    mix = stages["source_mixing"](spark, docs, tiny)
    assert mix.columns == docs.columns and set(ids(mix)) <= {1, 2, 5} and max(Counter(ids(mix)).values()) <= 6
    encoded = {r["doc_id"]: r["n_tokens"] for r in stages["bpe_encoding"](spark, docs, tiny).collect()}
    assert encoded[3] == encoded[4] == 0 and encoded[5] > 10_000


def test_narrowed_keeps_every_wanted_row(spark, monkeypatch):
    rows = spark.range(-20_000, 20_000).selectExpr("id as doc_id", "cast(id as string) as text").unionAll(spark.createDataFrame([(None, "x")], "doc_id bigint, text string"))
    wanted = spark.range(-20_000, 20_000, 40).selectExpr("id as doc_id")
    kept = {r.doc_id for r in dartminhash.narrowed(rows, wanted).collect()}
    assert {r.doc_id for r in wanted.collect()} <= kept and len(kept) < 1_100
    assert dartminhash.narrowed(rows, wanted.limit(0)).isEmpty()
    monkeypatch.setattr(dartminhash, "MAP_BITS", 64)  # a full map keeps everything
    assert {r.doc_id for r in dartminhash.narrowed(rows, wanted).collect()} >= set(range(-20_000, 20_000))


def test_nearest_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(240)]
    rows += [(0, rng.normal(size=4).tolist()), (500, [1.0]), (600, [2.0]), (100, [0.5])]  # an id with two lengths, and a short length
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in {i for i, _ in rows if i % 100 == 0}:
        best = defaultdict(lambda: math.inf)
        for own in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q and len(v) == len(own):
                    best[i] = min(best[i], float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())))
        wanted = sorted((d, i) for i, d in best.items())[:5]
        mine = sorted(found.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(wanted)
        hits, total = hits + len({i for _, i, _ in mine} & {i for _, i in wanted}), total + len(wanted)
    assert hits >= 0.9 * total

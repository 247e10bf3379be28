import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ann, bpe, dartminhash, hmm, huffman, mixing, queries, secretscan, topk, toxicity, urlfilter
from shelfmark.llm.common import new_path

ODD = ["", None, " \t\n ", "one", "the cat sat on the mat and the dog", "the cat sat on the mat and the dog", "Ünï Σίσυφος İ é <|endoftext|>x don't 12 ½", "a\x1cb　c", "x" * 5000, "word " * 3000, "😀 ́x ʼn"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), "x", 1.0) for i, t in enumerate(ODD)] + [(4, ODD[4], "en", "s1", 34, "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, ids double")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.word_bpe_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_huffman_codes():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (7, 2), (5000, 900)):
        ids = rng.zipf(1.2, n).astype(np.int64) % k
        lengths = huffman.code_lengths(np.bincount(ids, minlength=k), 12)
        assert lengths.max() <= 12 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
        code = huffman.Huffman(lengths)
        assert (code.decode(code.encode(ids)) == ids).all()
    # a limit above the optimum's longest code costs nothing
    counts = np.array([1, 1, 2, 3, 5, 8, 13])
    assert (counts * huffman.code_lengths(counts, 20)).sum() == 78


def test_token_file_round_trip(spark, docs, library):
    path = new_path(spark, "test")
    huffman.write_ids(docs, bpe.word_bpe_path(), path)
    rows = huffman.read_ids(spark, path).orderBy("start").collect()
    wanted = sorted((r["doc_id"], ids_of(library, r["text"]) + [1]) for r in docs.collect())
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows] == wanted
    assert [r["start"] for r in rows] == np.cumsum([0, *(len(i) for _, i in wanted)])[:-1].tolist()


def test_bpe_matches_the_library(spark, docs, library):
    path = bpe.word_bpe_path()
    tokens = bpe.encoded(docs, path)
    found = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokens.collect())
    assert found == sorted((r["doc_id"], ids_of(library, r["text"])) for r in docs.collect())
    texts = {r["doc_id"]: r["text"] for r in bpe.decoded(tokens, path).collect()}
    assert texts == {i: library.decode(x, skip_special_tokens=False) for i, x in found}
    assert bpe.digests(docs, path).count() == docs.count()


def test_url_rules(spark):
    urls = ["http://A.Net/x", "https://x.example.net/en/1?q#f", "http://example.com/de/", "ftp://notexample.com/de/1", "http://a.org/fr/", "http://net", "no scheme", None, "http://Ä.net/É"]
    rows = {r["page_id"]: r for r in urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(rows[i]["host"], rows[i]["path"], rows[i]["rule"]) for i in range(9)] == [
        ("a.net", "/x", "net/"), ("x.example.net", "/en/1", "example.net/en/"), ("example.com", "/de/", "example.com/de/"), ("notexample.com", "/de/1", None), ("a.org", "/fr/", "org/fr/"),
        ("net", "", None), ("", "", None), ("", "", None), ("Ä.net", "/É", "net/"),
    ]
    assert all(r["verdict"] in ("allow", "block") for r in rows.values())
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_separates(spark):
    urls = [f"http://good{i}.org/fr/page{i}" for i in range(40)] + [f"http://zzqx{i}.net/xqz/{i}" for i in range(40)] + ["http://good.com/fr/page", "http://zzqx.com/xqz/9"]
    rows = {r["page_id"]: r for r in urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert (rows[80]["verdict"], rows[81]["verdict"]) == ("allow", "block")


def test_toxicity(spark, docs):
    assert toxicity.folded("1D10T ѕtupіd! ÏDIOT ｉｄｉｏｔ") == " idiot stupid idiot idiot "
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghik"), 6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 60).tolist() + (["mo7on", "scum"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.trained(table, table.select("doc_id", "toxic"))
    found = {r["doc_id"]: r for r in toxicity.scored(table, lexicon).collect()}
    assert np.mean([found[i]["predicted"] == t for i, _, t in rows]) > 0.97
    assert {i for i in found if found[i]["held_out"]} == {i for i in found if zlib.crc32(str(i).encode()) % 4 == 2}
    odd = toxicity.scored(docs, lexicon).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    none = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}


def vectors(spark, n=300, d=8):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d))
    x[50:90] = x[50]  # equal vectors
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1001, [None] * d, ""), (1002, [float("nan")] * d, ""), (1003, [float("inf")] + [0.0] * (d - 1), ""), (1004, [1.0], ""), (None, [0.0] * d, "")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def test_exact_top_k(spark):
    x, df = vectors(spark)
    for query_bytes in (1 << 20, 200):  # one batch, several batches
        found = {}
        for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_bytes).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        q = np.floor(256 * x).astype(np.int64)
        for i in range(0, 300, 50):
            s = q @ q[i]
            order = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
            assert found[i] == [(j, s[j]) for j in order]
    big = spark.createDataFrame([(0, [1e10]), (1, [1e10]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(big, F.col("vec_id") == 0, 5).orderBy("rank").first()["score"] == 2**63 - 1
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_top_k_of_repeated_ids(spark):
    import duckdb

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, (x[i] * f).tolist()) for i in (0, 50, 200) for f in (1.01, 1.02, 1.03)] + [(100, x[100].tolist())] * 9 + [(7, x[7].tolist())] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    wanted = con.execute(topk.SQL).fetchall()
    assert sorted(map(tuple, topk.top_k(df.coalesce(1), F.col("vec_id") % 50 == 0).collect())) == sorted(wanted)
    # rows of one id each but for the queries' own: k others stay of equal vectors
    ids = np.array([100] * 20 + list(range(101, 140)))
    assert ids[topk.first_of_equal(ids, np.ones((len(ids), 3)), 5)].tolist() == [100] * 5 + list(range(101, 106))


def test_nearest_neighbours(spark):
    x, df = vectors(spark, 2000)
    rows = ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    hit = 0
    for i in range(0, 2000, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        wanted = [j for j in np.lexsort((np.arange(2000), d)) if j != i][:10]
        own = [r for r in rows if r["query_id"] == i]
        assert len(own) == 10 and [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in own)
        hit += len({r["vec_id"] for r in own} & set(wanted))
    assert hit >= 0.9 * 200
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_of_repeated_rows(spark):
    often = spark.createDataFrame([(1, [1.0, 2.0])] * 20 + [(i, [1.0, 2.0]) for i in (2, 3)] + [(0, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(often, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2, 3]


def test_secret_patterns():
    text = "password='hunter22' Token: ab, API-key = zzzzzzz api_key=AKIA" + "A" * 16 + " deadbeef" * 3 + " " + "ab12" * 6
    spans = secretscan.base_spans(text)
    assert [(k, text[i:j]) for k, i, j in spans] == [("assign", "password='hunter22"), ("assign", "api_key=AKIA" + "A" * 16), ("access", "AKIA" + "A" * 16), ("hex", "ab12" * 6)]


def test_secret_field(spark, docs):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(i, " ".join([word() for _ in range(40)] + ([f"password={rng.integers(1e12):x}zz9"] if i % 2 else ["12", "3.5"]) + [word() for _ in range(20)])) for i in range(120)]
    field = secretscan.trained(spark.createDataFrame(rows, "doc_id long, text string"))
    assert field.plain_is_outside(0)
    for _ in range(300):  # decoding of stretches against decoding of the whole
        bits = np.where(rng.random(60) < 0.08, rng.integers(1, 2 ** len(secretscan.TRAITS), 60), 0)
        path = field._decoded(bits, 0, 0, 60)
        assert field.tags(bits, 0) == path
    found = secretscan.scanned(docs, field).collect()
    assert len(found) == docs.count()
    assert {r["base_sha256"] for r in found if r["spans"] == ""} == {hashlib.sha256(b"").hexdigest()}
    assert secretscan.masked("say password=abcdef123 now", field) == "say [secret] now"


def test_secret_beyond_a_pattern():
    class Whole:
        def tags(self, bits, file_bits):
            return {1: secretscan.BEGIN}

    text = "say password=abcdef$ghi123 now"
    base, spans = secretscan.all_spans(text, Whole())
    assert [text[i:j] for _, i, j in base] == ["password=abcdef"] and ("crf", 4, 26) in spans
    assert secretscan.masked(text, Whole()) == "say [secret] now"
    base, spans = secretscan.all_spans("say password=abcdef123 now", Whole())
    assert base == spans and len(base) == 1


def test_darts_estimate_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    other = np.concatenate([base[40:], rng.integers(0, 2**63, 40).astype(np.uint64)])
    weight = np.ones(400)
    same = [(s[0] == s[1]).mean() for s in (dartminhash.Darts(180, seed).signatures(np.concatenate([base, other]), np.repeat([0, 1], 200), weight, 2) for seed in range(20))]
    assert abs(np.mean(same) - 160 / 240) < 0.03


def test_near_duplicates_against_brute_force(spark, docs, tiny):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    found = dict(dartminhash.near_duplicates(table).select("doc_id", "class_id").collect())
    sets = [set(s.tolist()) for s, _ in dartminhash.shingles_of(pa.array([r["text"] for r in rows]))]
    parent = {r["doc_id"]: r["doc_id"] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                x, y = root(rows[a]["doc_id"]), root(rows[b]["doc_id"])
                parent[max(x, y)] = min(x, y)
    assert found == {i: root(i) for i in parent}
    odd = dartminhash.near_duplicates(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in odd) == Counter([(i, 4 if i == 5 else i) for i in range(len(ODD))] + [(4, 4), (None, None)])
    assert dartminhash.near_duplicates(docs.limit(0)).count() == 0


def test_chains_of_copies_form_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join([f"n{i}" if i < k else w for i, w in enumerate(words)]) for k in range(0, 400, 8)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r["class_id"] for r in dartminhash.near_duplicates(df).collect()} == {0}


def test_repeats_of_a_text_are_its_near_copies(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 300)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join([t] * 64)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert dict(dartminhash.near_duplicates(df).collect()) == {i: i % 100 for i in [*range(40), *range(100, 140)]}


def test_hmm(spark, docs, tiny):
    for table in (docs, spark.read.parquet(f"{tiny}/documents.parquet")):
        texts = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), None]) for r in table.collect()]
        counts = Counter(w for i, ws in texts if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
        n, v = sum(counts.values()), len(counts)
        found = hmm.scored(table).collect()
        base = Counter((i, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for i, ws in texts)
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in found) == base
        assert {r["train_tokens"] for r in found} == {n} and all(np.isfinite(r["score"]) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hmm.scored(docs.limit(0)).count() == 0


def test_forward_recursion_against_all_paths():
    rng = np.random.default_rng(5)
    s = hmm.STATES
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    chain = hmm.Chain(norm(rng.random(s), 0), norm(rng.random(s), 0), norm(rng.random((s, s)), 1), norm(rng.random((6, s)), 0))
    flat, begin, length = np.array([0, 3, 5, 1, 2]), np.array([0, 3]), np.array([3, 2])
    total = sum(chain.start[a] * chain.emit[0, a] * chain.move[a, b] * chain.emit[3, b] * chain.move[b, c] * chain.emit[5, c] for a in range(s) for b in range(s) for c in range(s))
    assert abs(chain.log10_likelihood(flat, begin, length)[0] - math.log10(total)) < 1e-12
    start, resume, move, emit, _ = chain.expected(flat, begin, length, np.array([True, False]))
    assert abs(emit.sum() - 5) < 1e-9 and abs(move.sum() - 3) < 1e-9 and abs(start.sum() + resume.sum() - 2) < 1e-9


def test_mixing(spark, docs):
    import duckdb

    for table in (docs.dropDuplicates(["doc_id"]), spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"))):
        found = mixing.mixed(table).toPandas()
        con = duckdb.connect()
        con.register("documents", table.select("doc_id", "text", "source").toPandas())
        wanted = con.execute(mixing.SQL).df().set_index("doc_id")
        got = found.set_index("doc_id")
        assert (got["taken"].sort_index() == wanted["taken"].sort_index()).all() and (abs(got["target"].sort_index() - wanted["target"].sort_index()) < 1e-6).all()
        assert (found["taken"] <= 3 * found["size"]).all() and found["taken"].sum() <= found["size"].sum()
    assert mixing.mixed(docs).count() == docs.count() and mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert corpus_pipeline.run(spark, tiny).columns == ["doc_id", "ids", "n_tokens"]
    kept = dartminhash.near_duplicate_stage(spark, docs.unionByName(docs), tiny)
    classes = dict(dartminhash.near_duplicates(docs).select("doc_id", "class_id").collect())
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(classes.values()))


def test_stages_on_odd_rows(spark, docs, tiny):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tiny)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        wanted = {r["doc_id"] for r in docs.where("text is not null").collect()} - {0, 2}
        # no text here is toxic; equal ones are one, empty ones take no words of a mix
        assert ids == {"toxicity": set(range(11)), "minhash_near_dedup": ids & set(range(11)), "secret_scan": set(range(11)), "source_mixing": ids & wanted, "bpe_encoding": set(range(11))}[name], name
        assert len(ids) >= {"minhash_near_dedup": 10, "source_mixing": 5}.get(name, 11) and stage(spark, docs.limit(0), tiny).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)] and set(queries.ORACLES) < set(queries.QUERIES)

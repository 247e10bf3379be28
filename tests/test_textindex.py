"""The stored text index against BM25 over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark import library
from shelfmark.operators import search, textindex


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "Alphabet", "beta", "gamma", "delta", "été", "x1"] + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, weights=[40, 5, 20, 2, 8, 3, 3] + [1] * 200, k=rng.randint(1, 60)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "--- !"), (1003, "alpha"), (1004, "alpha"), (1005, "gamma " * 400)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.fixture(scope="module")
def place(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "ix")
    textindex.build(docs, "text", "id", path, 20)
    return path


@pytest.mark.parametrize(("terms", "k"), [(["alpha"], 5), (["gamma", "été"], 7), (["Beta", "delta", "x1"], 1), (["alpha", "nosuch"], 1000), (["nosuch"], 3), ([], 3)])
def test_equal_to_all_rows(spark, docs, place, terms, k):
    found = textindex.ranked(spark, place, terms, k)
    wanted = search.bm25(docs, "text", "id", [t.lower() for t in terms]).orderBy(F.desc("score"), "id").limit(k).collect() if terms else []
    assert [tuple(r) for r in found.rows.collect()] == [tuple(r) for r in wanted]


def test_fewer_blocks_are_read(spark, place):
    found = textindex.ranked(spark, place, ["alpha"], 5)
    assert found.blocks > 20 and found.blocks_read < found.blocks / 2


def test_words_are_shuffled_once(spark, tmp_path):
    """What a build moves follows the text, and a block's postings are made where its documents are."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 400)))) for i in range(1500)]
    texts, core = spark.createDataFrame(rows, "id long, text string").repartition(4).localCheckpoint(), spark.sparkContext._jsc.sc()

    def moved():
        core.listenerBus().waitUntilEmpty()
        return core.statusStore().executorSummary("driver").totalShuffleWrite()

    before = moved()
    textindex.build(texts, "text", "id", str(tmp_path / "ix"), 50)
    assert moved() - before < 1.2 * sum(len(t) for _, t in rows)
    postings = spark.read.parquet(str(tmp_path / "ix" / "postings")).withColumn("file", F.input_file_name())
    assert postings.groupBy("block").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0 and postings.select("block").distinct().count() >= 30
    assert postings.select(F.sum(F.aggregate("held.tf", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] == sum(len(t.split()) for _, t in rows)


def test_a_text_without_key_counts_but_is_not_found(spark, tmp_path):
    texts = spark.createDataFrame([(1, "alpha beta"), (None, "alpha alpha"), (2, "gamma beta beta")], "id long, text string")
    textindex.build(texts, "text", "id", str(tmp_path / "ix"))
    wanted = search.bm25(texts, "text", "id", ["alpha"]).where("id is not null").collect()
    assert [tuple(r) for r in textindex.ranked(spark, str(tmp_path / "ix"), ["alpha"], 5).rows.collect()] == [tuple(r) for r in wanted]


def test_prefixes_all_terms_and_restricted_keys(spark, docs, place):
    both = {r["id"] for r in search.match_all(docs, "text", "id", ["alph", "gam"]).collect()}
    found = textindex.ranked(spark, place, ["alph", "gam"], 10_000, prefixes=True, every=True).rows.collect()
    assert {r["key"] for r in found} == both and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    top = textindex.ranked(spark, place, ["alph", "gam"], 3, prefixes=True, every=True).rows.collect()
    assert top == found[:3]
    even = docs.where("id % 2 = 0").select("id")
    assert textindex.ranked(spark, place, ["alph", "gam"], 4, prefixes=True, every=True, allowed=even).rows.collect() == [r for r in found if r["key"] % 2 == 0][:4]


def test_search_ranks_the_catalogue(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "cat")
    for name, card in (("bert-large", "bert bert"), ("roberta", "A bert cousin that is described at some length in its own card, with many words of prose"), ("llama", "nothing of the kind is said here at all, not a word")):
        (root / name).mkdir(parents=True)
        (root / name / "config.json").write_text('{"model_type": "%s"}' % ("llama" if name == "llama" else "bert"))
        (root / name / "model.safetensors").write_bytes(b"x" * 1000)
        (root / name / "README.md").write_text(f"---\nlicense: mit\n---\n{card} and so on, long enough to be taken for a paragraph\n")
    library.scan(spark, [str(root)], out)
    names = lambda *a, **k: [r["name"] for r in library.search(spark, out, *a, **k).collect()]
    assert names("bert")[0] == "bert-large" and set(names("bert")) == {"bert-large", "roberta"}
    assert names("bert", limit=1, offset=1) == names("bert")[1:2] and names("ber", sort="name") == ["bert-large", "roberta"]
    assert names("bert kind:dataset") == [] and names("cousin") == ["roberta"] and names("nosuchword kind:model") == [] and len(names("")) == 3
    (root / "llama" / "README.md").write_text("---\nlicense: mit\n---\nNow it speaks of a bert too, in a sentence that is long enough\n")
    library.rescan(spark, out, [str(root / "llama")])
    assert set(names("bert")) == {"bert-large", "roberta", "llama"}  # a new scan, a new index

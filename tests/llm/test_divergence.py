"""The vocabulary audit against a plain re-computation, and against its SQL on the tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from shelfmark.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, least, most_terms):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for _, lang, source, text, _ in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]}
            parts["term"] = [(t, own[s][t] - whole[t]) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked[: most_terms if part == "term" else None], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["Alpha", "beta", "ALPHA", "été", "ÉTÉ", "naïve", "straße", "x", "日本", "zeta", "İ", "omega-3", "it's", "tail", "a1b"]
    found = [(i, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S2", None, "é", "z" * 40]), rng.choice([" ", "\n", "--", "\x7f"]).join(rng.choices(words[: rng.randint(3, 15)], k=rng.randint(1, 30))), "clash") for i in range(120)]
    found += [(200, "en", "s1", None, "x"), (201, "xx", "lone", "", "x"), (202, "xx", "other", "123 !?", "x"), (203, "yy", "single", "beta", "x"), (204, "en", "long", "alpha beta " * 40_000, "x")]
    return found + found[:7]  # repeated rows count again


SCHEMA = "doc_id long, lang string, source string, text string, term string"


def collected(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("most_bytes", "tile"), [(4_000_000, 128), (40, 2)])
def test_audit(spark, rows, monkeypatch, most_bytes, tile):
    # few bytes an automaton: several passes; few sources a tile and terms a block: pairs across tiles
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 4 if tile == 2 else 256)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert collected(divergence.audited(docs, 5, 4, most_bytes)) == brute_force(rows, 5, 4)


def test_nothing_kept(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert collected(divergence.audited(docs, 10_000)) == brute_force(rows, 10_000, 50)
    assert divergence.audited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = 7_000_000_000_003, 900_000_000_000_000_001
    frame = spark.createDataFrame([(n, total, 12)], "n long, t long, v long")
    assert frame.select(divergence.share(frame["n"], frame["t"], frame["v"])).first()[0] == 1 + 1_000_000_000 * (n + 5) // (total + 60)


def test_query_equals_its_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    assert collected(queries.QUERIES["op11_source_divergence"](spark, tiny)) == sorted(con.execute(queries.ORACLES["op11_source_divergence"]).fetchall())

"""The prefix trie against a plain re-computation, and against its SQL on the tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from shelfmark.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute_force(rows):
    turns = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    whole = {c: own.get(base(c), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + own[c][h:] for c in own}
    members = defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] = sum(leaves[k] for k in children[prefix]) or 1
        saved[prefix] = sum(saved[k] for k in children[prefix]) + ((len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0)
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()),
        key=lambda r: r[:2],
    )


def collected(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    said = ["yes", "no", "", None, "maybe 😀", "long " * 50]
    found = [(c, t, rng.choice(["user", "bot", None]), rng.choice(said), "x") for c in [*range(90, 130), *range(200, 215), 350, -5, -100, 8192, 8300] for t in range(rng.randint(1, 7))]
    found += [(300, t, "user", f"{t % 2}", "x") for t in range(40)] + [(301, t, "user", f"{t % 2}", "x") for t in range(43)]
    found += [(c, t, "user", "same", "x") for c in range(400, 460) for t in range(3)]  # copies
    found += [(110, 2, "user", "tie", "x"), (110, 2, "bot", "tie", "x"), (110, None, "user", "first", "x"), (110, None, "user", "first", "x"), (None, 1, "user", "gone", "x")]
    return found


@pytest.mark.parametrize("segment", [65_536, 3])
def test_trie(spark, rows, monkeypatch, segment):
    # short segments and many ranges: conversations run over several of both
    monkeypatch.setattr(prefixtrie, "SEGMENT", segment)
    monkeypatch.setattr(prefixtrie, "LISTED_BITS", 13 if segment > 3 else 2)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert collected(prefixtrie.conversation_trie(frame.repartition(5))) == brute_force(rows)


def test_places_over_many_ranges(spark):
    frame = spark.createDataFrame([(7, t, "r", str(t), "") for t in range(2000)] + [(8, t, "r", "", "") for t in range(9)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the ranges are joined
    try:
        found = prefixtrie.placed(frame.orderBy("text"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r[0] for r in found.where("conv_id = 7").select("place").orderBy("place").collect()] == list(range(1, 2001))
    assert found.where("conv_id = 8").count() == 9


def test_turnless_conversations_and_empty_tables(spark):
    # 101 to 103 have one turn; where h is 1 or more nothing is left of it, and their block's first is absent
    rows = [(c, 0, "user", "hello", "x") for c in range(101, 112)]
    assert collected(prefixtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)
    assert prefixtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_its_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tiny}/conversations.parquet'")
    wanted = sorted(con.execute(queries.ORACLES["op13_prefix_trie"]).fetchall(), key=lambda r: r[:2])
    assert collected(queries.QUERIES["op13_prefix_trie"](spark, tiny)) == wanted

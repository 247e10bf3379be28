"""The trie of conversation prefixes, with counts rolled up to all ancestors by pointer jumping.

A prefix is keyed by a digest: the exclusive or of one digest a turn, each of
its place, role and text. Exclusive or is associative, so the prefixes of a
long conversation are summed in segments, and a parent's key is a node's own
without its last turn. Nodes are the distinct keys, edges join keys.

Sums over subtrees take rounds that double their reach: in round k each node
of depth 2^k or more hands what its subtree holds within 2^k levels to its
ancestor 2^k levels up, and then points to that one's own pointer. So the
number of rounds is the logarithm of the depth, and later ones hold deep nodes
only. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import dropped, table, written

#: Turns of a conversation that are numbered and summed in one group.
SEGMENT = 65_536

#: Width, as a power of two, of the ranges of ids that are listed in one string.
LISTED_BITS = 13

#: Conversations that share a start, and the number of starts' lengths: 0 to 5 turns.
BLOCK, STARTS = 100, 6

NODE = ("depth", "a", "b")


def _number(hexadecimal: Column, begin: int) -> Column:
    """60 bits of a digest in hexadecimal, so that they fit a positive long."""
    return F.conv(F.substring(hexadecimal, begin, 15), 16, 10).cast("bigint")


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, place, t, u, n_chars), written: each turn's place in its conversation from 1, a digest of role and text, the text's code points.

    Turns are ordered by turn (null first), then by the digest. Rows are dealt
    by range, so that a conversation of any length spreads over tasks: places
    are counted within a range, and what earlier ranges hold of the same
    conversation, of which there is one a range at most, is added.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("n_chars"))
    rows = rows.withColumns({"t": _number(F.col("digest"), 1), "u": _number(F.col("digest"), 16), "rid": F.monotonically_increasing_id()}).drop("digest")
    order = [F.col("turn").asc_nulls_first(), "t", "u", "rid"]
    ranged = written(rows.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "ranged")
    per_range = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = per_range.select("conv_id", "range", F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    numbered = ranged.withColumn("place", place.cast("bigint"))
    # a conversation is continued in as many ranges as there are, less one, at most
    numbered = numbered.join(F.broadcast(before.where("before > 0")), ["conv_id", "range"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    out = written(numbered.select("conv_id", "place", "t", "u", "n_chars"), "placed")
    dropped(ranged)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose start is that of their block's first: (conv_id, size, depth, t, u, n_chars) a turn, and (conv_id, size) each.

    Conversation c begins with the first h turns of c - c % BLOCK (all if
    fewer, none if absent), h being crc32 of c as text modulo STARTS, and goes
    on with its own turns after its first h.
    """
    rows = placed(turns)
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % STARTS, "base": F.col("conv_id") - F.col("conv_id") % BLOCK})
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "n", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    # long conversations meet their facts in segments
    facts = convs.select("conv_id", "h", "m", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"n div {SEGMENT}"))).alias("segment"))
    own = rows.withColumn("segment", F.expr(f"place div {SEGMENT}")).join(facts, ["conv_id", "segment"]).where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("m"))
    starts = rows.where((F.col("place") < STARTS) & (F.col("conv_id") % BLOCK == 0)).withColumnsRenamed({"conv_id": "base", "place": "depth"})
    shared = starts.join(convs.select("conv_id", "base", "m", "size"), "base").where("depth <= m")
    columns = ["conv_id", "size", "depth", "t", "u", "n_chars"]
    return own.select(*columns).unionByName(shared.select(*columns)), convs.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns(conv_id, size, depth, t, u, n_chars) with the digest (a, b) of the prefix that ends there, and its parent's (up_a, up_b); written."""
    own = {"x": F.xxhash64(F.lit(1), "depth", "t", "u"), "y": F.xxhash64(F.lit(2), "u", "t", "depth")}
    rows = turns.withColumns(own).withColumn("segment", F.expr(f"(depth - 1) div {SEGMENT}"))
    inside = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.bit_xor("x").over(inside), "b": F.bit_xor("y").over(inside)}).drop("t", "u")
    rows = written(rows, "segments")
    totals = rows.where((F.col("depth") % SEGMENT == 0) & (F.col("size") > F.col("depth"))).select("conv_id", F.col("segment") + 1, "a", "b").toDF("conv_id", "segment", "a", "b")
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select("conv_id", "segment", F.bit_xor("a").over(earlier).alias("ahead_a"), F.bit_xor("b").over(earlier).alias("ahead_b"))
    later = rows.where("segment > 0").join(totals, ["conv_id", "segment"])
    later = later.withColumns({"a": F.col("a").bitwiseXOR(F.col("ahead_a")), "b": F.col("b").bitwiseXOR(F.col("ahead_b"))}).drop("ahead_a", "ahead_b")
    rows = rows.where("segment = 0").unionByName(later)
    return rows.select("conv_id", "size", "depth", "n_chars", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of ends(conv_id, depth, a, b): SHA-256 of each node's ids in ascending order, comma-joined.

    Ids of a range are listed in one string, of 2^LISTED_BITS ids at most; a
    node's strings stream through one digest, so that no group is held whole.
    """
    listed = ends.groupBy(*NODE, F.shiftright("conv_id", LISTED_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        names, key, digest = [*NODE, "ends_sha256"], None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if node != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names)

    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids").mapInArrow(run, "depth bigint, a bigint, b bigint, ends_sha256 string")


def rolled_up(edges: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(conv_id, depth) with the sums of ``values`` over each node's subtree, itself included.

    edges(conv_id, depth, up, *values): a node is told by its conversation and
    depth, its parent by the conversation ``up`` and the depth less one; roots
    have depth 0.
    """
    own = edges.select("conv_id", "depth", *values)
    deepest, reach = edges.agg(F.max("depth")).first()[0] or 0, 1
    active, sums, old = edges.where("depth >= 1").select("conv_id", "depth", "up", *values), own, []
    while reach <= deepest:
        sent = written(active.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(*[F.sum(v).alias(v) for v in values]), "sent")
        sums = sums.unionByName(sent)
        if 2 * reach <= deepest:
            received = sent.withColumnsRenamed({v: f"more_{v}" for v in values})
            onward = active.select(F.col("conv_id").alias("up"), (F.col("depth") + reach).alias("depth"), F.col("up").alias("next"))
            rows = active.where(F.col("depth") >= 2 * reach).join(received, ["conv_id", "depth"], "left").join(onward, ["up", "depth"])
            active = written(rows.select("conv_id", "depth", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), "active")
            dropped(*old)
            old = [active]
        reach *= 2
    return sums.groupBy("conv_id", "depth").agg(*[F.sum(v).alias(v) for v in values])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of the trie of turns(conv_id, size, depth, t, u, n_chars); convs(conv_id, size) holds turnless conversations too.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), conv_id being the least member. No
    conversations, no nodes.
    """
    rows = written(prefixes(turns), "prefixes")
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.max("n_chars").alias("n_chars"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", none.alias("up_a"), none.alias("up_b"), zero.alias("n_chars")))
    nodes = written(nodes, "nodes")
    turnless = convs.where("size = 0").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    ends = end_digests(rows.where("depth = size").select("conv_id", *NODE).unionByName(turnless))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, list(NODE), "left").join(ends, list(NODE), "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("up"))
    known = known.join(parents, ["depth", "up_a", "up_b"], "left")
    edges = written(
        known.select(
            "conv_id", "depth", "up", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.isnull("n_children").cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ),
        "edges",
    )
    dropped(rows, nodes)
    values = ("n_leaves", "saved_tokens")
    facts = edges.drop(*values).withColumnRenamed("up", "parent_conv_id")
    return facts.join(rolled_up(edges.select("conv_id", "depth", "up", *values), values), ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of conversations(conv_id, turn, role, text).

    Null roles and texts count as empty; rows without conv_id take no part;
    rows of one turn number are ordered by a digest of role and text, repeated
    rows stand each; texts and conversations may have any length; further
    columns take no part; an empty table has no nodes, not even a root.
    """
    return trie(*rebuilt(conversations))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


SQL = """
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations
), sizes AS (
  SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s, conv_id - conv_id % 100 AS base FROM conversations GROUP BY conv_id
), hashed AS (
  SELECT *, CAST(xor(list_reduce(list_concat([4294967295], list_transform(range(0, 8 * length(s)), lambda i: (ascii(s[i // 8 + 1]) >> (i % 8)) & 1)),
                                 lambda c, bit: xor(c >> 1, CASE WHEN (c & 1) <> bit THEN 3988292384 ELSE 0 END)), 4294967295) AS BIGINT) % 6 AS h
  FROM (SELECT conv_id, n, s, base FROM sizes)
), rebuilt AS (
  SELECT c.conv_id, p.place AS depth, p.role, p.text FROM hashed c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL
  SELECT c.conv_id, p.place - c.h + least(c.h, coalesce(b.n, 0)), p.role, p.text
  FROM hashed c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h LEFT JOIN sizes b ON b.conv_id = c.base
), prefixed AS (
  SELECT conv_id, depth, text, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', '' FROM sizes
), members AS (
  SELECT conv_id AS member, depth, prefix, text, min(conv_id) OVER (PARTITION BY depth, prefix) AS conv_id, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixed
), nodes AS (
  SELECT conv_id, depth, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS saving,
         sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(member AS VARCHAR) END, ',' ORDER BY member), '')) AS ends_sha256
  FROM members GROUP BY conv_id, depth
), edges AS (
  SELECT n.*, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.member = n.conv_id AND m.depth = n.depth - 1
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM edges WHERE depth > 0 GROUP BY parent_conv_id, depth
), valued AS (
  SELECT e.*, coalesce(c.n_children, 0) AS n_children FROM edges e LEFT JOIN children c ON c.conv_id = e.conv_id AND c.depth = e.depth
), sums AS (
  SELECT m.conv_id, m.depth, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saving) AS saved_tokens
  FROM valued v JOIN members m ON m.member = v.conv_id AND m.depth <= v.depth GROUP BY m.conv_id, m.depth
)
SELECT CAST(v.conv_id AS BIGINT) AS conv_id, CAST(v.depth AS BIGINT) AS depth, CAST(v.parent_conv_id AS BIGINT) AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs,
       CAST(v.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.conv_id = v.conv_id AND s.depth = v.depth
"""

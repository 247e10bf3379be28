"""Audit of how the sources of a language differ in their vocabulary, in two passes over the texts.

The first pass counts in how many documents of its language each term occurs;
frequent terms are kept. The second pass counts the occurrences of kept terms
with an Aho-Corasick automaton over delimiter-padded terms: as every delimiter
is one space and automata report matches that overlap, neighbouring terms may
share theirs. Both yield sparse postings (term, source, count). Shares of
terms, in whole billionths, come from these; pairs of sources are compared in
blocks of terms, so that no task sees more than two tiles of sources over one
block.
"""

from __future__ import annotations

import uuid
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.chunks import blocks
from shelfmark.llm.common import dropped, table, written

#: Documents of its language that a kept term occurs in, at least.
LEAST_DOCUMENTS = 30

#: Added to each count, and what a share is counted in.
SMOOTHING, SCALE = 5, 1_000_000_000

#: Ranks of the part ``term``.
MOST_TERMS = 50

#: Bytes of terms in one automaton; larger vocabularies are searched in several passes.
AUTOMATON_BYTES = 4_000_000

#: Bytes of text whose words are coded together, and that an automaton runs over at a time.
WIDE_BYTES, SEARCHED_BYTES = 8_000_000, 4_000_000

#: Counts that a task holds before it hands them on.
COUNTS_HELD = 4_000_000

#: Terms of a block, and sources of a tile, about.
BLOCK_TERMS, TILE_SOURCES = 256, 128

#: For each byte: a space for ASCII other than letters, else the byte with A-Z in lower case.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """The texts as bytes with each delimiter a space and A-Z in lower case; null texts are empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    octets = bytes(data).translate(FOLDED) if data is not None else b""
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(octets)], 0, texts.offset)


def grouped(docs: DataFrame) -> DataFrame:
    """(lang, source, text) with nulls as empty strings."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n_docs) of docs(lang, text); each block of texts counts for itself, so a frequent term is no hot key."""

    def run(batches):
        for batch in batches:
            for i, j in blocks(batch.column("text"), WIDE_BYTES):
                split = pc.ascii_split_whitespace(folded(batch.column("text").slice(i, j - i)))
                coded = split.flatten().dictionary_encode()
                terms, codes = coded.dictionary, np.asarray(coded.indices, np.int64)
                if not len(terms):
                    continue
                langs = batch.column("lang").slice(i, j - i).dictionary_encode()
                sizes, k = np.asarray(split.value_lengths(), np.int64), len(terms)
                once = np.unique(np.repeat(np.arange(j - i), sizes) * k + codes)
                pairs, n = np.unique(np.asarray(langs.indices, np.int64)[once // k] * k + once % k, return_counts=True)
                real = np.asarray(pc.not_equal(terms, ""))[pairs % k]
                pairs, n = pairs[real], n[real]
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(pairs // k)), terms.cast(pa.string()).take(pa.array(pairs % k)), pa.array(n)], ["lang", "term", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n_docs"))


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(term_id, lang, term, n_docs) of the terms in at least ``least`` documents of their language, written once so that ids stay."""
    kept = document_frequencies(docs).where(F.col("n_docs") >= least)
    return written(kept.select(F.monotonically_increasing_id().alias("term_id"), "lang", "term", "n_docs"), "vocabulary")


_automata: dict[tuple[str, str], tuple] = {}


def automaton_of(key: str, lang: str, terms: list[str]) -> tuple:
    """(automaton, number of terms) of one shard's terms of a language, kept in this Python process while the shard is searched."""
    if (key, lang) not in _automata:
        import ahocorasick

        for old in [k for k in _automata if k[0] != key]:
            del _automata[old]
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(f" {term.encode().decode('latin-1')} ", i)
        made.make_automaton()
        _automata[key, lang] = (made, len(terms))
    return _automata[key, lang]


def _recounted(docs: DataFrame, shard: list) -> DataFrame:
    """(term_id, source, n) of the terms of one shard: rows (term_id, lang, term)."""
    by_lang: dict[str, tuple[list[int], list[str]]] = {}
    for r in shard:
        ids, terms = by_lang.setdefault(r["lang"], ([], []))
        ids.append(r["term_id"])
        terms.append(r["term"])
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches):
        held: dict[tuple[str, str], np.ndarray] = {}
        size = 0

        def handed_on():
            for (lang, source), counts in held.items():
                used = np.flatnonzero(counts)
                ids = np.array(shared.value[lang][0], np.int64)[used]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([source] * len(used), pa.string()), pa.array(counts[used])], ["term_id", "source", "n"])

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i, j in blocks(batch.column("text"), SEARCHED_BYTES):
                texts, rows = folded(batch.column("text").slice(i, j - i)).cast(pa.large_binary()).to_pylist(), {}
                for k, text in enumerate(texts, i):
                    if langs[k] in shared.value:
                        rows.setdefault((langs[k], sources[k]), []).append(text)
                for group, found in rows.items():
                    automaton, n = automaton_of(key, group[0], shared.value[group[0]][1])
                    text = (b" " + b" ".join(found) + b" ").decode("latin-1")
                    counts = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=n)
                    if group in held:
                        held[group] += counts
                    else:
                        held[group], size = counts, size + n
                    if size > COUNTS_HELD:
                        yield from handed_on()
                        held, size = {}, 0
        yield from handed_on()

    return docs.mapInArrow(run, "term_id bigint, source string, n bigint")


def postings(docs: DataFrame, kept: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(term_id, source, n) with n > 0, written: occurrences of kept terms in their language's documents of each source.

    The vocabulary is dealt by hash into shards of about ``most_bytes``; each
    has a pass of its own, and what is broadcast stays within that bound.
    """
    total = kept.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    shards, out = -(-total // most_bytes), None
    for s in range(shards):
        own = kept.where(F.pmod(F.xxhash64("term_id"), F.lit(shards)) == s).select("term_id", "lang", "term").collect()
        part = _recounted(docs, own).groupBy("term_id", "source").agg(F.sum("n").alias("n"))
        out = part if out is None else out.unionByName(part)
    return written(out if out is not None else docs.sparkSession.createDataFrame([], "term_id bigint, source string, n bigint"), "postings")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    divisor = wide(total + SMOOTHING * terms)
    scaled = F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTHING)
    return F.when(terms > 0, F.call_function("div", scaled, divisor) + 1)


def _tile_distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| of the pairs of sources of two tiles over one block of terms. Rows of term -1 give a source's share of a term that it lacks."""
    heads = rows[rows["term_id"] < 0].sort_values("source")
    names, tiles, absent = heads["source"].to_numpy(), heads["tile"].to_numpy(), heads["p"].to_numpy(np.int64)
    body = rows[rows["term_id"] >= 0]
    terms, columns = np.unique(body["term_id"].to_numpy(np.int64), return_inverse=True)
    shares = np.repeat(absent[:, None], len(terms), axis=1)
    if len(terms):
        shares[np.searchsorted(names, body["source"].to_numpy()), columns] = body["p"].to_numpy(np.int64)
    first = rows.iloc[0]
    out = []
    for i in range(len(names) - 1):
        others = np.arange(i + 1, len(names))
        if first["low"] != first["high"]:
            others = others[tiles[others] != tiles[i]]
        if len(others):
            out.append((names[i], names[others], np.abs(shares[others] - shares[i]).sum(axis=1), np.abs(absent[others] - absent[i])))
    if not out:
        return pd.DataFrame({"lang": [], "a": [], "b": [], "f": [], "terms": [], "gap": [], "v": []}).astype({"lang": str, "a": str, "b": str})
    a = np.concatenate([np.repeat(x[0], len(x[1])) for x in out])
    b, f, gap = (np.concatenate([x[k] for x in out]) for k in (1, 2, 3))
    return pd.DataFrame({"lang": first["lang"], "a": a, "b": b, "f": f, "terms": len(terms), "gap": gap, "v": first["v"]})


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for any two sources of a language, both ways round.

    shares(lang, source, term_id, p) is sparse; groups(lang, source, v, absent)
    has each source, the number of kept terms of its language and its share of
    a term that it lacks. Terms that both lack differ by the same each.
    """
    sized = groups.groupBy("lang").agg(F.first("v").alias("v"), F.count("*").alias("s"))
    sized = sized.select("lang", "v", F.expr(f"v div {BLOCK_TERMS} + 1").alias("n_blocks"), F.expr(f"(s - 1) div {TILE_SOURCES} + 1").alias("n_tiles"))
    columns = ["lang", "source", "v", "n_tiles", "p", "term_id"]
    heads = groups.drop("v").join(sized, "lang").withColumns({"p": F.coalesce("absent", F.lit(0)), "term_id": F.lit(-1).cast("bigint")})
    heads = heads.select(*columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("block"))
    body = shares.join(sized, "lang").select(*columns, F.pmod(F.xxhash64("term_id"), F.col("n_blocks")).alias("block"))
    tiled = heads.unionByName(body).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("n_tiles")))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tiles") - 1)))
    tiled = tiled.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "n_tiles")
    found = tiled.groupBy("lang", "block", "low", "high").applyInPandas(_tile_distances, "lang string, a string, b string, f bigint, terms bigint, gap bigint, v bigint")
    sums = found.groupBy("lang", "a", "b").agg((F.sum("f") + (F.first("v") - F.sum("terms")) * F.first("gap")).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text).

    Part ``pair`` ranks the other sources of the language by the summed
    differences of shares, all of them; part ``term`` the terms that the source
    uses more than its language, the first ``most_terms``. Null text, language
    and source count as empty strings; a repeated row counts again; ties go by
    item in UTF-8; texts of any length count whole; further columns take no
    part. A language without kept terms has pairs of value 0, a source alone in
    its language no pair, and an empty table no rows.
    """
    docs = grouped(docs)
    kept = vocabulary(docs, least)
    posted = postings(docs, kept, automaton_bytes)
    terms = posted.groupBy("term_id").agg(F.sum("n").alias("n_lang")).join(kept.select("term_id", "lang", "term"), "term_id")
    posted = posted.join(terms, "term_id")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    groups = written(groups.withColumn("absent", share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))), "groups")
    shares = posted.join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
    shares = shares.withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("n_lang"), F.col("lang_total"), F.col("v"))})
    shares = written(shares.select("lang", "source", "term_id", "term", "p", "q"), "shares")
    dropped(posted)
    pairs = pair_distances(shares.select("lang", "source", "term_id", "p"), groups.select("lang", "source", "v", "absent"))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= most_terms))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), found AS (
  SELECT rid, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counted AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM found GROUP BY lang, source, term) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT c.lang, source, term, n, 1 + CAST((CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY c.lang, source) + 5 * v) AS BIGINT) AS p
  FROM counted c JOIN sizes s ON c.lang = s.lang
), langs AS (
  SELECT n.lang, term, 1 + CAST((CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY n.lang) + 5 * v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term) n JOIN sizes s ON n.lang = s.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), above AS (
  SELECT s.lang, s.source, s.term AS item, s.p - l.q AS value FROM shares s JOIN langs l ON s.lang = l.lang AND s.term = l.term WHERE s.n > 0 AND s.p > l.q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM above
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

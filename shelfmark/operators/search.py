"""A small query language and full-text search over postings."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.units import SUFFIXES

#: k1 and b of BM25. Fixed values.
K1, B = 1.2, 0.75


#: Keys of the query language by the facet they stand for. Fixed values.
ALIASES = {
    "kind": "kind", "type": "model_type", "modeltype": "model_type", "model_type": "model_type", "dataset": "dataset_format", "datasetformat": "dataset_format", "dataset_format": "dataset_format", "format": "format", "fmt": "format",
    "framework": "framework", "fw": "framework", "lib": "framework", "library": "framework", "drive": "drive", "disk": "drive", "tag": "tag", "author": "author", "org": "author", "license": "license", "lic": "license",
    "quant": "quantization", "quantization": "quantization", "q": "quantization",
}
KINDS = ("model", "dataset", "adapter", "checkpoint", "paper", "unknown")
SIZE_KEYS = {"size": "", "bytes": "", "min": ">", "minsize": ">", "min_size": ">", "larger": ">", "bigger": ">", "max": "<", "maxsize": "<", "max_size": "<", "smaller": "<"}
SPELLED = ("kind", "model_type", "dataset_format", "format", "framework")


@dataclass
class Query:
    """What a query asks for; unknown holds keys that were taken for text, missing whether missing assets are wanted too."""

    terms: list[str] = field(default_factory=list)
    facets: dict[str, list[str]] = field(default_factory=dict)
    not_tags: list[str] = field(default_factory=list)
    sizes: list[tuple[str, float]] = field(default_factory=list)
    year: int | None = None
    status: str | None = None
    missing: bool = False
    unknown: list[str] = field(default_factory=list)

    def condition(self, columns: dict[str, str], size: str, modified: str, text: list[str]) -> Column:
        parts = [F.lower(F.col(columns[k])).isin([v.lower() for v in vs]) for k, vs in self.facets.items() if k in columns]
        for op, n in self.sizes:
            parts.append({">": F.col(size) >= n, "<": F.col(size) <= n, "=": F.col(size).between(n * 0.99, n * 1.01)}[op])
        if self.year:
            parts.append(F.year(modified) == self.year)
        if self.status and "status" in columns:
            parts.append(F.col(columns["status"]) == self.status)
        for t in self.terms:
            parts.append(reduce(Column.__or__, [F.col(c).ilike(f"%{t}%") for c in text]))
        return reduce(Column.__and__, parts, F.lit(True))

    def described(self) -> dict:
        """The parts that restrict anything."""
        return {k: v for k, v in vars(self).items() if v}


def parse(query: str, facets: tuple[str, ...] = ()) -> Query:
    """Bare words, ``key:value`` with the keys of ALIASES or ``facets``, quotes, ``-tag:x``, sizes like ``size:>1GB`` and ``min:``/``max:``, ``year:``, ``health:``, ``missing:``; unknown keys are text.

    A kind of asset given as a type is a kind. Negation is for tags; other
    negated keys are dropped. Never fails: quotes that don't close are letters.
    """
    out = Query()
    try:
        words = shlex.split(query)
    except ValueError:
        words = query.split()
    for word in words:
        negated, key, value = re.fullmatch(r"(-?)(?:([A-Za-z_]\w*):)?(.*)", word, re.DOTALL).groups()
        key, given = (key or "").lower(), value.strip()
        facet = key if key in facets else ALIASES.get(key)
        if key and not given:
            continue
        if key in ("health", "status"):
            out.status = given.lower()
        elif key in ("missing", "include_missing"):
            out.missing = given.lower() in ("1", "true", "yes", "on")
        elif facet and negated:
            out.not_tags += [given] * (facet == "tag")
        elif facet:
            if facet == "model_type" and given.lower() in KINDS:
                facet = "kind"
            spelled = given.lower().replace("-", "_") if facet in SPELLED and key not in facets else given
            out.facets.setdefault(facet, []).append(spelled)
        elif key in SIZE_KEYS and (m := re.fullmatch(r"(>=|<=|[<>=])?\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)", given)) and m[3].lower() in SUFFIXES:
            out.sizes.append((SIZE_KEYS[key] or (m[1] or ">")[0], float(m[2]) * SUFFIXES[m[3].lower()]))
        elif key == "year" and given.isdigit() and 1970 <= int(given) <= 2999:
            out.year = int(given)
        elif not negated or not key:
            out.unknown += [key] if key else []
            out.terms.append(word)
    return out


def postings(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(term, key, tf) of the runs of letters and digits, lower-cased."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("term")
    return docs.select(key, words).groupBy("term", key).agg(F.count("*").alias("tf"))


#: Characters of words, as a class of a pattern.
LETTERS = r"[\p{L}\p{N}]"


def _quoted(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in word)


def match_all(docs: DataFrame, text: str, key: str, prefixes: list[str]) -> DataFrame:
    """(key) of the documents that hold, for each prefix of letters and digits, a word beginning with it: a filter on the row, no shuffle."""
    low = F.lower(text)
    return docs.where(reduce(Column.__and__, [low.rlike(f"(?<!{LETTERS}){_quoted(p.lower())}") for p in prefixes], F.lit(True))).select(key)


def bm25(docs: DataFrame, text: str, key: str, terms: list[str]) -> DataFrame:
    """(key, score) of documents with any of the terms.

    Lengths and term counts come from the row itself; what they are held
    against (number of documents with words, mean length, documents of each
    term) is one aggregated row, read as a scalar. So no posting is shuffled.
    """
    low = F.lower(text)
    counts = [F.regexp_count(low, F.lit(f"(?<!{LETTERS}){_quoted(t.lower())}(?!{LETTERS})")).alias(f"tf_{i}") for i, t in enumerate(terms)]
    rows = docs.select(key, F.regexp_count(low, F.lit(f"{LETTERS}+")).alias("len"), *counts).where("len > 0")
    totals = rows.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]).alias("t")).scalar()
    hits = rows.where(reduce(Column.__or__, [F.col(f"tf_{i}") > 0 for i in range(len(terms))])).withColumn("t", totals)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df, n = F.col(f"tf_{i}"), F.col(f"t.df_{i}"), F.col("t.n")
        score = score + F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("t.mean")))
    return hits.select(key, F.round(score, 6).alias("score"))


#: Words of the runs by which passages are looked up.
ANCHOR = 5


def passages(docs: DataFrame, key: str, text: str, known: DataFrame, known_key: str, known_text: str) -> DataFrame:
    """(known_key, key) of the documents that hold a known passage, as it is written.

    Inside a passage's first and last word, which may go on in the document,
    its words are whole words of it. A run of them, of ANCHOR words or as many as
    there are, meets the runs of that length of the documents by equality; ids
    and runs are all that is joined, and texts are fetched for the pairs that
    meet. Passages of under three words have no such run: they come to each row
    as one array, in pieces of its table by their hash if there are many.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    known = known.select(F.col(known_key).alias("_k"), F.col(known_text).alias("_p")).where("_p is not null").withColumn("_w", words(F.col("_p")))
    n = F.least(F.lit(ANCHOR), F.size("_w") - 2)
    anchored = known.where("size(_w) > 2").select("_k", "_p", n.alias("_n"), F.array_join(F.slice("_w", F.lit(2), n), " ").alias("_run"))
    lengths = anchored.agg(F.collect_set("_n").alias("n")).scalar()
    runs = lambda w: F.flatten(F.transform("_l", lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))))
    spread = docs.select(F.col(key).alias("_d"), words(F.col(text)).alias("_dw")).withColumn("_l", lengths).select("_d", F.explode(F.array_distinct(runs(F.col("_dw")))).alias("_run"))
    pairs = spread.join(anchored, "_run").select("_d", "_k", "_p").distinct()
    long = docs.select(F.col(key).alias("_d"), F.col(text).alias("_t")).join(pairs, "_d").where(F.contains("_t", "_p")).select(F.col("_k").alias(known_key), F.col("_d").alias(key)).distinct()
    few = known.where("size(_w) <= 2")
    pieces = max(1, -(-few.count() // 10_000))
    listed = few.groupBy(F.pmod(F.xxhash64("_k"), F.lit(pieces)).alias("_piece")).agg(F.collect_list(F.struct("_k", "_p")).alias("_l"))
    short = docs.select(F.col(key).alias("_d"), F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("_piece")).join(F.broadcast(listed) if pieces == 1 else listed, "_piece")
    short = short.select("_d", F.explode(F.filter("_l", lambda x: F.contains(F.col("_t"), x["_p"]))).alias("_x")).select(F.col("_x._k").alias(known_key), F.col("_d").alias(key))
    return long.unionAll(short)

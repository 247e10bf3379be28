"""Toxicity: a weighted lexicon matched by Aho-Corasick, normalised by length, with exception phrases.

Texts are folded first: case, accents, compatibility forms, look-alike
letters of other scripts and digits that stand for letters. The lexicon holds
whole words and word beginnings whose share of toxic training documents is
significantly higher than that of the others, weighted by the log of the ratio;
exception phrases are pairs of words around a lexicon entry that mark its
harmless uses. A document's hits, one a word, add up; a logistic curve over
that sum and the sum per thousand words makes the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import fold_of, mix64, table, written

#: Training: labelled documents used at most, about; candidate entries, lexicon entries and exception phrases kept at most.
TRAINING_ROWS, CANDIDATES, ENTRIES, EXCEPTIONS = 20_000, 60_000, 8_000, 4_000

#: Documents whose crc32 has this remainder modulo HOLD_OUT_PARTS are never learned from; at or above THRESHOLD a document is toxic.
HOLD_OUT_PARTS, HELD_OUT, THRESHOLD = 4, 2, 0.3

#: Lengths of word beginnings in the lexicon, and characters of the longest whole word in it.
BEGINNINGS, LONGEST = (4, 5, 6), 62

#: Letters of other scripts by the Latin letter they look like. Fixed values.
LOOK_ALIKES = {
    "a": "аα", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еεё", "h": "һнη", "i": "іιїı", "j": "ј", "k": "кκ", "m": "м", "n": "пν", "o": "оοσ",
    "p": "рρ", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ѵ", "w": "ѡω", "x": "хχ", "y": "уγү",
}

#: Digits and signs by the letter they are written for. Fixed values.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def folding() -> dict[int, str]:
    """The translation table: decomposable letters by rule, then the two tables above."""
    out = {}
    for span in (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x2460, 0x2500)):
        for i in span:
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).lower()
            if base and base != chr(i) and base.isascii():
                out[i] = base
    out |= {ord(c): "ss" for c in "ßẞ"} | {ord(c): None for c in "­​‌‍⁠﻿"}
    out |= {i: None for i in range(0x300, 0x370)}
    out |= {ord(c): a for a, cs in LOOK_ALIKES.items() for c in cs}
    return out | {ord(c): a for c, a in SUBSTITUTES.items()}


FOLDING = folding()
_gaps = re.compile(r"[^a-zª-\U0010ffff]+")


def folded(text: str | None) -> str:
    """Folded words with single spaces between, before and after them; a space for no words."""
    words = _gaps.sub(" ", (text or "").lower().translate(FOLDING)).strip()
    return f" {words} " if words else " "


def candidates_of(text: str) -> set[str]:
    """Whole words and word beginnings of a folded text, marked with the spaces that bound them; of words over LONGEST characters the beginnings only."""
    out = set()
    for w in set(text.split()):
        if len(w) <= LONGEST:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in BEGINNINGS if len(w) > n)
    return out


@dataclass
class Lexicon:
    """weights by entry, exception phrases, and the curve (bias, per sum, per density). No entries: every score is 0."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def build(self) -> Lexicon:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry in {**self.weights, **dict.fromkeys(self.exceptions)}:
            self.automaton.add_word(entry, (len(entry), self.weights.get(entry, 0.0), entry in self.exceptions_set))
        if self.weights:
            self.automaton.make_automaton()
        return self

    @property
    def exceptions_set(self) -> frozenset[str]:
        if "_set" not in self.__dict__:
            self.__dict__["_set"] = frozenset(self.exceptions)
        return self.__dict__["_set"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "_set")}

    def hits(self, text: str) -> dict[int, float]:
        """Weight of the best entry at the beginning of each word of a folded text, exceptions left out."""
        if not self.weights:
            return {}
        best: dict[int, float] = {}
        spans = []
        for end, (size, weight, exception) in self.automaton.iter(text):
            begin = end - size + 1
            if exception:
                spans.append((begin, end))
            if weight > best.get(begin, 0.0):
                best[begin] = weight
        for begin, end in spans:
            for at in [b for b in best if begin <= b < end]:
                del best[at]
        return best

    def measures(self, text: str) -> tuple[float, float]:
        """log(1 + sum) and log(1 + sum per thousand words)."""
        total = sum(self.hits(text).values())
        words = max(1, text.count(" ") - 1)
        return math.log1p(total), math.log1p(1000.0 * total / words)

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        a, b = self.measures(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _counted(sample: DataFrame, features) -> DataFrame:
    """(feature, n_toxic, n_other): sample documents of either label that have the feature. features: of a folded text."""

    def run(batches):
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if label else other).update(features(folded(text)))
        names = list(toxic | other)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([other[n] for n in names], pa.int64())], ["feature", "n_toxic", "n_other"])

    counted = sample.select("text", "toxic").mapInArrow(run, "feature string, n_toxic bigint, n_other bigint")
    return counted.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


def _without_copies(sample: DataFrame) -> DataFrame:
    """sample without documents that share one of four minima over hashed five-word runs with one of smaller id.

    Copies of one document would make each of its words look significant.
    """

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                words = folded(text).split()
                runs = [zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))]
                h = np.array(runs, np.uint64)
                found.append([int(mix64(h + np.uint64(k << 40)).min() >> np.uint64(1)) for k in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "minima"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    left = sample.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, minima array<bigint>")
    for k in range(4):
        left = left.groupBy(F.element_at("minima", k + 1).alias("m")).agg(F.min(F.struct("doc_id", "minima")).alias("first")).select("first.*")
    return sample.join(F.broadcast(left.select("doc_id").distinct()), "doc_id")


def significance(k1: np.ndarray, n1: int, k0: np.ndarray, n0: int) -> np.ndarray:
    """Log-likelihood ratio statistic of two shares."""
    p = (k1 + k0) / (n1 + n0)
    part = lambda k, n: k * np.log(np.maximum(k / n / p, 1e-300)) + (n - k) * np.log(np.maximum((1 - k / n) / np.maximum(1 - p, 1e-300), 1e-300))
    return 2 * (part(k1, n1) + part(k0, n0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Bias and slopes, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def trained(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Lexicon:
    """A lexicon from docs(doc_id, text) and labels(doc_id, toxic), held-out rows left aside.

    Of labels that repeat the highest counts; null ones don't. Beyond
    training_rows labelled documents a share of them is taken by hash of the id;
    its ids, so many at most, are broadcast.
    """
    kept = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", HOLD_OUT_PARTS) != HELD_OUT))
    kept = kept.groupBy("doc_id").agg((F.max("toxic") >= 1).alias("toxic"))
    share = max(1, math.ceil(kept.count() / training_rows))
    kept = kept.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(share)) == 0)
    sample = written(docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id"), "labelled")
    sample = written(_without_copies(sample), "labelled")
    n = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        return Lexicon()
    often = _counted(sample.where("toxic"), candidates_of).where("n_toxic >= 3").orderBy(F.desc("n_toxic"), "feature").limit(CANDIDATES)
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["feature"] for r in often.select("feature").collect()))
    rows = _counted(sample, lambda text: candidates_of(text) & wanted.value).toPandas().sort_values("feature")
    k1, k0 = rows["n_toxic"].to_numpy(float), rows["n_other"].to_numpy(float)
    weight = np.log((k1 + 0.5) / (n[True] + 1)) - np.log((k0 + 0.5) / (n[False] + 1))
    sure = significance(k1, n[True], k0, n[False]) if len(rows) else weight
    good = np.flatnonzero((weight >= 1.0) & (sure >= 2 * math.log(max(2, len(rows))) + 4))
    good = good[np.argsort(-sure[good], kind="stable")][:ENTRIES]
    lexicon = Lexicon({rows["feature"].iloc[i]: float(weight[i]) for i in good})
    if not lexicon.weights:
        return lexicon

    def around(text: str) -> set[str]:
        lex = _ready(lexicon)
        out = set()
        for at in lex.hits(text):
            end = text.index(" ", at + 1)
            before, after = text.rfind(" ", 0, at), text.find(" ", end + 1)
            out |= {text[at : after + 1]} if after > 0 else set()
            out |= {text[before : end + 1]} if before >= 0 else set()
        return out

    ratio = n[True] / n[False]
    phrases = _counted(sample, around).where((F.col("n_other") >= 3) & (F.col("n_toxic") < F.col("n_other") * ratio / 2)).orderBy(F.desc("n_other"), "feature").limit(EXCEPTIONS)
    lexicon.exceptions = [r["feature"] for r in phrases.collect()]

    def measured(batches):
        lex = _ready(lexicon)
        for batch in batches:
            m = [lex.measures(folded(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.float64()), batch.column("toxic")], ["a", "b", "toxic"])

    m = sample.mapInArrow(measured, "a double, b double, toxic boolean").toPandas().sort_values(["a", "b", "toxic"])
    lexicon.curve = tuple(logistic(m[["a", "b"]].to_numpy(float), m["toxic"].to_numpy(float)))
    return lexicon


def _ready(lexicon: Lexicon) -> Lexicon:
    """The lexicon with its automaton, built once for each copy that reaches this process."""
    if not hasattr(lexicon, "automaton"):
        lexicon.build()
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs(doc_id, text) to (doc_id, held_out, score, predicted).

    Null texts count as empty, which has no hits; texts of any length are
    scored whole, each row that repeats is scored, a null doc_id counts as
    empty text for held_out; further columns are left out; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = _ready(shared.value)
        for batch in batches:
            s = [lex.score(folded(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held = fold_of("doc_id", HOLD_OUT_PARTS) == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_lexicon_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that score THRESHOLD or more; one pass, no join: the test is a predicate on each row's text.

    Null and empty texts have no hits and score as such do; rows that repeat
    are judged alike; extra columns stay; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(trained(docs, table(spark, sf_dir, "labels")))
    where = docs.columns.index("text")

    def run(batches):
        lex = _ready(shared.value)
        for batch in batches:
            clean = [lex.score(folded(t)) < THRESHOLD for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

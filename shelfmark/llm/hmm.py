"""Language-model scoring by a hidden Markov model over words.

Words are lower-cased (A-Z) and counted in all training documents. The HEAD
most frequent are symbols of their own; every other word is one of TAIL
classes by its ending, and has a share of its class by its count, smoothed so
that unseen words have one too. A hidden Markov chain emits the symbols:
Baum-Welch counts of all training documents, cut into windows, are summed over
partitions in each round. A document's likelihood is the chain's, by the
scaled forward recursion over its whole sequence, times the shares of its
rarer words. These are looked up by a join with the counts, as they may be
many; the frequent ones, where the skew is, travel as a table of fixed size.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.chunks import WIDE_BYTES, blocks, coded_words
from shelfmark.llm.common import fold_of, table, written

#: Words that are symbols, classes of the others, hidden states, rounds of Baum-Welch, words of a training window.
HEAD, TAIL, STATES, ROUNDS, WINDOW = 8192, 64, 8, 7, 256

#: Documents whose crc32 has this remainder modulo HOLD_OUT_PARTS are scored only.
HOLD_OUT_PARTS, HELD_OUT = 5, 1

#: Words of a batch of the recursions.
BATCH_WORDS = 400_000

#: Weight of the overall shares of symbols in each state's.
PRIOR = 200.0


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def lowered_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """coded_words() of texts with A to Z folded.

    ascii_lower() folds A to Z and ascii_split_whitespace() cuts at space and
    09 to 0D: just the definitions wanted. Null texts are empty. A slice is
    copied first: ascii_lower() goes astray on one that a cast has widened.
    """
    return coded_words(pc.ascii_lower(pa.concat_arrays([texts])))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs(text)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for i, j in blocks(texts, WIDE_BYTES):
                words, numbers, _ = lowered_words(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(numbers, minlength=len(words)).astype(np.int64))], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The head words by symbol, and what the whole of the training words comes to."""

    head: dict[bytes, int]
    head_counts: np.ndarray
    tail_totals: np.ndarray
    tail_words: np.ndarray
    documents: int

    @property
    def end(self) -> int:
        return HEAD + TAIL

    @property
    def tokens(self) -> int:
        return int(self.head_counts.sum() + self.tail_totals.sum()) + self.documents

    @property
    def distinct(self) -> int:
        return len(self.head) + int(self.tail_words.sum()) + (self.documents > 0)

    @property
    def counts(self) -> np.ndarray:
        """Of all symbols."""
        out = np.zeros(self.end + 1)
        out[: len(self.head)] = self.head_counts
        out[HEAD : self.end] = self.tail_totals
        out[self.end] = self.documents
        return out

    @property
    def tail_sizes(self) -> np.ndarray:
        """Smoothed size of each class, so that its words, and one unseen, have shares (c + 0.5) / size."""
        return self.tail_totals + 0.5 * (self.tail_words + 1)


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """From written counts: HEAD words and TAIL rows reach the driver."""
    # words by powers of two of their count: what the HEAD most frequent lie above, and few others
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    least = next((r["least"] for r, n in zip(steps, np.cumsum([r["n"] for r in steps]), strict=True) if n >= HEAD), 0)
    top = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    head = {bytes(r["word"]): i for i, r in enumerate(top)}
    head_counts = np.array([r["c"] for r in top], np.int64)
    classes = F.crc32(F.substring("word", -2, 2)) % TAIL
    totals, words = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in counts.groupBy(classes.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        totals[r["k"]], words[r["k"]] = r["c"], r["n"]
    for w, i in head.items():
        totals[tail_class(w)] -= head_counts[i]
        words[tail_class(w)] -= 1
    return Vocabulary(head, head_counts, totals, words, documents)


def symbols(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs(rid, doc_id, held_out, text) with symbols (16-bit, end included) in the text's place, and the distinct tail words with how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        voc = shared.value
        head = voc.head
        for batch in batches:
            texts = batch.column("text")
            for i, j in blocks(texts, WIDE_BYTES):
                words, numbers, offsets = lowered_words(texts.slice(i, j - i))
                symbol = np.array([x if (x := head.get(w)) is not None else HEAD + tail_class(w) for w in words], np.int64)
                n = j - i
                sequence = symbol[numbers] if len(words) else np.zeros(0, np.int64)
                ends = offsets + np.arange(n + 1)
                flat = np.insert(sequence.astype("<u2"), offsets[1:], voc.end)
                rows = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * 2), pa.py_buffer(flat)])
                rare = np.flatnonzero(sequence >= HEAD)
                doc = np.searchsorted(offsets, rare, "right") - 1
                pairs, times = np.unique(doc * max(1, len(words)) + numbers[rare], return_counts=True)
                doc, word = np.divmod(pairs, max(1, len(words)))
                cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                tail = pa.ListArray.from_arrays(cuts, pa.array(words, pa.binary()).take(pa.array(word)))
                times = pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))
                part = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("held_out"), rows.cast(pa.binary()), tail, times], ["rid", "doc_id", "held_out", "symbols", "tail", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"rid bigint, doc_id {kind}, held_out boolean, symbols binary, tail array<binary>, times array<int>")


@dataclass
class Chain:
    """start: of documents; resume: of later windows; move: (from, to); emit: (symbol, state)."""

    start: np.ndarray
    resume: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(counts: np.ndarray) -> Chain:
        """Slightly different states; the numbers are always the same."""
        rng = np.random.default_rng(17)
        share = (counts + 0.5) / (counts + 0.5).sum()
        emit = share[:, None] * rng.uniform(0.2, 1.8, (len(counts), STATES))
        move = rng.uniform(0.5, 1.5, (STATES, STATES)) + 4 * np.eye(STATES)
        even = np.full(STATES, 1 / STATES)
        return Chain(even, even, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def expected(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, fresh: np.ndarray):
        """Baum-Welch counts of windows of flat, longest first: (start, resume, move, emit, log-likelihood)."""
        n, top = len(begin), int(length[0])
        active = [int(np.searchsorted(-length, -t, "left")) for t in range(top)]  # windows longer than t
        alpha, scale = [], []
        for t in range(top):
            m = active[t]
            e = self.emit[flat[begin[:m] + t]]
            a = (np.where(fresh[:, None], self.start, self.resume) if t == 0 else alpha[-1][:m] @ self.move) * e
            c = a.sum(axis=1)
            alpha.append(a / c[:, None])
            scale.append(c)
        move = np.zeros((STATES, STATES))
        gammas, at = [None] * top, [None] * top
        beta = np.ones((active[-1], STATES))
        for t in range(top - 1, -1, -1):
            m = active[t]
            if len(beta) < m:  # windows that end here
                beta = np.concatenate([beta, np.ones((m - len(beta), STATES))])
            gammas[t], at[t] = alpha[t] * beta, flat[begin[:m] + t]
            if t:
                w = self.emit[at[t]] * beta / scale[t][:, None]
                move += alpha[t - 1][:m].T @ w
                beta = w @ self.move.T
        gamma, symbol = np.concatenate(gammas), np.concatenate(at)
        emit = np.stack([np.bincount(symbol, gamma[:, s], len(self.emit)) for s in range(STATES)], axis=1)
        return gammas[0][fresh].sum(axis=0), gammas[0][~fresh].sum(axis=0), move * self.move, emit, float(sum(np.log(c).sum() for c in scale))

    def log10_likelihood(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of whole sequences, longest first, by the scaled forward recursion."""
        out = np.zeros(len(begin))
        a = None
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t, "left"))
            a = (self.start if t == 0 else a[:m] @ self.move) * self.emit[flat[begin[:m] + t]]
            c = a.sum(axis=1)
            out[:m] += np.log10(c)
            a = a / c[:, None]
        return out


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat symbols, begins, lengths) of a column of symbol strings."""
    rows = [np.frombuffer(x.as_buffer(), "<u2") for x in column]
    length = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)), np.cumsum(length) - length, length


def trained(encoded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over all rows of encoded(symbols); each round brings a row a symbol and state to the driver."""
    spark, chain = encoded.sparkSession, Chain.first(counts)
    share = (counts + 0.5) / (counts + 0.5).sum()
    names = [f"s{s}" for s in range(STATES)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)

        def run(batches, shared=shared):
            chain = shared.value
            start, resume, move, emit, seen = np.zeros(STATES), np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(chain.emit), False
            for batch in batches:
                flat, begin, length = _sequences(batch.column("symbols"))
                pieces = -(-length // WINDOW)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = np.repeat(begin, pieces) + nth * WINDOW
                size = np.minimum(WINDOW, np.repeat(begin + length, pieces) - first)
                order = np.argsort(-size, kind="stable")
                for part in np.array_split(order, max(1, len(flat) // BATCH_WORDS)):
                    if len(part):
                        a, b, c, d, _ = chain.expected(flat, first[part], size[part], nth[part] == 0)
                        start, resume, move, emit, seen = start + a, resume + b, move + c, emit + d, True
            if seen:
                used = np.flatnonzero(emit.any(axis=1))
                rows = np.concatenate([start[None], resume[None], move, emit[used]])
                ids = np.concatenate([np.arange(-STATES - 2, 0), used])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(rows[:, s]) for s in range(STATES)]], ["id", *names])

        summed = encoded.select("symbols").mapInArrow(run, "id int, " + ", ".join(f"{n} double" for n in names)).groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).toPandas().set_index("id")
        shared.unpersist()
        if summed.empty:
            return chain
        get = lambda i: summed.loc[i].to_numpy(float) if i in summed.index else np.zeros(STATES)
        emit = np.zeros_like(chain.emit)
        kept = summed[summed.index >= 0]
        emit[kept.index.to_numpy()] = kept.to_numpy(float)
        emit += PRIOR * share[:, None]
        start, resume = get(-STATES - 2) + 0.1, get(-STATES - 1) + 0.1
        move = np.stack([get(s - STATES) for s in range(STATES)]) + 0.1
        chain = Chain(start / start.sum(), resume / resume.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return chain


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs(doc_id, text).

    A null text is empty and has only its end. Rows that repeat count and
    stand each; texts of any length are scored whole; equally frequent words
    enter the vocabulary's head by their bytes; further columns are left out.
    Without training documents all counts are 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (fold_of("doc_id", HOLD_OUT_PARTS) == HELD_OUT).alias("held_out"), "text")
    training = rows.where("not held_out")
    counts = written(word_counts(training), "counts")
    voc = vocabulary(counts, training.count())
    encoded = written(symbols(rows.select(F.monotonically_increasing_id().alias("rid"), "*"), voc), "encoded")
    chain = trained(encoded.where("not held_out"), voc.counts, rounds)

    shared = spark.sparkContext.broadcast((chain, voc))
    whole = np.log10(voc.tokens + 0.5 * (voc.distinct + 1))

    def run(batches):
        chain, voc = shared.value
        head = np.zeros(voc.end + 1)
        head[: len(voc.head)] = np.log10(voc.head_counts + 0.5)
        head[voc.end] = np.log10(voc.documents + 0.5)
        of_class = np.zeros(voc.end + 1)
        of_class[HEAD : voc.end] = np.log10(voc.tail_sizes)
        known = np.zeros(voc.end + 1, np.int64)
        known[: len(voc.head)] = 1
        known[voc.end] = voc.documents > 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, begin, length = _sequences(batch.column("symbols"))
            order = np.argsort(-length, kind="stable")
            likelihood = np.zeros(len(length))
            likelihood[order] = chain.log10_likelihood(flat, begin[order], length[order])
            sums = lambda x: np.add.reduceat(x[flat], begin)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(length), pa.array(sums(known)), pa.array(sums(head) - length * whole), pa.array(likelihood - sums(of_class))],
                ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = encoded.select("rid", "doc_id", "held_out", "symbols").mapInArrow(
        run, f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    rare = encoded.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left")
    share = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rare = found.groupBy("rid").agg(F.sum(F.col("times") * share).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("known")).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more("logs")).alias("base_score"), (F.col("score") + more("logs")).alias("score"),
    )


def op9_hmm_likelihood(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))

"""A stored full-text index: postings in blocks of documents, with the most that a block can add to a score.

Documents are put into classes by length and those of a class dealt into
blocks, so that those of a block are alike in what a word in them is worth. A
row of the postings is a term in a block: the block's documents that hold it,
and the greatest of their impacts, which is BM25 without the weight of the
term. Each file of the postings holds whole blocks, by term. A query reads these
heads first; blocks whose heads can't sum up to the k-th best score of the
most promising ones aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.operators.search import B, K1

#: Documents of a block, and blocks that are read to find what the others must reach.
BLOCK_DOCS, FIRST_BLOCKS = 512, 4

#: Words of a block and of a task that makes postings, about; classes of length for each doubling.
BLOCK_WORDS, TASK_WORDS, CLASSES = 1 << 17, 1 << 21, 16

#: Digits of scores.
DIGITS = 6


@dataclass
class Ranked:
    """The best documents (key, score), and how many of the blocks with any of the terms were read for them."""

    rows: DataFrame
    blocks_read: int
    blocks: int


def impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def words_of(text: str) -> Column:
    """The runs of letters and digits of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def build(docs: DataFrame, text: str, key: str, path: str, block_docs: int = BLOCK_DOCS) -> None:
    """Writes the index of docs(key, text) under path; keys are unique. Null and empty texts have no words and aren't in it.

    Words are shuffled once, as the text of their document, to the task of its
    block; a term's count is made in the document's row and its postings in that task.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("key"), words_of(text).alias("words")).select("key", F.size("words").alias("len"), F.array_join("words", " ").alias("words"))
    sized.write.parquet(f"{path}/documents")
    # restricted as it is read: before that, the restriction would look for all words a second time
    stored = spark.read.parquet(f"{path}/documents").where("len > 0").withColumn("class", F.floor(F.log2("len") * CLASSES))
    stored.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.sum("len").alias("words")).coalesce(1).write.parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals").first()
    # a row for each class, of which there are 31 * CLASSES at most
    classes = stored.groupBy("class").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("len") / BLOCK_WORDS)).alias("blocks"))
    block = F.col("class") * (1 << 31) + F.pmod(F.xxhash64("key"), F.col("blocks"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(totals["words"] or 0) // TASK_WORDS))
    dealt = stored.join(F.broadcast(classes), "class").select("key", "len", block.alias("block"), "words").repartition(tasks, "block")
    # in order, equal words lie side by side, so that the places where another one begins tell the counts
    ordered = dealt.select("key", "len", "block", F.sort_array(F.split("words", " ")).alias("w"))
    begins = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    counted = F.transform("begins", lambda b, i: F.struct(F.get("w", b).alias("term"), (F.coalesce(F.get("begins", i + 1), F.col("len")) - b).alias("tf")))
    counts = ordered.withColumn("begins", begins).select("key", "len", "block", F.inline(counted))
    rows = counts.groupBy("block", "term").agg(F.max(impact(F.col("tf"), F.col("len"), F.lit(totals["mean"]))).alias("most"), F.collect_list(F.struct("key", "tf", "len")).alias("held"))
    rows.sortWithinPartitions("term", "block").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")


def ranked(spark: SparkSession, path: str, terms: list[str], k: int, prefixes: bool = False, every: bool = False, allowed: DataFrame | None = None) -> Ranked:
    """The k best documents by BM25, best first, equal ones by key; all of them, if fewer.

    Terms are words, or beginnings of words with ``prefixes``; a document needs
    any of them, or all with ``every``. ``allowed``(key) restricts what is
    ranked, not what scores are made from. Exact: a block is left out only
    where its bound is below the k-th score found.
    """
    asked = list(dict.fromkeys(t.lower() for t in terms))
    empty = Ranked(spark.createDataFrame([], spark.read.parquet(f"{path}/documents").select("key", F.lit(0.0).alias("score")).schema), 0, 0)
    if not asked or k < 1:
        return empty
    is_of = [F.startswith("term", F.lit(t)) if prefixes else F.col("term") == t for t in asked]
    which = F.array_compact(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(is_of)]))
    postings = spark.read.parquet(f"{path}/postings").where(reduce(Column.__or__, is_of)).withColumn("q", F.explode(which))
    totals = spark.read.parquet(f"{path}/totals").first()
    # documents of each term: as many numbers as the query has terms
    found = {r["q"]: r["df"] for r in postings.select("q", F.explode("held.key").alias("key")).groupBy("q").agg(F.count_distinct("key").alias("df")).collect()} if prefixes else {r["q"]: r["df"] for r in postings.groupBy("q").agg(F.sum(F.size("held")).alias("df")).collect()}
    if not found or every and len(found) < len(asked):
        return empty
    weight = F.element_at(F.create_map(*[x for q, df in found.items() for x in (F.lit(q), F.log(1 + (F.lit(totals["n"]) - df + 0.5) / (F.lit(df) + 0.5)))]), F.col("q"))
    # several words of one beginning: the impact of their sum is at most the sum of their impacts
    bounds = postings.groupBy("block").agg(F.sum(weight * F.col("most")).alias("bound"), F.count_distinct("q").alias("n_terms"))
    bounds = bounds.where(F.col("n_terms") == len(asked)) if every else bounds

    def scored(blocks: DataFrame) -> DataFrame:
        held = postings.join(F.broadcast(blocks), "block", "left_semi").select("q", F.inline("held")).where("key is not null")
        held = held.join(allowed.select(F.col(allowed.columns[0]).alias("key")), "key", "left_semi") if allowed is not None else held
        per = held.groupBy("key", "q").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
        out = per.groupBy("key").agg(F.round(F.sum(weight * impact(F.col("tf"), F.col("len"), F.lit(totals["mean"]))), DIGITS).alias("score"), F.count("*").alias("n"))
        return (out.where(F.col("n") == len(asked)) if every else out).select("key", "score").orderBy(F.desc("score"), "key").limit(k)

    best = bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).select("block")
    reached = scored(best).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = reached["least"] - 10**-DIGITS if reached["n"] == k else -1.0
    wanted = bounds.where((F.col("bound") >= least) | F.col("bound").isNull())
    count = bounds.agg(F.count("*").alias("blocks"), F.count_if(F.col("bound") >= least).alias("read")).first()
    return Ranked(scored(wanted.select("block").union(best).distinct()), max(count["read"], min(FIRST_BLOCKS, count["blocks"])), count["blocks"])

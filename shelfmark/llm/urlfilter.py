"""URL filters: host and path rules, then a character language-model ratio.

Two smoothed variable-order Markov models over characters, one of accepted
and one of rejected URLs, are fitted to the URLs that rules decide. A URL
without a rule gets the difference of its log-likelihoods divided by its
length, and is allowed at or above a threshold calibrated on rule-decided URLs
that the models haven't seen. Contexts of up to two characters over a fixed
alphabet give a table of ALPHABET cubed log-ratios: its size doesn't depend on
the data, so it travels to the scoring expression as one array, and scoring is
a projection without join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import table, written

#: (verdict, host, path). Fixed values.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Characters that the models tell apart; all others share one further symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?&=%:#+~"
SYMBOLS = len(ALPHABET) + 3  # others, begin, end
OTHER, BEGIN, END = len(ALPHABET), len(ALPHABET) + 1, len(ALPHABET) + 2

#: A context counts from so many occurrences; rarer ones fall back to a shorter context.
LEAST_CONTEXT = 4

#: Rule-decided URLs whose crc32 modulo this is 0 calibrate the threshold; the others train the models.
CALIBRATION_PARTS = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is no ://."""
    behind = F.substr(url, F.locate("://", url) + 3)
    found = F.translate(F.regexp_extract(behind, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(F.when(F.instr(url, "://") > 0, found), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty where there is no ://."""
    behind = F.substr(url, F.instr(url, "://") + 3)
    found = F.regexp_extract(behind, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, found), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def symbols_of(url: Column) -> Column:
    """The URL behind its scheme as symbol numbers, between two begins and an end."""
    text = F.translate(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.coalesce(url, F.lit(""))), UPPER, LOWER)
    one = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)) - 1, F.lit(OTHER))
    chars = F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), one))
    return F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), chars, F.array(F.lit(END)))


def grams_of(symbols: Column) -> Column:
    """Number of (two before, before, symbol) at each place of the URL."""
    number = lambda s, i: (F.element_at(s, i - 2) * SYMBOLS + F.element_at(s, i - 1)) * SYMBOLS + F.element_at(s, i)
    # symbols is bound by a lambda, else each place would compute all of it anew
    return F.element_at(F.transform(F.array(symbols), lambda s: F.transform(F.sequence(F.lit(3), F.size(s)), lambda i: number(s, i))), 1)


def log_ratios(labelled: DataFrame, least_context: int = LEAST_CONTEXT) -> DataFrame:
    """One row, one array: at each trigram's number log P(symbol | context) of accepted less that of rejected URLs.

    labelled: (verdict, grams). Witten-Bell smoothing from order 2 down to 0
    and a uniform floor; a context of fewer than least_context occurrences is
    skipped for the next shorter one. Unseen symbols get what the shorter
    context leaves them.
    """
    n = SYMBOLS
    tri = labelled.select("verdict", F.explode("grams").alias("g")).groupBy("verdict", "g").agg(F.count("*").cast("double").alias("k"))
    tri = written(tri, "trigrams").select("verdict", "g", "k", (F.col("g") % n).alias("c"), (F.floor(F.col("g") / n) % n).alias("b"), F.floor(F.col("g") / (n * n)).alias("a"))
    spread = lambda on: F.sum("k").alias(f"n_{on}"), lambda on: F.count("*").cast("double").alias(f"t_{on}")
    bi = tri.groupBy("verdict", "b", "c").agg(F.sum("k").alias("k_bc"))
    uni = bi.groupBy("verdict", "c").agg(F.sum("k_bc").alias("k_c"))
    of_ab = tri.groupBy("verdict", "a", "b").agg(*[f("ab") for f in spread])
    of_b = bi.withColumnRenamed("k_bc", "k").groupBy("verdict", "b").agg(*[f("b") for f in spread])
    of_all = uni.withColumnRenamed("k_c", "k").groupBy("verdict").agg(*[f("0") for f in spread])
    grid = labelled.sparkSession.range(2 * n**3).select(
        F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("verdict"), F.floor(F.col("id") / 2).alias("g")
    )
    grid = grid.select("verdict", "g", (F.col("g") % n).alias("c"), (F.floor(F.col("g") / n) % n).alias("b"), F.floor(F.col("g") / (n * n)).alias("a"))
    full = (
        grid.join(F.broadcast(tri.select("verdict", "g", "k")), ["verdict", "g"], "left")
        .join(F.broadcast(of_ab), ["verdict", "a", "b"], "left")
        .join(F.broadcast(bi), ["verdict", "b", "c"], "left")
        .join(F.broadcast(of_b), ["verdict", "b"], "left")
        .join(F.broadcast(uni), ["verdict", "c"], "left")
        .join(F.broadcast(of_all), ["verdict"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    p0 = (zero("k_c") + zero("t_0") / n) / F.greatest(zero("n_0") + zero("t_0"), F.lit(1.0))
    p0 = F.when(zero("n_0") > 0, p0).otherwise(F.lit(1.0 / n))
    p1 = F.when(zero("n_b") >= least_context, (zero("k_bc") + zero("t_b") * p0) / (zero("n_b") + zero("t_b"))).otherwise(p0)
    p2 = F.when(zero("n_ab") >= least_context, (zero("k") + zero("t_ab") * p1) / (zero("n_ab") + zero("t_ab"))).otherwise(p1)
    ratio = full.groupBy("g").agg(F.sum(F.when(F.col("verdict") == "allow", F.log(p2)).otherwise(-F.log(p2))).alias("w"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("g", "w"))), lambda x: x["w"])
    return ratio.agg(packed.alias("ratios"))


def score_of(grams: Column, ratios: Column) -> Column:
    """Log-likelihood difference a symbol."""
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.element_at(ratios, g.cast("int") + 1))
    return total / F.size(grams)


def calibrated(scored: DataFrame, bins_per_unit: int = 200, widest: float = 5.0) -> DataFrame:
    """One row: the threshold with the least mean of both error rates over (verdict, score), 0 where one verdict is missing.

    Scores fall into bins; 2 * widest * bins_per_unit of them at most.
    """
    bins = scored.groupBy(F.floor(F.greatest(F.lit(-widest), F.least(F.lit(widest), F.col("score"))) * bins_per_unit).alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").cast("double").alias("allow"), F.count_if(F.col("verdict") == "block").cast("double").alias("block")
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bins = bins.withColumn(
        "error",
        F.coalesce(F.sum("allow").over(below), F.lit(0.0)) / F.sum("allow").over(every) + 1 - F.coalesce(F.sum("block").over(below), F.lit(0.0)) / F.sum("block").over(every),
    )
    # half way from the bin below, whose scores the cut leaves out
    cut = (F.col("bin") + F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin"))).cast("double") / (2 * bins_per_unit)
    bins = bins.withColumn("cut", cut)
    best = F.min_by("cut", F.struct(F.col("error"), F.abs("cut"), "cut"))
    return bins.where("error is not null").agg(F.coalesce(best, F.lit(0.0)).alias("threshold"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of pages(page_id, url).

    A null URL or one without :// has an empty host and path, which no rule
    fits, and is judged by its characters; an empty table gives no rows; rows
    that repeat are judged each; without rule-decided URLs of both kinds the
    ratio is 0 or leans to the one kind, and a score at the threshold allows.
    """
    url = F.col("url")
    split = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    split = split.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("grams", grams_of(symbols_of(url)))
    learning = split.where("fit is not null").select(F.col("fit.verdict").alias("verdict"), "grams", (F.crc32(url) % CALIBRATION_PARTS == 0).alias("held"))
    ratios = written(log_ratios(learning.where("not held").select("verdict", "grams")), "ratios")
    held = learning.where("held").withColumn("ratios", ratios.scalar())
    threshold = calibrated(held.select("verdict", score_of(F.col("grams"), F.col("ratios")).alias("score"))).first()[0]
    score = score_of(F.col("grams"), F.col("ratios"))
    return split.withColumn("ratios", ratios.scalar()).withColumn("score", score).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score",
    )


def op2_url_model_ratio(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))

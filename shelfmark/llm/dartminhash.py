"""Near duplicates: DartMinHash signatures, banded joining, exact verification, connected components.

A document is the set of its five-word shingles. Darts fall on a
plane of weight and rank above each shingle, as a Poisson process that is a
function of the shingle alone; those within the shingle's weight and below a
rank bound are thrown into the coordinates of a signature, and each coordinate
keeps the dart of lowest rank. Two signatures agree in a coordinate with
probability equal to the weighted Jaccard similarity. The bound is chosen so
that a document gets a fixed number of darts however long it is.

A shingle weighs 1 however often it repeats, so candidates are found by the
similarity that decides on them: the exact Jaccard similarity of the documents'
sets of shingles.

Documents of equal words are one class before any joining. A band of equal
coordinates puts representatives into a bucket; each bucket links its members
to the least of them, and then, while it holds several classes, to further
pivots, a few times. What then isn't of the least member's class meets the
bucket's other classes, where the similarities to the least member allow it:
with d = 1 - similarity a metric, a pair is only within reach if these differ
by no more than the threshold's distance. So linked copies aren't expanded into
pairs. Pairs of copies that are just not alike enough would still be many in a
large group, so documents of such buckets get finer signatures of FINE
coordinates, and only pairs that agree in nearly as many of these as the
threshold asks for are measured: at a similarity of 0.7 about one in 60, at 0.6
none in a million.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.chunks import blocks, coded_words
from shelfmark.llm.common import dropped, mix64, table, unit, written

#: Words of a shingle, least similarity of a link, bands, and coordinates of a band.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 30, 6

#: Coordinates of the finer signatures of documents in buckets that stay mixed, two bits each, and how many two documents at the threshold agree in, less four standard deviations.
FINE, CHANCE = 1024, 0.25
ALIKE = SIMILARITY + (1 - SIMILARITY) * CHANCE
LEAST_FINE = int(FINE * ALIKE - 4 * math.sqrt(FINE * ALIKE * (1 - ALIKE)))

#: Further pivots of a bucket that holds several classes.
PIVOTS = 4

#: Width of the cells in which distances to a bucket's least member are compared.
CELL = 1 - SIMILARITY

#: Bits of the map of hashed ids that keeps most texts without candidates out of the shuffle: 8 MiB at most are broadcast.
MAP_BITS = 1 << 26

#: Bytes of text whose shingles are made together.
SHINGLE_BYTES = 4_000_000


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): a 64-bit hash of each lower-cased word of all texts, and where each text begins and ends. Null texts have no words."""
    words, numbers, offsets = coded_words(pc.utf8_lower(pa.concat_arrays([texts])))
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return known[numbers] if len(words) else np.zeros(0, np.uint64), offsets


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n if len(out) else 0):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def shingles_of(texts: pa.Array) -> list[tuple[np.ndarray, bytes | None]]:
    """(shingles, digest of the words) of each text: hashes of its runs of five words, in order; one of all words where there are fewer, none without words."""
    h, offsets = word_hashes(texts)
    all_ = runs(h, SHINGLE)
    out = []
    for i, j in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        own = all_[i : j - SHINGLE + 1] if j - i >= SHINGLE else runs(h[i:j], j - i) if j > i else all_[:0]
        out.append((own, hashlib.md5(h[i:j].tobytes()).digest() if j > i else None))
    return out


class Darts:
    """Signatures of k coordinates. All hashes depend on the shingle, the weight cell and the dart's number only.

    Above each weight cell ([0, 1), [1, 2), [2, 4), ...) of a shingle the darts
    have density k, so their ranks grow by exponential steps of mean 1 / (k *
    width) and are drawn in order; a document stops at its bound.
    """

    def __init__(self, k: int, seed: int = 0):
        self.k, self.seed = k, mix64(np.array([seed], np.uint64))[0]
        self.mean = k * (math.log(k) + 3.0)  # darts of a document: one in twenty documents has an empty coordinate

    def signatures(self, element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """(n, k) hashes of the lowest darts of documents 0..n-1; element, owner, weight: their weighted shingles.

        A document without shingles has zeros. Where a coordinate stays empty
        the document's bound doubles.
        """
        out = np.zeros((n, self.k), np.uint64)
        total = np.bincount(owner, weight, n)
        bound = np.where(total > 0, self.mean / np.maximum(self.k * total, 1e-300), 0.0)
        todo = total > 0
        while todo.any():
            mine = todo[owner]
            darts, ranks, docs = self.thrown(element[mine], owner[mine], weight[mine].astype(np.float64), bound)
            place = docs * self.k + (mix64(darts + np.uint64(3)) % np.uint64(self.k)).astype(np.int64)
            least = np.full(n * self.k, np.inf)
            np.minimum.at(least, place, ranks)
            first = ranks == least[place]
            out.reshape(-1)[place[first]] = darts[first]
            todo &= np.isinf(least).reshape(n, self.k).any(axis=1)
            bound[todo] *= 2
        return out

    def thrown(self, element: np.ndarray, owner: np.ndarray, weight: np.ndarray, bound: np.ndarray):
        """(hash, rank, document) of the darts within the weights and bounds."""
        cells = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
        rows = np.repeat(np.arange(len(element)), cells)
        level = np.arange(len(rows)) - np.repeat(np.cumsum(cells) - cells, cells)
        low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
        rate = self.k * np.where(level == 0, 1.0, low)
        key = mix64(element[rows] + mix64(level.astype(np.uint64) + self.seed))
        reach, heaviest, doc = bound[owner[rows]], weight[rows], owner[rows]
        at, number, step, found = np.zeros(len(rows)), 0, 1, []
        while len(key):
            nth = np.arange(number + 1, number + step + 1, dtype=np.uint64)
            dart = mix64(key[:, None] + np.uint64(0x9E3779B97F4A7C15) * nth)
            rank = at[:, None] + np.cumsum(-np.log1p(-unit(dart)) / rate[:, None], axis=1)
            near = rank < reach[:, None]
            i, j = np.nonzero(near)
            dart, at_rank = mix64(dart[i, j]), rank[i, j]
            inside = low[i] + np.where(low[i] == 0, 1.0, low[i]) * unit(mix64(dart + np.uint64(1))) < heaviest[i]
            found.append((dart[inside], at_rank[inside], doc[i[inside]]))
            on = near[:, -1]
            key, reach, heaviest, doc, low, rate, at = key[on], reach[on], heaviest[on], doc[on], low[on], rate[on], rank[on, -1]
            number, step = number + step, min(step * 2, 64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) keys: hashes of each band's coordinates and its number."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    cut = signatures.reshape(len(signatures), bands, rows)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key.astype(np.int64)


def packed(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 to a 64-bit integer."""
    low = (signatures & np.uint64(3)).reshape(len(signatures), -1, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(low, axis=2).astype(np.int64)


def agreeing(a: Column, b: Column, k: int = FINE) -> Column:
    """In how many of k coordinates two packed signatures agree: those whose two bits are both equal."""

    def differ(x: Column, y: Column) -> Column:
        v = x.bitwiseXOR(y)
        return F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return k - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, n: s + n)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, words, keys): a digest of the document's words and its band keys; null without words."""

    def run(batches):
        darts = Darts(BANDS * ROWS)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i, j in blocks(texts, SHINGLE_BYTES):
                found = shingles_of(texts.slice(i, j - i))
                at = 0
                while at < len(found):
                    element, size, n = [], 0, 0
                    while at + n < len(found) and (size < 150_000 or not n):
                        element.append(np.unique(found[at + n][0]))
                        size += len(element[-1])
                        n += 1
                    signatures = darts.signatures(np.concatenate(element), np.repeat(np.arange(n), [len(e) for e in element]), np.ones(size), n)
                    digest = [d for _, d in found[at : at + n]]
                    keys = pa.array([x if d else None for x, d in zip(band_keys(signatures), digest, strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids.slice(i + at, n), pa.array(digest, pa.binary()), keys], ["doc_id", "words", "keys"])
                    at += n

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, words binary, keys array<bigint>")


def fine_signatures(sets: DataFrame) -> DataFrame:
    """(doc_id, fine): the packed finer signature of each of sets(doc_id, shingles)."""

    def run(batches):
        darts = Darts(FINE, seed=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column("shingles")
                sizes = np.asarray(lists.value_lengths(), np.int64)
                found = darts.signatures(np.asarray(lists.flatten()).astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes), np.ones(int(sizes.sum())), len(sizes))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(packed(found)), pa.list_(pa.int64()))], ["doc_id", "fine"])

    return sets.mapInArrow(run, "doc_id bigint, fine array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, words, shingles): a digest of each document's words and its distinct shingles."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for i, j in blocks(texts, SHINGLE_BYTES // 4):
                found = shingles_of(texts.slice(i, j - i))
                rows = [pa.array([d for _, d in found], pa.binary()), pa.array([np.unique(s).astype(np.int64) for s, _ in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *rows], ["doc_id", "words", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, words binary, shingles array<bigint>")


def narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs(doc_id, ...) without most of the rows whose doc_id isn't in ids(doc_id), and with all whose is; nothing is shuffled but the hashes of ids.

    A bitmap of MAP_BITS hashed ids is broadcast. Where ids are many more than
    its bits it fills up and keeps every row, so an exact join has to follow.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
    return docs.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("bucket")).where(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1).select(*docs.columns)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with their similarity; both sides' shingles meet in two joins, which Spark splits where one document has many pairs.

    Pairs are written first: where they are few, Spark knows so and brings them
    to the sets, and only sets of paired documents are shuffled.
    """
    pairs = written(pairs, "pairs")
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")).join(pairs.select("b"), "b", "left_semi")
    met = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return met.select("a", "b", (shared / (F.size("of_a") + F.size("of_b") - shared)).alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, class_id) of all ends of edges(a, b), the class being the least id that it reaches.

    Large and small stars in turn, each round written out; the number of
    rounds grows with the logarithm of a component's size.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    last = None
    while True:
        # large star: the larger neighbours of a node go to the least of its neighbours and itself
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        dropped(links)
        links = new
        if state == last:
            return links.select(F.col("u").alias("doc_id"), F.col("v").alias("class_id")).unionAll(links.select(F.col("v").alias("doc_id"), F.col("v").alias("class_id")).distinct())
        last = state


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of each row of docs(doc_id, text): the least doc_id that chains of links reach.

    Links join documents of equal words (case and white space aside) and those
    whose shingles' Jaccard similarity is at least ``similarity``. Documents without
    words, null ones among them, are classes of their own, as are rows with a
    null doc_id, whose class is null. Of rows that repeat a doc_id each stands
    in the result; texts of one doc_id are one document, linked by any of them.
    Extra columns are ignored; an empty table gives no rows. The candidates of a pair at the threshold are missed with
    probability (1 - 0.8 ** ROWS) ** BANDS, under 1.2e-4, and dropped before
    verification with one under 1e-4.
    """
    sketches = written(sketched(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))), "sketches")
    known = sketches.where("words is not null and doc_id is not null")
    equal = written(known.groupBy("words").agg(F.min("doc_id").alias("rep")), "equal")
    reps = known.join(equal, (known["words"] == equal["words"]) & (known["doc_id"] == equal["rep"]), "left_semi").dropDuplicates(["doc_id", "words"])
    entries = reps.select("doc_id", F.explode("keys").alias("key"))
    buckets = written(entries.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "buckets")
    members = written(entries.join(buckets, "key"), "members")
    dropped(buckets)
    stars = members.where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    wanted = written(members.select("doc_id").distinct(), "wanted")
    texts = narrowed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), wanted).join(wanted, "doc_id", "left_semi")
    sets = written(shingle_sets(texts).dropDuplicates(["doc_id", "words"]).drop("words"), "sets")
    starred = written(measured(stars, sets), "starred")
    found = components(starred.where(F.col("similarity") >= similarity).select("a", "b"))
    classes = written(wanted.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")
    for turn in range(PIVOTS):
        placed = members.select("key", "doc_id").join(classes, "doc_id")
        pivot = F.min_by(F.struct(F.col("doc_id").alias("b"), F.col("class_id").alias("class_b")), F.struct(F.xxhash64("doc_id", F.lit(turn)), "doc_id"))
        mixed = placed.groupBy("key").agg(pivot.alias("p"), F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("key", "p.*")
        pairs = placed.join(mixed, "key").where("class_id <> class_b").select(F.col("doc_id").alias("a"), "b").distinct()
        classes = _merged(classes, measured(pairs, sets).where(F.col("similarity") >= similarity).select("a", "b"))
    classes = _merged(classes, _across(members, starred, classes, sets, reps.select("doc_id", "keys"), similarity))
    dropped(members, sets, starred)
    # classes of the representatives, then of all rows
    final = equal.join(classes.withColumnRenamed("doc_id", "rep"), "rep", "left").select("words", F.coalesce("class_id", "rep").alias("class_id"))
    return sketches.join(final, "words", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def _merged(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes(doc_id, class_id) after further edges(a, b) between documents."""
    of = lambda side: classes.select(F.col("doc_id").alias(side), F.col("class_id").alias(f"class_{side}"))
    between = written(edges.join(of("a"), "a").join(of("b"), "b").where("class_a <> class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct(), "between")
    if between.isEmpty():
        return classes
    moved = components(between).select(F.col("doc_id").alias("class_id"), F.col("class_id").alias("to"))
    return written(classes.join(moved, "class_id", "left").select("doc_id", F.coalesce("to", "class_id").alias("class_id")), "classes")


def _across(members: DataFrame, starred: DataFrame, classes: DataFrame, sets: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """Further edges(a, b): members of another class than the least of their bucket against the bucket's other classes.

    Distances to the least member lie in cells of the threshold's distance;
    only members of the same or an adjacent cell can be linked. A pair is taken
    in the first bucket that it shares, and if its finer signatures agree in
    LEAST_FINE coordinates: one at the threshold fails that less often than
    once in 10,000 times.
    """
    placed = members.join(classes, "doc_id")
    live = placed.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("key")
    placed = placed.join(live, "key", "left_semi").where("doc_id <> least")
    placed = placed.join(starred.select(F.col("a").alias("doc_id"), F.col("b").alias("least"), (1 - F.col("similarity")).alias("d")), ["doc_id", "least"])
    placed = written(placed.join(classes.select(F.col("doc_id").alias("least"), F.col("class_id").alias("least_class")), "least"), "placed")
    fine = written(fine_signatures(sets.join(placed.select("doc_id").distinct(), "doc_id", "left_semi")), "fine")
    full = placed.withColumn("cell", F.floor(F.col("d") / CELL)).join(keys, "doc_id").join(fine, "doc_id")
    side = lambda end: [F.col(old).alias(new) for old, new in (("doc_id", end), ("class_id", f"class_{end}"), ("d", f"d_{end}"), ("keys", f"keys_{end}"), ("fine", f"fine_{end}"))]
    left = full.where("class_id <> least_class").select("key", *side("a"), F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"))
    right = full.select(F.col("key").alias("key_b"), F.col("cell").alias("cell_b"), *side("b"), F.col("least_class").alias("main_b"))
    near = F.abs(F.col("d_a") - F.col("d_b")) <= 1 - similarity + 1e-9
    once = (F.col("class_b") == F.col("main_b")) | (F.col("a") < F.col("b"))
    first = F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == F.col("key")
    alike = agreeing(F.col("fine_a"), F.col("fine_b")) >= LEAST_FINE
    on = (F.col("key") == F.col("key_b")) & (F.col("cell") == F.col("cell_b")) & (F.col("class_a") != F.col("class_b")) & near & once & first & alike
    pairs = left.join(right, on).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(measured(pairs, sets).where(F.col("similarity") >= similarity).select("a", "b"), "edges")
    dropped(placed, fine)
    return edges


def op8_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the first row of each class. Rows are told apart by number, not by doc_id.

    So rows that repeat a doc_id (or have none) go only if their words are those
    of another row, or nearly. Rows without words, null texts among them, are of
    no class and stay; extra columns stay; an empty table gives no rows.
    """
    rid = "rid_" + uuid.uuid4().hex[:8]
    held = written(docs.withColumn(rid, F.monotonically_increasing_id()), "held")
    classes = near_duplicates(held.select(F.col(rid).alias("doc_id"), "text"))
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(rid))
    return held.join(gone, rid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

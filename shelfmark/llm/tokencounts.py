"""Token counts and ids of whole texts, long ones by overlap resynchronisation.

A long text is cut into chunks that overlap; the chunks are encoded apart, on
any executor, with offsets. A pre-token's start at which two neighbours agree
is a stable boundary, and there they are spliced:

* The pre-tokeniser matches from left to right without looking back, so what
  it finds from a boundary on depends on the text from there only. A chunk
  that starts anywhere is therefore right from the first boundary on that is
  one of the whole text's.
* A chunk that is right so far stays right up to its guard, the last few code
  points: a match looks at most three code points beyond its end, or at the
  whole of a special string.

The first chunk is right from its start, so by induction all chunks are right
from their splice on. Neighbours without a common boundary get a wider
overlap: the earlier one is extended over the whole next chunk and both are
encoded as one, until all splices hold.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.bpe import tokenizer_text
from shelfmark.llm.chunks import encoded_blocks, spaced_pieces
from shelfmark.llm.common import table, written

#: Code points of a chunk, and by how many the next one is overlapped.
CHUNK, OVERLAP = 16_384, 512

#: Pieces of texts that are encoded in one call.
PIECES = 10_000

#: Code points beyond a match that the pre-tokeniser may look at.
LOOKED_AT = 3

_encoders: dict[int, object] = {}


def guard_of(tokenizer_json: str) -> int:
    """Code points at the end of a chunk whose boundaries aren't proven; raises where the proof doesn't hold for the tokenizer."""
    spec = json.loads(tokenizer_json)
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("boundaries are proven for byte-level tokenizers without a normaliser and prefix space only")
    if spec.get("truncation") or spec.get("padding") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
        raise ValueError("truncation, padding and added tokens that hold or take in white space aren't supported")
    return max([0, *(len(t["content"]) for t in spec["added_tokens"])]) + LOOKED_AT


def encoder_of(tokenizer_json: str):
    """The library's encoder of this Python process, on one thread."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders[key] = Tokenizer.from_str(tokenizer_json)
    return _encoders[key]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def boundaries(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin, in code points, and how many tokens stand before each."""
    first = np.flatnonzero(np.diff(np.array(encoding.word_ids, np.int64), prepend=-1))
    offsets = encoding.offsets
    return np.array([offsets[i][0] for i in first.tolist()], np.int64), first


def _cut(docs: DataFrame, shared, chunk: int, overlap: int, with_ids: bool) -> DataFrame:
    """Texts of up to chunk + overlap code points with their tokens, longer ones as chunks with their text.

    A space between two characters that aren't white space begins a pre-token
    always, so short texts are encoded by the distinct pieces between such.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"rid bigint, doc_id {kind}, n_bytes bigint, part bigint, next bigint, begin bigint, own bigint, text string, n_tokens bigint, ids binary"
    kinds = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encoder = to_arrow_schema(kinds), encoder_of(shared.value)

        def encode_pieces(pieces):
            return [packed(e.ids) for i in range(0, len(pieces), PIECES) for e in encoder.encode_batch_fast(pieces[i : i + PIECES], add_special_tokens=False)]

        def rows(columns):
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            rids, ids = batch.column("rid"), batch.column("doc_id")
            texts = pc.fill_null(batch.column("text"), "")
            octets, points = pc.binary_length(texts).cast(pa.int64()), pc.utf8_length(texts)
            small = np.asarray(points) <= chunk + overlap
            short = pa.array(np.flatnonzero(small))
            whole = texts.take(short)
            for i, j, tokens, ends in encoded_blocks(whole, encode_pieces, spaced_pieces):
                at, n = short.slice(i, j - i), j - i
                values = [tokens[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)] if with_ids else [None] * n
                yield rows([rids.take(at), ids.take(at), octets.take(at), [0] * n, [None] * n, [0] * n, points.take(at).cast(pa.int64()), [None] * n, np.diff(ends), values])
            for i in np.flatnonzero(~small).tolist():
                text, size = texts[i].as_py(), points[i].as_py()
                parts = -(-(size - overlap) // chunk)
                for k in range(parts):
                    begin, last = k * chunk, k == parts - 1
                    piece = text[begin:] if last else text[begin : begin + chunk + overlap]
                    yield rows([rids.slice(i, 1), ids.slice(i, 1), octets.slice(i, 1), [k], [None if last else k + 1], [begin], [len(piece) if last else chunk], [piece], [None], [None]])

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, kinds)


def _encoded(chunks: DataFrame, shared, guard: int, overlap: int, with_ids: bool) -> DataFrame:
    """Chunks with their number of tokens, and the boundaries at their start and in what overlaps the next chunk: places in the whole text, and tokens before them."""
    names = ["rid", "part", "next", "n_tokens", "ids", "left_at", "left_n", "right_at", "right_n"]

    def run(batches):
        encoder = encoder_of(shared.value)
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                encoding = encoder.encode(text.as_py(), add_special_tokens=False)
                at, before = boundaries(encoding)
                begin, own, size = batch.column("begin")[k].as_py(), batch.column("own")[k].as_py(), pc.utf8_length(text).as_py()
                left, right = at < overlap, (at >= own) & (at <= size - guard)
                lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (at[left] + begin, before[left], at[right] + begin, before[right])]
                numbers = [pa.array([len(encoding)], pa.int64()), pa.array([packed(encoding.ids) if with_ids else None], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in ("rid", "part", "next")], *numbers, *lists], names)

    lists = ", ".join(f"{c} array<bigint>" for c in names[5:])
    return chunks.select("rid", "part", "next", "begin", "own", "text").repartition("rid", "part").mapInArrow(run, f"rid bigint, part bigint, next bigint, n_tokens bigint, ids binary, {lists}")


def _seams(encoded: DataFrame) -> DataFrame:
    """(rid, part, next, stop, start): the tokens of part that stand before the splice, and the next one's; both null without a common boundary."""
    a = encoded.where("next is not null").select("rid", "part", "next", "right_at", "right_n")
    b = encoded.select("rid", F.col("part").alias("next"), "left_at", "left_n")
    cut = F.array_max(F.array_intersect("right_at", "left_at"))
    tokens = lambda side: F.get(f"{side}_n", (F.array_position(f"{side}_at", F.col("cut")) - 1).cast("int"))
    return a.join(b, ["rid", "next"]).withColumn("cut", cut).select("rid", "part", "next", tokens("right").alias("stop"), tokens("left").alias("start"))


def _widened(chunks: DataFrame, seams: DataFrame) -> DataFrame:
    """The chunks of texts with a seam that doesn't hold; chunks on both sides of such a seam are one. No longer than their text, which was one row."""
    from pyspark.sql import Window

    failing = seams.where("stop is null").select("rid").distinct()
    glued = seams.where("stop is null").select("rid", F.col("next").alias("part"), F.lit(0).alias("opens"))
    order = Window.partitionBy("rid").orderBy("part")
    runs = chunks.select("rid", "part").join(failing, "rid", "left_semi").join(glued, ["rid", "part"], "left")
    runs = runs.select("rid", "part", F.sum(F.coalesce("opens", F.lit(1))).over(order).alias("run"))
    pieces = chunks.join(runs, ["rid", "part"]).groupBy("rid", "run").agg(F.array_sort(F.collect_list(F.struct("part", "next", "begin", "own", "text"))).alias("c"))
    last, inner = F.element_at("c", -1), F.expr("slice(c, 1, size(c) - 1)")
    text = F.concat(F.array_join(F.transform(inner, lambda x: F.substring(x["text"], F.lit(1), x["own"].cast("int"))), ""), last["text"])
    own = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["own"])
    first = F.element_at("c", 1)
    return pieces.select("rid", first["part"].alias("part"), last["next"].alias("next"), first["begin"].alias("begin"), own.alias("own"), text.alias("text"))


def _resynchronised(docs: DataFrame, path: str, chunk: int, overlap: int, with_ids: bool) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The table of _cut(), and (chunks encoded, seams that all hold) of each round; a text's chunks are in one round's."""
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is at least 1 and no longer than a chunk")
    text = tokenizer_text(path)
    guard, shared = guard_of(text), docs.sparkSession.sparkContext.broadcast(text)
    cut = written(_cut(docs, shared, chunk, overlap, with_ids), "cut")
    chunks, rounds = cut.where("text is not null").select("rid", "part", "next", "begin", "own", "text"), []
    while not chunks.isEmpty():
        encoded = written(_encoded(chunks, shared, guard, overlap, with_ids), "chunks")
        seams = written(_seams(encoded), "seams")
        failed = seams.where("stop is null")
        if failed.isEmpty():
            rounds.append((encoded, seams))
            break
        rid = failed.select("rid").distinct()
        rounds.append((encoded.join(rid, "rid", "left_anti"), seams.join(rid, "rid", "left_anti")))
        chunks = written(_widened(chunks, seams), "widened")
    return cut, rounds


def counted(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of docs(doc_id, text), whatever its length.

    ``path`` names a byte-level tokenizer's JSON file. Null text counts as
    empty, which has no tokens; rows that repeat, or share a doc_id, stand
    each; further columns are left out; an empty table gives no rows. A text
    without any boundary, such as one word of a million letters, ends up as
    one chunk.
    """
    cut, rounds = _resynchronised(docs, path, chunk, overlap, False)
    whole = cut.where("text is null").select("doc_id", "n_bytes", "n_tokens")
    if not rounds:
        return whole
    shares = None
    for encoded, seams in rounds:
        own = encoded.where("next is null").select("rid", "n_tokens").unionByName(seams.select("rid", (F.col("stop") - F.col("start")).alias("n_tokens")))
        shares = own if shares is None else shares.unionByName(own)
    sums = shares.groupBy("rid").agg(F.sum("n_tokens").alias("n_tokens"))
    heads = cut.where("text is not null and part = 0").select("rid", "doc_id", "n_bytes")
    return whole.unionByName(heads.join(sums, "rid").select("doc_id", "n_bytes", "n_tokens"))


def token_parts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(rid, doc_id, part, ids): each row's ids as little-endian 32-bit integers, those of a long text in several parts in ascending order.

    rid tells rows apart that share a doc_id. Nulls and odd rows as in
    counted(); a part may be empty.
    """
    cut, rounds = _resynchronised(docs, path, chunk, overlap, True)
    out = cut.where("text is null").select("rid", "doc_id", "part", "ids")
    heads = cut.where("text is not null and part = 0").select("rid", "doc_id")
    for encoded, seams in rounds:
        starts = seams.select("rid", F.col("next").alias("part"), "start")
        own = encoded.join(starts, ["rid", "part"], "left").join(seams.select("rid", "part", "stop"), ["rid", "part"], "left")
        start, stop = F.coalesce("start", F.lit(0)), F.coalesce("stop", "n_tokens")
        ids = F.substring("ids", (4 * start + 1).cast("int"), (4 * (stop - start)).cast("int"))
        out = out.unionByName(own.withColumn("ids", ids).join(heads, "rid").select("rid", "doc_id", "part", "ids"))
    return out


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Tokens beyond which a document is over the limit.
LIMIT = 1024


def op12_overlap_token_counts(spark, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"), byte_bpe_path()).withColumn("over_limit", F.col("n_tokens") > LIMIT)

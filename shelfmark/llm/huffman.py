"""Token ids as binary output: canonical length-limited Huffman codes in independent blocks.

Written are three tables under one path. ``code`` holds the code length of
each id, from counts over all documents. ``blocks`` holds, in ascending
doc_id order, blocks of whole documents: their ids and numbers of tokens, the
place of the block in its part, and a payload. ``parts`` holds how many tokens
stand before each part. A payload is, little-endian: the magic ``HUF1``, the
number of symbols n (u32), the checkpoint interval k (u32), the bit offset of
every k-th symbol (u64 each), and the code bits, high bit first. Blocks decode
independently of each other; within one, all checkpoint segments advance
together through one table look-up a symbol. Spark's committed Parquet files
carry the payloads, so retried and speculative tasks leave no torn blocks.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.bpe import byte_characters, tokenizer_text, word_bpe_path
from shelfmark.llm.chunks import encoded_blocks
from shelfmark.llm.common import dropped, new_path, table, written

MAGIC = b"HUF1"
END_ID = 1
#: Symbols between checkpoints, symbols from which a block closes, and the longest code where the alphabet allows.
CHECKPOINT_EVERY, BLOCK_SYMBOLS, LONGEST_CODE = 128, 1 << 18, 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, masks = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        sort = np.argsort(both, kind="stable")
        row = both[sort]
        masks.append(sort < len(leaves))
    take = 2 * len(leaves) - 2
    for mask in reversed(masks):
        k = int(mask[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ascending by length, then by id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            last = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


class Huffman:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical(lengths)
        self.bits = int(lengths.max(initial=1))
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.step = np.ones(1 << self.bits, np.int64)
        at = 0
        for i in np.lexsort((np.arange(len(lengths)), lengths)):
            if lengths[i]:
                width = 1 << (self.bits - int(lengths[i]))
                self.symbol[at : at + width], self.step[at : at + width] = i, lengths[i]
                at += width

    def encode(self, ids: np.ndarray, every: int = CHECKPOINT_EVERY) -> bytes:
        width = self.lengths[ids]
        ends = np.cumsum(width)
        begins = ends - width
        total = int(ends[-1]) if len(ids) else 0
        words = total // 32 + 2
        shifted = self.codes[ids] << (64 - width - (begins & 31)).astype(np.uint64)
        at = begins >> 5
        # no two codes share a bit, so sums are unions, and exact as they stay below 2 ** 32
        packed = np.bincount(at, (shifted >> np.uint64(32)).astype(np.float64), words) + np.bincount(at + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
        bits = packed.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8]
        return MAGIC + struct.pack("<II", len(ids), every) + begins[::every].astype("<u8").tobytes() + bits

    def decode(self, payload: bytes) -> np.ndarray:
        if payload[:4] != MAGIC:
            raise ValueError("not a block of Huffman codes")
        n, every = struct.unpack_from("<II", payload, 4)
        marks = -(-n // every)
        at = np.frombuffer(payload, "<u8", marks, 12).astype(np.int64)
        bits = payload[12 + 8 * marks :] + bytes(8)
        windows = np.ndarray((len(bits) - 3,), ">u4", bits, strides=(1,))
        out = np.zeros((every, marks), np.uint32)
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        short = n - every * (marks - 1)  # symbols of the last segment
        for k in range(min(every, n)):
            live = at if k < short else at[: marks - 1]
            if not len(live):
                break
            code = (windows[live >> 3].astype(np.int64) >> (shift - (live & 7))) & mask
            out[k, : len(live)] = self.symbol[code]
            live += self.step[code]
        return out.T.reshape(-1)[:n]


#: A word of letters with punctuation behind it; the tokenizer cuts between the two.
STEM = re.compile(r"[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=([.,;:!?*$%&#]*)$)")


class LibraryEncoder:
    """Encodes chunks with the tokenizers library, on one thread, each distinct lower-cased word once.

    Letters and the punctuation behind them are different pre-tokens and the
    tokenizer lower-cases, so a chunk's ids are its word's and its mark's; a
    word is one pre-token, which goes to the library's model as its bytes.
    Chunks of any other shape are given to the library as they are.
    """

    #: Words kept between batches.
    limit = 500_000

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(tokenizer_json)
        self.splits = '"Lowercase"' in json.dumps(spec["normalizer"]) and "\\p{L}" in json.dumps(spec["pre_tokenizer"])
        self.shown = str.maketrans({chr(i): c for i, c in enumerate(byte_characters())})
        self.known: dict[str, bytes] = {}

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        parts, stems = [], set()
        match, add = STEM.match, stems.add
        for c in chunks:
            m = match(c) if self.splits else None
            if m:
                w = m[0].lower()
                add(w)
                parts.append((w, m[1]))
            else:
                parts.append((c, ""))
        known = self.known
        new = list({w for p in parts for w in p if w not in known})
        if "" in new:
            new.remove("")
        known[""] = b""
        words = [w for w in new if w in stems]
        model = self.tokenizer.model.tokenize
        for w in words:
            known[w] = array("I", [t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(self.shown))]).tobytes()
        others = [w for w in new if w not in stems]
        for i in range(0, len(others), 50_000):
            part = others[i : i + 50_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()
        out = [known[w] + known[mark] if mark else known[w] for w, mark in parts]
        if len(known) > self.limit:
            self.known = {}
        return out


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(tokenizer_json: str) -> LibraryEncoder:
    """The encoder of this Python process, which keeps its caches between tasks."""
    key = hashlib.md5(tokenizer_json.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = LibraryEncoder(tokenizer_json)
    return _encoders[key]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids, counts) of docs(doc_id, text), end_id appended; ids are 16-bit if the vocabulary allows, else 32-bit.

    Null text is empty. A last row of each task has null ids, and counts: how
    often each id stands in the rows before, as 64-bit integers.
    """
    text = tokenizer_text(path)
    shared = docs.sparkSession.sparkContext.broadcast(text)
    width, size = id_width(text, end_id), vocabulary_size(text, end_id)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids", "counts"]

    def run(batches):
        encoder, total = library_encoder(shared.value), np.zeros(size, np.int64)
        for batch in batches:
            for i, j, ids, ends in encoded_blocks(batch.column("text"), encoder.encode_chunks):
                n = j - i
                # an end id behind each document
                ids = np.insert(ids.astype(width), ends[1:], end_id)
                ends = ends + np.arange(n + 1)
                total += np.bincount(ids, minlength=size)
                step = ids.itemsize
                rows = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((ends * step).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(np.diff(ends)), rows.cast(pa.binary()), pa.nulls(n, pa.binary())], names)
        doc_id = batch.column("doc_id").type if "batch" in locals() else pa.int64()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_id), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, counts binary")


def vocabulary_size(tokenizer_json: str, end_id: int = END_ID) -> int:
    spec = json.loads(tokenizer_json)
    return max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1


def id_width(tokenizer_json: str, end_id: int = END_ID) -> str:
    return "<u2" if vocabulary_size(tokenizer_json, end_id) <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; at most ``size`` rows reach the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])

    found = tokens.where("counts is not null").select("counts").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes the ids of every document under path, in ascending doc_id order (null first; equal ids by length and content)."""
    spark, text = docs.sparkSession, tokenizer_text(tokenizer)
    size, width = vocabulary_size(text, end_id), id_width(text, end_id)
    tokens = written(tokenized(docs, tokenizer, end_id), "tokens")
    lengths = code_lengths(id_counts(tokens, size))
    spark.createDataFrame([(bytearray(lengths.tobytes()), width)], "lengths binary, width string").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths.tobytes())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, block int, start_in_part bigint, doc_ids array<{kind}>, n_tokens array<bigint>, payload binary"
    item = pa.int64() if kind == "bigint" else None

    def run(batches):
        code, part = Huffman(np.frombuffer(shared.value, np.uint8)), TaskContext.get().partitionId()
        block, start, ids, rows, n = 0, 0, [], [], 0

        def closed():
            out = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(item) if item else None), pa.array([[len(r) for r in rows]], pa.list_(pa.int64())), pa.array([code.encode(np.concatenate(rows))], pa.binary())]
            return pa.RecordBatch.from_arrays(out, ["part", "block", "start_in_part", "doc_ids", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids.append(doc_id)
                rows.append(np.frombuffer(x.as_buffer(), width).astype(np.int64))
                n += len(rows[-1])
                if n >= BLOCK_SYMBOLS:
                    yield closed()
                    block, start, ids, rows, n = block + 1, start + n, [], [], 0
        if rows:
            yield closed()

    ordered = tokens.where("ids is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids").select("doc_id", "ids")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(tokens)
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, n: s + n)).alias("n")).orderBy("part").collect()
    before = np.cumsum([0, *(r["n"] for r in sums)])  # one row a part
    spark.createDataFrame([(r["part"], int(b)) for r, b in zip(sums, before, strict=False)], "part int, tokens_before long").coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str, columns: str = "ids binary", of_ids=lambda ids: (ids.astype("<u4").tobytes(),)) -> DataFrame:
    """(doc_id, start, n_tokens, ...) of each document written under path; of_ids makes the further columns of its ids."""
    stored = spark.read.parquet(f"{path}/blocks")
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])
    before = {r["part"]: r["tokens_before"] for r in spark.read.parquet(f"{path}/parts").collect()}
    shared = spark.sparkContext.broadcast((lengths, before))
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    schema = spark.createDataFrame([], f"doc_id {kind}, start bigint, n_tokens bigint, {columns}").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        lengths, before = shared.value
        code, arrow = Huffman(np.frombuffer(lengths, np.uint8)), to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                symbols = code.decode(row["payload"])
                stops = np.cumsum(row["n_tokens"])
                starts = stops - np.array(row["n_tokens"])
                more = [of_ids(symbols[i:j]) for i, j in zip(starts, stops, strict=True)]
                values = [row["doc_ids"], (starts + row["start_in_part"] + before[row["part"]]).tolist(), row["n_tokens"], *zip(*more, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return stored.mapInArrow(run, schema)


def op1_huffman_token_file(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "huffman")
    write_ids(table(spark, sf_dir, "documents"), word_bpe_path(), path)
    return read_ids(spark, path, "ids_crc32 bigint", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))

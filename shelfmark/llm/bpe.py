"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a block stand one behind the other in a symbol array.
An index maps the rank of each mergeable pair to all its positions. Ranks are
taken in ascending order; a rank's positions that still hold its pair are
merged, and the pairs that this makes with their neighbours are entered in the
lists of their own ranks, which are all higher.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.chunks import encoded_blocks
from shelfmark.llm.common import table

#: Positions from which a rank is merged by array operations.
MANY = 24

#: Words whose ids are kept between the batches of a task.
WORDS_KEPT = 300_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(plain)))
    return [shown[b] for b in range(256)]


class BpeCodec:
    """Encodes as the tokenizers library does for a lower-casing byte-level BPE file with word ends."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.tokens = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.size = len(self.tokens)
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = [vocab[a] for a, _ in merges]
        self.right = [vocab[b] for _, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        created = {t: r for r, t in enumerate(self.made)}
        if len(created) < len(merges) or any(created.get(t, -1) >= r for side in (self.left, self.right) for r, t in enumerate(side)):
            raise ValueError("a pair ranks before the merge that makes one of its tokens")
        keys = np.array(self.left, np.int64) * self.size + np.array(self.right, np.int64)
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.rank = {int(k): r for r, k in enumerate(keys)}
        self.normalise = Tokenizer.from_str(tokenizer_json).normalizer.normalize_str
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(pattern).findall
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 where they don't merge."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        stop = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        octets = np.frombuffer(b"".join(raw), np.uint8)
        n = len(octets)
        sym = np.empty(n + 1, np.int32)
        sym[:n] = self.inner[octets]
        sym[stop - 1] = self.last[octets[stop - 1]]
        sym[n] = -1  # beyond both ends of each word
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[stop - 1] = n
        before[stop[:-1]] = n
        before[0] = before[n] = n
        after[n] = n

        ranks = self.ranks_of(sym[:n], sym[after[:n]])
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        first = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        where: dict[int, list | np.ndarray] = defaultdict(list)
        starts = dict(zip(ranks[order[first]].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))

        s, a_, b_ = memoryview(sym), memoryview(after), memoryview(before)
        rank, size = self.rank, self.size
        for r in range(len(self.made)):
            found = where.pop(r, None)
            if r in starts:
                i, j = starts[r]
                found = order[i:j] if not found else np.concatenate([order[i:j], np.array(found, np.int64)])
            if found is None:
                continue
            x, y, new = self.left[r], self.right[r], self.made[r]
            if x != y and len(found) >= MANY:
                p = np.asarray(found)
                q = after[p]
                ok = (sym[p] == x) & (sym[q] == y)
                p, q = p[ok], q[ok]
                m = after[q]
                sym[p], sym[q] = new, -2
                after[p] = m
                before[m] = p
                before[n] = n
                lefts = before[p]
                at = np.concatenate([lefts, p[sym[m] != new]])
                made = self.ranks_of(sym[at], sym[after[at]])
                hit = made >= 0
                for k, v in zip(made[hit].tolist(), at[hit].tolist(), strict=True):
                    where[k].append(v)
                continue
            for p in sorted(found.tolist() if isinstance(found, np.ndarray) else found):
                q = a_[p]
                if s[p] != x or s[q] != y:
                    continue
                m, l = a_[q], b_[p]
                s[p], s[q] = new, -2
                a_[p] = m
                if m != n:
                    b_[m] = p
                    if (k := rank.get(new * size + s[m])) is not None:
                        where[k].append(p)
                if l != n and (k := rank.get(s[l] * size + new)) is not None:
                    where[k].append(l)
        alive = sym[:n] >= 0
        ids = sym[:n][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive)[stop - 1] * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, which hold no ASCII white space."""
        plain = [c for c in chunks if c.isascii() and "<|" not in c]
        others = [c for c in chunks if not (c.isascii() and "<|" not in c)]
        words = {c: [w] if (w := c.lower()).isalpha() else self.words_of(w) for c in plain}
        easy = [c for c in others if not (self.special_split and self.special_split.search(c))]
        normal = self.normalise("\x00".join(easy)).split("\x00") if easy else []
        if len(normal) != len(easy):
            normal = [self.normalise(c) for c in easy]
        words |= {c: [w] if w.isalpha() else self.words_of(w) for c, w in zip(easy, normal, strict=True)}
        for c in others:
            if c not in words:
                words[c] = [p if p in self.special else w for p in self.special_split.split(c) if p for w in ([p] if p in self.special else self.words_of(self.normalise(p)))]
        known = self.words
        new = list({w for ws in words.values() for w in ws if w not in known})
        known.update(zip(new, self.encode_words(new), strict=True))
        for t, i in self.special.items():
            known[t] = np.uint32(i).astype("<u4").tobytes()
        out = [known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws)) for ws in map(words.__getitem__, chunks)]
        if len(known) > WORDS_KEPT:
            self.words = {}
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
        """(begin, end, ids of each text as little-endian 32-bit integers) of ranges of texts."""
        for begin, end, ids, ends in encoded_blocks(texts, self.encode_chunks):
            raw, ends = ids.tobytes(), (ends * 4).tolist()
            yield begin, end, [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the tokens with spaces between, special ones included."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, BpeCodec] = {}


def codec_of(tokenizer_json: str) -> BpeCodec:
    """The codec of this Python process; its tables stay for the tasks to come."""
    key = hashlib.md5(tokenizer_json.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = BpeCodec(tokenizer_json)
    return _codecs[key]


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(docs: DataFrame, path: str, columns: str, of_text) -> DataFrame:
    """docs(doc_id, text) to doc_id and columns; of_text(codec, ids) gives the values of a text. The file, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))
    frame = docs.select("doc_id", "text")
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, {columns}"
    kinds = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        codec, arrow = codec_of(shared.value), to_arrow_schema(kinds)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i, j, encoded_texts in codec.encode(texts):
                rows = [of_text(codec, x) for x in encoded_texts]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *[pa.array(v, arrow.field(k + 1).type) for k, v in enumerate(zip(*rows, strict=True))]], schema=arrow)
        codec.words = {}  # other operators may run in this process next

    return frame.mapInArrow(run, kinds)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text): ids as little-endian 32-bit integers; null and empty texts have none."""
    return _mapped(docs, path, "ids binary", lambda codec, ids: (ids,))


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of tokens(doc_id, ids); null ids decode to an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def run(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            texts = [codec.decode(x or b"").decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs; null text counts as empty, rows that repeat stand each."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda codec, ids: (len(ids) // 4, sha(ids), sha(codec.decode(ids))))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_pair_index_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), word_bpe_path())


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: doc_id, the ids of the whole text, and their number.

    Null and empty texts have no ids, texts of any length are encoded whole,
    rows that repeat stand each, further columns are left out, and an empty
    table gives no rows.
    """
    return encoded(docs, word_bpe_path()).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))

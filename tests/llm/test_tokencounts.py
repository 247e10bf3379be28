"""Token counts of texts in overlapping chunks against the library on the whole text."""

import random
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import bpe, queries, tokencounts

PIECES = ["a", "b c", "  ", "\n\n", " \t ", "'s", "'re'", "12", "<|endoftext|>", "<|endof", "é", "😀", " word", "!!", "　", "x" * 40]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokencounts.byte_bpe_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    odd = ["", None, "abc", "x" * 3000, " " * 2500, "ab " * 900, "<|endoftext|>" * 60, "'" * 700 + "re" * 300]
    return odd + ["".join(rng.choices(PIECES, k=rng.randint(50, 900))) for _ in range(30)]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 32), (200, 40), (1000, 1000)])
def test_spliced_chunks(spark, library, texts, chunk, overlap):
    # doc_ids repeat, and an extra column has the name of one of the result
    docs = spark.createDataFrame([(i % 30, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    path = tokencounts.byte_bpe_path()
    found = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokencounts.counted(docs, path, chunk, overlap).collect())
    assert found == sorted((i % 30, len((t or "").encode()), len(ids_of(library, t))) for i, t in enumerate(texts))
    parts = defaultdict(list)
    for r in tokencounts.token_parts(docs, path, chunk, overlap).collect():
        parts[r["rid"], r["doc_id"]].append((r["part"], bytes(r["ids"])))
    whole = sorted((i, b"".join(x for _, x in sorted(v))) for (_, i), v in parts.items())
    assert whole == sorted((i % 30, np.array(ids_of(library, t), "<u4").tobytes()) for i, t in enumerate(texts))
    assert max(map(len, parts.values())) > 3


def test_overlaps_widen_where_nothing_aligns(spark, texts):
    docs = spark.createDataFrame([(0, "x" * 900), (1, "one two three " * 80)], "doc_id long, text string")
    cut, rounds = tokencounts._resynchronised(docs, tokencounts.byte_bpe_path(), 100, 50, False)
    assert cut.where("text is not null").groupBy("doc_id").count().where("count > 5").count() == 2
    assert len(rounds) == 2 and rounds[1][0].count() == 1  # the long word is one chunk in the end
    assert all(seams.where("stop is null").count() == 0 for _, seams in rounds)


def test_query(spark, tiny, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.QUERIES["op12_overlap_token_counts"](spark, tiny).collect()}
    assert found == {i: (len(t.encode()), n := len(ids_of(library, t)), n > 1024) for i, t in rows.items()}


def test_empty_tables_and_other_tokenizers(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert tokencounts.counted(none, tokencounts.byte_bpe_path()).count() == 0
    assert tokencounts.token_parts(none, tokencounts.byte_bpe_path()).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        tokencounts.counted(none, bpe.word_bpe_path())
    with pytest.raises(ValueError, match="overlap"):
        tokencounts.counted(none, tokencounts.byte_bpe_path(), 10, 20)


def test_pieces_make_the_whole_text(texts):
    import pyarrow as pa

    from shelfmark.llm.chunks import spaced_pieces

    array = pa.array([*texts, " a b", "a b ", " ", "é a b é", "x  y z"])
    for part in (array, array.slice(3, 20), array.slice(1, 1), pa.array([], pa.string())):
        pieces, numbers, places = spaced_pieces(part)
        assert ["".join(pieces[k] for k in numbers[a:b]) for a, b in zip(places, places[1:], strict=False)] == [t or "" for t in part.to_pylist()]
    assert {" b", "x  y", " z"} <= set(spaced_pieces(array)[0])

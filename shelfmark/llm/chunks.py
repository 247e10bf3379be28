"""Encoding texts by way of their distinct chunks between ASCII white space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Bytes of text whose distinct chunks are found together, and bytes of text whose ids are laid out together.
WIDE_BYTES, BLOCK_BYTES = 32_000_000, 4_000_000


def distinct_chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(chunks, numbers, offsets): the distinct chunks, the chunk at each place of all texts, and where each text begins and ends.

    Chunks end at space and 09 to 0D; empty ones may be among them. Null
    texts count as empty.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(pa.concat_arrays([texts]).cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(np.asarray(split.value_lengths(), np.int64))])
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int32), offsets


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As distinct_chunks(), in UTF-8 and without the empty chunk at white space on the edge of a text: bytes.split() of each text."""
    chunks, numbers, offsets = distinct_chunks(texts)
    words = [c.encode() for c in chunks]
    if b"" in words:
        empty, last = words.index(b""), len(words) - 1
        real = numbers != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        numbers = numbers[real]
        words[empty] = words[last]
        numbers = np.where(numbers == last, empty, numbers)
        words.pop()
    return words, numbers, offsets


def spaced_pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As distinct_chunks(), for pieces that together are the whole text: it is cut before each space between two ASCII characters that aren't white space."""
    whole = pc.fill_null(pa.concat_arrays([texts]).cast(pa.large_string()), "")
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    octets = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.empty(0, np.uint8)
    plain = (octets > 0x20) & (octets < 0x7F)
    cuts = np.flatnonzero((octets[1:-1] == 0x20) & plain[:-2] & plain[2:]) + 1 if len(octets) > 2 else []
    bounds = np.union1d(ends, np.asarray(cuts, np.int64)[np.asarray(cuts, np.int64) > ends[0]])
    coded = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), data]).dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int32), np.searchsorted(bounds, ends)


def encoded_blocks(texts: pa.Array, encode: Callable[[list[str]], list[bytes]], split=distinct_chunks) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, ids, offsets) of ranges of texts: the ids of their texts one behind the other, and where each text's begin and end.

    ``encode`` gets the distinct chunks of WIDE_BYTES of text at a time, and
    returns the ids of each as little-endian 32-bit integers.
    """
    for i, j in blocks(texts, WIDE_BYTES):
        wide = texts.slice(i, j - i)
        chunks, numbers, places = split(wide)
        ids = encode(chunks)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        del ids, chunks
        begins = np.cumsum(sizes) - sizes
        for k, m in blocks(wide, BLOCK_BYTES):
            own = numbers[places[k] : places[m]]
            length = sizes[own]
            ends = np.concatenate([[0], np.cumsum(length)])
            at = np.arange(ends[-1]) + np.repeat(begins[own] - ends[:-1], length)
            yield i + k, i + m, flat[at], ends[places[k : m + 1] - places[k]]


def blocks(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most_bytes together; one text at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield begin, stop
        begin = stop

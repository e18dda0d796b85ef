"""Texts of an Arrow batch as byte arrays: words and their codes without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once, so that memory doesn't follow the batch size.
AT_ONCE = 2 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def slices(batch: pa.RecordBatch, text: str, size: int = AT_ONCE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive parts of a batch with about ``size`` bytes of text each (one row at least), and their text without
    nulls."""
    texts = pc.fill_null(batch.column(text).cast(pa.string()), "")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a), pa.concat_arrays([texts.slice(a, b - a)])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each one starts (one more entry than texts)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    got = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return got[at[0]: at[-1]], at - at[0]


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings that lie in ``data`` without gaps."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def ink_spans(ink: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every run of marked bytes within a text, and the number of runs of each text."""
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    begin, end = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]]
    first[begin] = ink[begin]
    last[end - 1] = ink[end - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    edges = np.searchsorted(starts, at)
    return starts, ends, np.diff(edges)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and the number of words of each text."""
    return ink_spans(~BLANK[data], at)


def word_codes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of every word, the distinct words that the codes number, and the number of words of each text."""
    data, at = raw(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, counts = word_spans(data, at)
    coded = strings(data[~BLANK[data]], ends - starts).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, counts

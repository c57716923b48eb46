"""Vectorised words and word shingles of whole texts, for Arrow batches inside tasks.

A batch is cut into chunks of about a megabyte of text, so that the arrays of one step stay small
whatever the batch size; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def keys(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers of a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = keys(11, 256)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SHINGLE = keys(23, 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs of bytes that are neither a blank nor one of tab to carriage return.
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII digits, lower-case ASCII letters and all bytes of non-ASCII characters.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch holding about ``limit`` bytes of text each (at least one row)."""
    n = batch.num_rows
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts in a row (a null is an empty text), and where each text starts (n + 1 offsets)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return flat, offsets - offsets[0]


def lowered(flat: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[flat]


def word_bounds(flat: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the first word of each text (n + 1 offsets). Words end with their text."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    inside = is_word[flat]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = starts[(starts > 0) & (starts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, starts)


def hash_spans(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    sizes = last - first
    heads = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(heads[-1]) - np.repeat(heads[:-1], sizes)
    power = np.multiply.accumulate(np.full(int(sizes.max()), _STEP, dtype=np.uint64))
    values = _BYTE[flat[place + np.repeat(first, sizes)]] * power[place]
    return mix(np.add.reduceat(values, heads[:-1]) + sizes.astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside each text, and their offsets by text.

    A text of 1 to n - 1 words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(made)])
    if not offsets[-1]:
        return np.zeros(0, dtype=np.uint64), offsets
    if len(words) >= n:
        runs = words[: len(words) - n + 1] * _SHINGLE[0]
        for k in range(1, n):
            runs = runs + words[k : len(words) - n + 1 + k] * _SHINGLE[k]
    else:
        runs = np.zeros(0, dtype=np.uint64)
    out = np.empty(offsets[-1], dtype=np.uint64)
    at = np.repeat(bounds[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    full = np.repeat(counts >= n, made)
    out[full] = mix(runs[at[full]])
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[bounds[i] : bounds[i + 1]]
        out[offsets[i]] = mix((own * _SHINGLE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + _SHINGLE[n + len(own)])[0]
    return out, offsets


def shingle_sets(texts: pa.Array, n: int, is_word: np.ndarray = BLANK_SEPARATED) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, starts = flat_bytes(texts)
    flat = lowered(flat)
    first, last, bounds = word_bounds(flat, starts, is_word)
    out, offsets = shingles(hash_spans(flat, first, last), bounds, n)
    return [np.unique(out[offsets[i] : offsets[i + 1]]) for i in range(len(starts) - 1)]

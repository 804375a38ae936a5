"""Words and their hashes over Arrow string buffers, without a Python object for each word.

A text column's bytes are one flat array; words are spans of it.  A span's hash takes its bytes eight at a time, for all
spans side by side.  All functions work on slices of a few MB so that memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once.
SLICE = 2 << 20

#: Odd multipliers for sequences of words and those of the 64-bit finaliser.
WORD_BASE = 0xC2B2AE3D27D4EB4F
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Spans longer than this are hashed one by one.
LONG_SPAN = 256

#: True for space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Masks of the first 0 to 8 bytes of eight.
TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_A)
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(33)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes of text, one row at least."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the len + 1 offsets of its rows; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a row's end, and each run's row."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    outside = ~inside
    begins = inside.copy()
    begins[1:] &= cut[1:n] | outside[:-1]
    ends = inside.copy()
    ends[:-1] &= cut[1:n] | outside[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; different seeds give independent ones.

    Eight bytes at a time go through the finaliser, so that spans of one length up to eight bytes never collide, and
    longer ones by chance alone.  Spans beyond ``LONG_SPAN`` bytes are digested by XXH3.
    """
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64((seed + 1) * MIX_B % (1 << 64)))
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    for at in range(0, LONG_SPAN, 8):
        if not len(left):
            break
        some = eight[start[left] + at]
        some &= TAIL[np.minimum(size[left] - at, 8)]
        out[left] = mix((out[left] ^ some) + np.uint64(at + 1))
        left = left[size[left] > at + 8]
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair of hashes; with one of them fixed, different others never collide."""
    return mix(a * np.uint64(WORD_BASE) + mix(b ^ np.uint64(MIX_A)))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive hashes: the first half's and the second half's, as a pair."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    if k == 1:
        return words
    half = k // 2
    front = run_hashes(words, k - half)
    back = front if 2 * half == k else run_hashes(words, half)
    n = len(words) - k + 1
    return pair_hashes(front[:n], back[k - half :][:n])


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) over each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width and len(out):
        step = min(have, width - have)
        out = best(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes that aren't ASCII white space."""
    return spans(~SPACE[data], offsets)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The given spans of each row joined by one space: bytes and offsets."""
    size = end - start
    more = np.zeros(len(start), np.int64)
    more[:-1] = row[1:] == row[:-1]
    total = size + more
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.full(at[-1], 0x20, np.uint8)
    step = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    here = np.arange(int(size.sum()))
    out[step + here] = data[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + here]
    counts = np.bincount(row, total, rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
    return out, np.concatenate([[0], np.cumsum(counts)])

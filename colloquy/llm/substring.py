"""Exact substring deduplication by level-wise doubling.

A word is removed if a window of ``window`` consecutive words covers it whose word sequence also starts earlier (in a
document with a smaller doc_id, or earlier in the same one).  Levels: the sequences of a base length are counted at every
position, and those that are repeated alone are extended to twice that length and counted again, until the window's
length is reached or no candidate survives (20 words: 5, 10, 20).  A level keeps the stretches in which every sequence of its
length is repeated, if they are as long as a window.  At the last level the first place of each window decides.

Scale: see ``exchange``: a level shuffles four bytes for each distinct sequence of a unit, and bits come back; each level
sends what the one before it has left.  Texts are copied once, into units, and joined to the first level's replies and
to the final cuts by unit.  Nothing is keyed by a document, a passage or a window, so no group of copies meets in one task.

Hashes: the levels before the last only leave out what can't be repeated, so their four bytes and a bucket's leading bits
lose nothing by a collision.  The last compares 96 bits.

Defined cases: a null text has no words; a null doc_id comes before all others; rows with one doc_id are ordered by a hash of
their words, and rows equal in both are one document (they keep the same words); documents shorter than a window keep
everything; an empty table gives an empty one; other input columns pass through ``dedup`` unchanged.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .bytewords import flat, joined, mix, run_hashes, span_hashes, spaced_words
from .exchange import bucket_bits, cuts, exchanged, masked, numbers, packed, read_numbers, repeated_in_bucket, replies_of, units, unpacked
from .shared import Scratch, has

WINDOW = 20
#: The base length is the window's, halved while that is even and this long at least.
LEAST = 5
#: Comes before every doc_id.
NULL_ID = -(1 << 63)
#: Fixed value: what makes a window's second hash differ from its first.
SECOND = 0x9E3779B97F4A7C15
OUTPUT = [StructField("_colloquy_words", LongType()), StructField("_colloquy_removed", LongType()), StructField("_colloquy_sha", StringType()), StructField("_colloquy_kept", StringType())]


def levels(window: int) -> list[int]:
    """Lengths from the base to the window, each twice the one before."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= LEAST:
        out.insert(0, out[0] // 2)
    return out


class Stretches(NamedTuple):
    """Stretches of a unit's words; one row each, and their words one after the other."""

    at: np.ndarray  # the first word's number in the unit
    lo: np.ndarray  # and in its document
    doc: np.ndarray
    key: np.ndarray  # 32 bits of a hash of the document's words
    size: np.ndarray
    words: np.ndarray  # a hash of each word

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def body(self) -> bytes:
        return packed(pa.RecordBatch.from_arrays([*(pa.array(x) for x in self[:5]), pa.array([self.words.tobytes()] + [None] * (len(self.size) - 1), pa.binary())], list(self._fields)))


def whole(body: bytes) -> Stretches:
    """A unit's documents."""
    part = unpacked(body)
    data, at = flat(part.column("text"))
    start, end, row = spaced_words(data, at)
    words = span_hashes(data, start, end)
    size = np.bincount(row, minlength=part.num_rows)
    first = np.cumsum(size) - size
    key = np.array([xxhash.xxh3_64_intdigest(words[a : a + n].tobytes()) >> 32 for a, n in zip(first.tolist(), size.tolist(), strict=True)], np.int64)
    return Stretches(first, np.zeros(len(size), np.int64), np.asarray(part.column("doc_id").cast(pa.int64()).fill_null(NULL_ID)), key, size, words)


def stretches(body: bytes) -> Stretches:
    part = unpacked(body)
    return Stretches(*(np.asarray(part.column(n)) for n in Stretches._fields[:5]), np.frombuffer(part.column("words")[0].as_buffer(), np.uint64))


def sequences(s: Stretches, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the sequences of so many words inside a stretch, and their hashes."""
    row = s.row()
    at = np.flatnonzero(row[: max(0, len(row) - length + 1)] == row[length - 1 :])
    return at, run_hashes(s.words, length)[at]


def narrowed(s: Stretches, at: np.ndarray, repeated: np.ndarray, length: int, window: int) -> Stretches | None:
    """The stretches, as long as a window at least, all of whose sequences of this length are repeated."""
    row = s.row()
    at = at[repeated]
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at))) + length - 1
    begin, size = at[begin][size >= window], size[size >= window]
    if not len(begin):
        return None
    of = row[begin]
    inside = begin - (np.cumsum(s.size) - s.size)[of]
    words = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return Stretches(s.at[of] + inside, s.lo[of] + inside, s.doc[of], s.key[of], size, s.words[words])


def level(made: DataFrame, opened, length: int, window: int, bits: int, scratch: Scratch) -> DataFrame:
    """unit, body: what is left of each unit's stretches at this length."""

    def send(body):
        _, keys = sequences(opened(body), length)
        keys = np.unique(keys)
        short = (keys << np.uint64(bits) >> np.uint64(32)).astype("<u4")
        return [(bucket, short[a:b].tobytes()) for bucket, a, b in cuts(keys, bits)]

    def run(batches):
        for batch in batches:
            for unit, body, replies in zip(batch.column("unit").to_pylist(), batch.column("body"), batch.column("replies"), strict=True):
                s = opened(body.as_py())
                at, hashes = sequences(s, length)
                keys, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
                left = narrowed(s, at, ((counts > 1) | masked(keys, bits, replies_of(replies)))[place], length, window)
                if left is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([left.body()], pa.binary())], ["unit", "body"])

    replied = scratch.write(exchanged(made, send, repeated_in_bucket), "replies")
    scratch.free()
    return made.select("unit", "body").join(replied, "unit", "left").mapInArrow(run, "unit long, body binary")


ENTRY = np.dtype([("first", "<u8"), ("second", "<u4"), ("doc", "<i8"), ("key", "<i8"), ("lo", "<i8")])


def message_of(entries: np.ndarray) -> bytes:
    return b"".join([*(numbers(entries[c]) for c in ("doc", "key", "lo")), entries["first"].tobytes(), entries["second"].tobytes()])


def entries_of(message: bytes) -> np.ndarray:
    at, columns = 0, []
    for _ in range(3):
        x, at = read_numbers(message, at)
        columns.append(x)
    out = np.empty(len(columns[0]), ENTRY)
    out["doc"], out["key"], out["lo"] = columns
    out["first"] = np.frombuffer(message, "<u8", len(out), at)
    out["second"] = np.frombuffer(message, "<u4", len(out), at + 8 * len(out))
    return out


def windows(s: Stretches, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The unit's windows in order of hashes and place: their words' places and entries; each one's group; which begin one."""
    at, hashes = sequences(s, window)
    row = s.row()[at]
    entries = np.empty(len(at), ENTRY)
    entries["first"], entries["second"] = hashes, run_hashes(mix(s.words ^ np.uint64(SECOND)), window)[at] >> np.uint64(32)
    entries["doc"], entries["key"] = s.doc[row], s.key[row]
    entries["lo"] = s.lo[row] + at - (np.cumsum(s.size) - s.size)[row]
    order = np.lexsort((entries["lo"], entries["key"], entries["doc"], entries["second"], entries["first"]))
    at, entries = at[order], entries[order]
    head = np.ones(len(at), bool)
    head[1:] = (entries["first"][1:] != entries["first"][:-1]) | (entries["second"][1:] != entries["second"][:-1])
    return at, entries, np.cumsum(head) - 1, np.flatnonzero(head)


def same_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] == b["doc"]) & (a["key"] == b["key"]) & (a["lo"] == b["lo"])


def later_in_bucket(messages: list[bytes], senders: list[int]) -> list[bytes | None]:
    """Which of the windows sent (each unit's first of its kind) aren't the first of all."""
    parts = [entries_of(m) for m in messages]
    every = np.concatenate(parts)
    order = np.lexsort((every["lo"], every["key"], every["doc"], every["second"], every["first"]))
    ordered = every[order]
    head = np.ones(len(every), bool)
    head[1:] = (ordered["first"][1:] != ordered["first"][:-1]) | (ordered["second"][1:] != ordered["second"][:-1])
    flag = np.zeros(len(every), bool)
    flag[order] = ~same_place(ordered, ordered[np.flatnonzero(head)[np.cumsum(head) - 1]])
    return [np.packbits(f).tobytes() if f.any() else None for f in np.split(flag, np.cumsum([len(p) for p in parts])[:-1])]


def decided(made: DataFrame, opened, window: int, bits: int, scratch: Scratch) -> DataFrame:
    """unit, gone: numbers of the unit's words at which windows begin that start earlier elsewhere."""

    def send(body):
        _, entries, _, head = windows(opened(body), window)
        entries = entries[head]
        return [(bucket, message_of(entries[a:b])) for bucket, a, b in cuts(entries["first"], bits)]

    def run(batches):
        for batch in batches:
            for unit, body, replies in zip(batch.column("unit").to_pylist(), batch.column("body"), batch.column("replies"), strict=True):
                s = opened(body.as_py())
                at, entries, group, head = windows(s, window)
                later = masked(entries["first"][head], bits, replies_of(replies))[group] | ~same_place(entries, entries[head][group])
                row = s.row()[at[later]]
                gone = np.sort(s.at[row] + at[later] - (np.cumsum(s.size) - s.size)[row])
                if len(gone):
                    yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([gone.astype("<i4").tobytes()], pa.binary())], ["unit", "gone"])

    replied = scratch.write(exchanged(made, send, later_in_bucket), "replies")
    scratch.free()
    return made.select("unit", "body").join(replied, "unit", "left").mapInArrow(run, "unit long, gone binary")


def cut(rows: DataFrame, schema: StructType, window: int) -> DataFrame:
    """The units' rows with OUTPUT: number of words, of words removed, digest of the kept ones, and these if any was removed."""

    def run(batches):
        for batch in batches:
            for body, gone in zip(batch.column("body"), batch.column("gone"), strict=True):
                part = unpacked(body.as_py())
                data, at = flat(part.column("text"))
                start, end, row = spaced_words(data, at)
                marks = np.zeros(len(start) + 1, np.int64)
                if gone.is_valid:
                    begin = np.frombuffer(gone.as_buffer(), "<i4")
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + window, -1)
                kept = np.cumsum(marks)[:-1] == 0
                out, ends = joined(data, start[kept], end[kept], row[kept], part.num_rows)
                out = out.tobytes()
                pieces = [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                removed = np.bincount(row[~kept], minlength=part.num_rows)
                columns = [
                    pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int64)),
                    pa.array(removed.astype(np.int64)),
                    pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()),
                    pa.array([p.decode() if n else None for p, n in zip(pieces, removed.tolist(), strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *(f.name for f in OUTPUT)])

    return rows.mapInArrow(run, StructType([*schema.fields, *OUTPUT]))


def marked(docs: DataFrame, window: int) -> DataFrame:
    """``docs`` (doc_id a long) with OUTPUT."""
    has(docs, "doc_id", "text")
    if window < 1:
        raise ValueError("a window has a word at least")
    scratch = Scratch(docs.sparkSession, "substring")
    made = scratch.write(units(docs), "units")
    bits = bucket_bits((made.agg(F.sum("bytes")).first()[0] or 0) // 5)
    left, opened = made, whole
    for length in levels(window)[:-1]:
        after = scratch.write(level(left, opened, length, window, bits, scratch), f"level{length}")
        if left is not made:
            scratch.drop(left)
        scratch.free()
        left, opened = after, stretches
        if left.isEmpty():
            break
    gone = scratch.write(decided(left, opened, window, bits, scratch), "gone")
    if left is not made:
        scratch.drop(left)
    scratch.free()
    return cut(made.join(gone, "unit", "left").select("body", "gone"), docs.schema, window)


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, sha256 of the kept words joined by one space, and ``kept``, these words, null where nothing
    is removed; one row for each row of ``docs``."""
    has(docs, "doc_id", "text")
    out = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    names = dict(zip((f.name for f in OUTPUT), ("n_words", "n_removed", "sha256", "kept"), strict=True))
    return out.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()])


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; n_chars, where it is there, is counted anew.

    A text that loses nothing stays byte for byte; of one that does, the kept words are joined by one space.  A document
    of which no word is left goes.  Rows keep their own cuts, whatever doc_id they have.
    """
    out = marked(docs, window).filter("_colloquy_kept is null or _colloquy_kept <> ''")
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.coalesce("_colloquy_kept", "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("_colloquy_kept").isNull(), F.col("n_chars")).otherwise(F.length("_colloquy_kept").cast(kind))
    return out.select(*[c.alias(n) for n, c in columns.items()])


def op9_substring(spark, sf_dir: str) -> DataFrame:
    out = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20)
    return out.select("doc_id", "n_words", "n_removed", F.col("sha256").alias("kept_sha256"))

"""Facts about the hashes of a whole corpus, without a row for each hash.

Rows are held in units, each a few hundred KB of text in one row.  A unit sends its distinct hashes, in order, as one array
for each bucket (the hashes with the same leading bits) that it has any of.  The task of a bucket sees all its arrays and
answers each of them with one reply, and the replies of all buckets go back to their units.

Scale: a hash is sent once a unit, however often it occurs there, so one that is in every text of a hot group costs its
bucket an entry a unit.  Buckets are as many as make about ``BUCKET`` hashes each, so what a task holds doesn't follow the
size of the corpus; with ever more buckets an array comes down to single hashes, and costs what a shuffled row costs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import slices

#: Bytes of text in a unit, one text at least, and hashes in a bucket, about.
UNIT, BUCKET = 1 << 20, 1 << 20
UNITS = "unit long, bytes long, body binary"


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def units(docs: DataFrame, size: int = UNIT) -> DataFrame:
    """unit, bytes of text, body: the rows of ``docs`` in units, with all their columns; ``unit`` is unique in one job."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", size):
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column("text").nbytes]), pa.array([packed(part)], pa.binary())], ["unit", "bytes", "body"])

    return docs.mapInArrow(run, UNITS)


def bucket_bits(hashes: int) -> int:
    """Leading bits that divide so many hashes into buckets."""
    return max(6, (max(1, hashes) // BUCKET).bit_length())


def cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that the sorted hashes fall into."""
    bucket = keys >> np.uint64(64 - bits)
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def exchanged(made: DataFrame, send: Callable[[pa.RecordBatch | bytes], Iterator[tuple[int, bytes]]], answer: Callable[[list[bytes], list[int]], list[bytes | None]], others: DataFrame | None = None) -> DataFrame:
    """unit, replies (array of (bucket, reply)) for each unit that got any.

    ``send`` gives (bucket, message) for a unit's body; ``answer`` gets the messages of one bucket with their units, and
    gives a reply, or None, to each.  ``others`` are messages (bucket, unit, message) from elsewhere, with units below 0.
    """

    def sent(batches):
        for batch in batches:
            for unit, body in zip(batch.column("unit").to_pylist(), batch.column("body"), strict=True):
                got = list(send(body.as_py()))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([unit] * len(got)), pa.array([m for _, m in got], pa.binary())], ["bucket", "unit", "message"])

    def answered(batches):
        bucket, messages, senders = None, [], []

        def replies():
            got = [(u, bucket, r) for u, r in zip(senders, answer(messages, senders), strict=True) if r is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["unit", "bucket", "reply"])

        for batch in batches:
            for b, unit, message in zip(batch.column("bucket").to_pylist(), batch.column("unit").to_pylist(), batch.column("message").to_pylist(), strict=True):
                if b != bucket and messages:
                    yield from replies()
                    messages, senders = [], []
                bucket = b
                messages.append(message)
                senders.append(unit)
        if messages:
            yield from replies()

    rows = made.select("unit", "body").mapInArrow(sent, "bucket int, unit long, message binary")
    rows = rows if others is None else rows.union(others.select("bucket", "unit", "message"))
    replied = rows.repartition("bucket").sortWithinPartitions("bucket", "unit").mapInArrow(answered, "unit long, bucket int, reply binary")
    return replied.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias("replies"))


def numbers(x: np.ndarray) -> bytes:
    """Whole numbers as their least and the differences from it, in as few bytes each as these take."""
    least = int(x.min()) if len(x) else 0
    most = int(x.max()) - least if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return struct.pack("<qBI", least, width, len(x)) + (x.astype(np.int64).view(np.uint64) - np.uint64(least % (1 << 64))).astype(f"<u{width}").tobytes()


def read_numbers(message: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers that begin at this byte, and where they end."""
    least, width, n = struct.unpack_from("<qBI", message, at)
    at += struct.calcsize("<qBI")
    return (np.frombuffer(message, f"<u{width}", n, at).astype(np.uint64) + np.uint64(least % (1 << 64))).view(np.int64), at + n * width


def repeated_in_bucket(messages: list[bytes], senders: list[int]) -> list[bytes | None]:
    """For messages of four-byte hashes: which of each are in another message too, as bits; None where none is."""
    parts = [np.frombuffer(m, "<u4") for m in messages]
    ends = np.cumsum([len(p) for p in parts])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    same = ordered[1:] == ordered[:-1]
    flag = np.zeros(len(every), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return [np.packbits(f).tobytes() if f.any() else None for f in np.split(flag, ends[:-1])]


def masked(keys: np.ndarray, bits: int, replies: dict[int, bytes]) -> np.ndarray:
    """The bits that the replies give for a unit's sorted hashes; none where a bucket gave no reply."""
    out = np.zeros(len(keys), bool)
    for bucket, a, b in cuts(keys, bits):
        if (reply := replies.get(bucket)) is not None:
            out[a:b] = np.unpackbits(np.frombuffer(reply, np.uint8), count=b - a)
    return out


def replies_of(scalar) -> dict[int, bytes]:
    """The replies of one row of a joined column, by bucket."""
    return {r["bucket"]: r["reply"] for r in scalar.as_py() or []}


def values_of(message: bytes, at: int, columns: int) -> list[np.ndarray]:
    """So many lists of numbers from this byte on."""
    out = []
    for _ in range(columns):
        x, at = read_numbers(message, at)
        out.append(x)
    return out


def looked_up(made: DataFrame, keys_of: Callable[[bytes], np.ndarray], table: DataFrame, key: str, columns: list[str], bits: int) -> DataFrame:
    """unit, replies: which of a unit's hashes (``keys_of`` its body: sorted, each once) are in the table under ``key``, a
    column of hashes that doesn't repeat, and the whole numbers that ``columns`` have there; see ``received``."""

    def send(body):
        keys = keys_of(body)
        return [(bucket, keys[a:b].tobytes()) for bucket, a, b in cuts(keys, bits)]

    def stock(batches):
        for batch in batches:
            keys = np.asarray(batch.column(key)).view(np.uint64)
            order = np.argsort(keys)
            keys, values = keys[order], [np.asarray(batch.column(c))[order] for c in columns]
            rows = [(bucket, -1, b"".join([numbers(keys[a:b].view(np.int64)), *(numbers(v[a:b]) for v in values)])) for bucket, a, b in cuts(keys, bits)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "unit", "message"])

    def answer(messages, senders):
        stocked = [values_of(m, 0, 1 + len(columns)) for m, u in zip(messages, senders, strict=True) if u < 0]
        if not stocked:
            return [None] * len(messages)
        known, *values = (np.concatenate(c) for c in zip(*stocked, strict=True))
        known = known.view(np.uint64)
        order = np.argsort(known)
        known, values = known[order], [v[order] for v in values]
        out = []
        for m, u in zip(messages, senders, strict=True):
            if u < 0:
                out.append(None)
                continue
            asked = np.frombuffer(m, "<u8")
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = known[at] == asked
            out.append(np.packbits(hit).tobytes() + b"".join(numbers(v[at[hit]]) for v in values))
        return out

    return exchanged(made, send, answer, table.select(key, *columns).mapInArrow(stock, "bucket int, unit long, message binary"))


def received(keys: np.ndarray, bits: int, replies: dict[int, bytes], columns: int) -> list[np.ndarray]:
    """The columns' values for a unit's sorted hashes, 0 for those that the table doesn't have."""
    out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
    for bucket, a, b in cuts(keys, bits):
        if (reply := replies.get(bucket)) is not None:
            size = -(-(b - a) // 8)
            hit = a + np.flatnonzero(np.unpackbits(np.frombuffer(reply, np.uint8, size), count=b - a))
            for column, x in zip(out, values_of(reply, size, columns), strict=True):
                column[hit] = x
    return out

"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a grey-scale PNG, ``WIDTH`` 8-bit samples a row, under the SHA-256 of its samples; a tar shard holds
many, and a row holds digest, shard, offset and length, never the payload.  Metadata columns come from ranges of a few
dozen bytes at an object's beginning; features come from the whole stored object, read back and decoded.

Scale: a task writes its own shards in the shared folder, under names of its own, and a payload that it meets again only
once; no text is shuffled.  Where several tasks store one payload, the catalogue refers to one of the copies, and only that
one is read.  Readers take a shard's objects in the order of their offsets and join neighbours in one read.  Shards go
through pyarrow's file systems, so the shared folder may be local to all, HDFS or an object store.  A task that is run
again writes other files; those of the failed attempt are referred to by nothing.

Defined cases: a null text is an empty payload, and payloads are padded with zeros to a positive multiple of ``WIDTH``;
texts of equal payload share an object; a null doc_id and equal rows are kept as they are; an empty table writes nothing
and gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import flat, slices
from .shared import Scratch, has, shared_path

#: Samples in a row of an image.
WIDTH = 64
#: Bytes of a shard, about; bytes that are read at once.
SHARD, READ = 64 << 20, 4 << 20
LEVEL = 6
#: Fixed values of the format: the signature, and the bytes that hold it and the header chunk.
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33
STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: np.ndarray) -> bytes:
    rows = payload.reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = rows
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))
    return SIGNATURE + head + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from an object's first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> np.ndarray:
    width, height, _ = png_header(data)
    at, body = len(SIGNATURE), b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged image")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:]


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class Shards:
    """Writes objects into tar files below a folder, and says where they are."""

    def __init__(self, folder: str):
        self.files, self.base = file_system(folder)
        self.folder, self.name, self.out, self.at = folder, None, None, 0
        self.known: dict[str, tuple[str, int, int]] = {}

    def put(self, digest: str, make) -> tuple[str, int, int]:
        if digest not in self.known:
            data = make()
            if self.out is None or self.at + len(data) > SHARD:
                self.close()
                self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
                self.files.create_dir(self.base, recursive=True)
                self.out = self.files.open_output_stream(f"{self.base}/{self.name}")
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.known[digest] = (self.name, self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.known[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes (unpadded), digest, shard, offset, length for each row of (doc_id, text); writes when it is run."""
    has(docs, "doc_id", "text")

    def run(batches):
        shards = Shards(folder)
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = flat(part.column("text"))
                rows = []
                for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                    padded = np.zeros(max(WIDTH, -(-(b - a) // WIDTH) * WIDTH), np.uint8)
                    padded[: b - a] = data[a:b]
                    digest = hashlib.sha256(padded).hexdigest()
                    rows.append((b - a, digest, *shards.put(digest, lambda p=padded: to_png(p))))
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)


def catalogue(stored: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one copy of each payload."""
    one = F.min(F.struct("shard", "offset", "length"))
    return stored.groupBy("digest").agg(one.alias("at")).select("digest", "at.shard", "at.offset", "at.length")


def ranges(batch: pa.RecordBatch, files, base: str, size):
    """(row, bytes) for each row: the first ``size`` bytes of its object, or all where that is None; in order of place."""
    shard, offset, length = (batch.column(c).to_pylist() for c in ("shard", "offset", "length"))
    order = sorted(range(batch.num_rows), key=lambda i: (shard[i], offset[i]))
    i = 0
    while i < len(order):
        first = order[i]
        with files.open_input_file(f"{base}/{shard[first]}") as f:
            while i < len(order) and shard[order[i]] == shard[first]:
                if size is not None:
                    yield order[i], f.read_at(size, offset[order[i]])
                    i += 1
                    continue
                j, begin = i, offset[order[i]]
                while j < len(order) and shard[order[j]] == shard[first] and offset[order[j]] + length[order[j]] - begin <= READ:
                    j += 1
                j = max(j, i + 1)
                data = f.read_at(offset[order[j - 1]] + length[order[j - 1]] - begin, begin)
                for k in order[i:j]:
                    yield k, data[offset[k] - begin : offset[k] - begin + length[k]]
                i = j


def in_order(objects: DataFrame) -> DataFrame:
    return objects.repartition("shard").sortWithinPartitions("shard", "offset")


def headers(objects: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits of each (digest, shard, offset, length); reads headers only."""

    def run(batches):
        files, base = file_system(folder)
        for batch in batches:
            got = dict(ranges(batch, files, base, HEADER))
            columns = zip(*(png_header(got[i]) for i in range(batch.num_rows)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(c, pa.int64()) for c in columns)], ["digest", "width", "height", "bits"])

    return in_order(objects).mapInArrow(run, "digest string, width long, height long, bits long")


def feature(samples: np.ndarray) -> str:
    """Shape, sum, number of distinct samples, sum of steps between neighbours in a row, and a digest of the histogram."""
    counts = np.bincount(samples.ravel(), minlength=256)
    steps = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum())
    return f"{samples.shape[1]}x{samples.shape[0]} sum={int(samples.sum(dtype=np.int64))} distinct={int((counts > 0).sum())} steps={steps} histogram={zlib.crc32(counts.astype('<i8').tobytes()):08x}"


def features(objects: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes of each (digest, shard, offset, length) say, read back whole."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        files, base = file_system(folder)
        for batch in batches:
            rows, digests = [], batch.column("digest").to_pylist()
            for i, data in ranges(batch, files, base, None):
                samples = from_png(data)
                payload = samples.tobytes()
                rows.append((digests[i], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
                if rows[-1][2] != digests[i]:
                    raise ValueError(f"{digests[i]}: the stored payload has another digest")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return in_order(objects).mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media(spark, sf_dir: str) -> DataFrame:
    scratch, folder = Scratch(spark, "media"), shared_path(spark, "media")
    stored = scratch.write(store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), "rows")
    objects = scratch.write(catalogue(stored), "catalogue")
    found = scratch.write(features(objects, folder), "features")
    shape = scratch.write(headers(objects, folder).withColumnRenamed("digest", "_digest"), "headers")
    known = scratch.write(found.join(shape, F.col("digest") == F.col("_digest")).drop("_digest").withColumnRenamed("digest", "_digest"), "known")
    out = stored.join(known, F.col("digest") == F.col("_digest"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length")

"""Token ids in files of canonical, length-limited Huffman codes.

Counts over the whole corpus give every id a code length of at most ``LIMIT`` bits (package-merge); codes are canonical,
so the lengths alone are the code book.  Documents stand in ascending doc_id order.  A file is a list of blocks of whole
documents; a block decodes by itself.  Its payload is one bit string, most significant bit first, and every
``CHECKPOINT`` ids it notes the bit offset, so that all stretches of a block are decoded side by side by one table look-up
an id.  A file is one Parquet file, one row for each block:

    file, block          place in the order of files and blocks
    doc_ids, sizes       the documents and their numbers of ids
    offsets              the first checkpoint's bit offset (0), then the bits to each next one
    payload              the bits, padded with zeros to a byte

and the code book is a table beside them: (id, bits).

Scale: texts are read and tokenized once, and the ids, not the texts, are shuffled once by ranges of doc_id that come from
the doc_ids alone; counts, encoding and decoding work on each file as it stands.  The code book is bounded by the
vocabulary.  Where a document stands in the whole is a prefix sum over files.  There are at most
``FILES`` files, so what the driver holds of them is bounded.  The files belong to whoever asked for them and stay.

Defined cases: a null text is empty and holds the end id alone; a null doc_id comes first; rows that repeat a doc_id are
stored side by side, ordered by their ids' bytes; an empty table gives empty files; a document longer than a block has a
block of its own; other input columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import flat
from .shared import Scratch, has, shared_path
from .tokens import encoded, tokenizer_path

END_ID = 2
#: Bits of the longest code; the decoding table has 2**LIMIT entries.
LIMIT = 18
#: Ids in a block, about, and between two checkpoints.
BLOCK, CHECKPOINT = 1 << 18, 128
#: Bytes of text in a file, about, and files at most: beyond, files grow, and the driver's list of them doesn't.
FILE_BYTES, FILES = 32 << 20, 1 << 15
BLOCK_TYPE = "file int, block int, doc_ids array<long>, sizes array<long>, offsets array<int>, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for counts > 0, by package-merge; 0 for counts of 0."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    # Level by level the items are the leaves and the pairs of the level below; only leaves' ranks need be kept.
    levels, below = [], np.zeros(0)
    for _ in range(limit):
        packages = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        below = both[order]
    take = 2 * len(used) - 2
    lengths = np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: by length, then by id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for size in np.unique(lengths[order]):
        same = order[lengths[order] == size]
        code <<= int(size) - last
        codes[same] = np.arange(code, code + len(same), dtype=np.uint64)
        code, last = code + len(same), int(size)
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each ``limit`` leading bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spread = 1 << (limit - lengths[order])
    ids, bits = np.repeat(order, spread), np.repeat(lengths[order], spread)
    rest = (1 << limit) - len(ids)
    return np.append(ids, np.zeros(rest, np.int64)).astype(np.uint16), np.append(bits, np.ones(rest, np.int64)).astype(np.uint8)


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of the ids, and the bit offset of each."""
    size = lengths[ids]
    to = np.cumsum(size)
    at = to - size
    total = int(to[-1]) if len(to) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    where, room = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    if len(ids):
        first = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
        words[where[first]] = np.add.reduceat(head, first)
        over = np.flatnonzero(room < 0)  # one id at most crosses into each word
        words[where[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.byteswap().tobytes()[: -(-total // 8)], at


def unpack_bits(payload: bytes, starts: np.ndarray, count: int, ids_of: np.ndarray, bits_of: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """``count`` ids; all stretches from one checkpoint to the next are decoded in step."""
    data = np.frombuffer(payload + bytes(8), np.uint8)
    out = np.zeros((len(starts), CHECKPOINT), np.uint16)
    at = starts.astype(np.int64)
    left = np.minimum(count - np.arange(len(starts)) * CHECKPOINT, CHECKPOINT)
    shift = np.int64(32 - limit)
    bytes_ = data.astype(np.int64)
    four = bytes_[:-3] << 24 | bytes_[1:-2] << 16 | bytes_[2:-1] << 8 | bytes_[3:]
    for step in range(int(left.max()) if len(left) else 0):
        live = left > step if step >= left[-1] else slice(None)
        place = at[live]
        byte = place >> 3
        # 18 bits from any bit of a byte are within four bytes.
        window = (four[byte] >> (shift - (place & 7))) & ((1 << limit) - 1)
        out[live, step] = ids_of[window]
        at[live] = place + bits_of[window]
    return out.ravel()[:count] if len(starts) == 0 or left[-1] == CHECKPOINT else np.concatenate([out[:-1].ravel(), out[-1, : left[-1]]])


def ranges(docs: DataFrame) -> list[int]:
    """doc_ids at which new files begin: as many files as the texts' bytes ask for, from doc_ids alone."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = min(FILES, max(1, -(-int(total) // FILE_BYTES)))
    if files == 1:
        return []
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / files for i in range(1, files)], 0.1 / files)
    return sorted({int(c) for c in cuts})


def tokenized(docs: DataFrame, path: str, spaced: bool, end: int, cuts: list[int]) -> DataFrame:
    """file, doc_id, ids (little-endian 16-bit) in files by ranges of doc_id, each in ascending order."""

    def run(batches):
        for part, ids, ends in encoded(batches, path, spaced, end):
            raw = ids.astype("<u2").tobytes()
            doc = part.column("doc_id")
            known = np.asarray(doc.fill_null(-(1 << 63)))
            file = np.searchsorted(cuts, known, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(file), doc, pa.array([raw[2 * a : 2 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], ["file", "doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file int, doc_id long, ids binary")
    return rows.repartitionById(len(cuts) + 1, "file").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")


def id_counts(tokens: DataFrame, vocabulary: int = 1 << 16) -> np.ndarray:
    def run(batches):
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            counts += np.bincount(flat(batch.column("ids"))[0].view("<u2"), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        out[r.id] = r.n
    return out


def blocks(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Each file's documents in coded blocks."""

    def run(batches):
        codes = canonical(lengths)
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        file, number, held = None, 0, 0

        def block():
            ids = np.concatenate(parts)
            payload, at = pack_bits(ids, codes, lengths)
            offsets = np.diff(at[::CHECKPOINT], prepend=0).astype(np.int32)
            row = {"file": [file], "block": [number], "doc_ids": [docs], "sizes": [[len(p) for p in parts]], "offsets": [offsets.tolist()], "payload": [payload]}
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for f, d, i in zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(i.as_buffer(), "<u2").copy()
                if parts and (f != file or held + len(ids) > BLOCK):
                    yield block()
                    number = number + 1 if f == file else 0
                    docs, parts, held = [], [], 0
                file = f
                docs.append(d)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield block()

    return tokens.mapInArrow(run, BLOCK_TYPE)


def write(docs: DataFrame, path: str, tokenizer: str, spaced: bool = False, end: int = END_ID) -> None:
    """Writes the documents' ids: coded files below ``path``/blocks and the code book at ``path``/codes."""
    has(docs, "doc_id", "text")
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    docs = docs.select("doc_id", "text")
    tokens = scratch.write(tokenized(docs, tokenizer, spaced, end, ranges(docs)), "ids")
    scratch.free()
    lengths = code_lengths(id_counts(tokens))
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1)
    book.write.parquet(f"{path}/codes")
    blocks(tokens, lengths).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    scratch.drop(tokens)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_TYPE).parquet(f"{path}/blocks")


def decoder(spark: SparkSession, path: str):
    """Batches of blocks to batches of their documents, as ``read`` gives them; to be run in the tasks."""
    lengths = np.zeros(1 << 16, np.int64)
    for r in spark.read.schema("id int, bits int").parquet(f"{path}/codes").collect():
        lengths[r.id] = r.bits

    def run(batches):
        ids_of, bits_of = decoding_table(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                doc, sizes = row.column("doc_ids").flatten(), np.asarray(row.column("sizes").flatten())
                starts = np.cumsum(np.asarray(row.column("offsets").flatten()).astype(np.int64))
                ids = unpack_bits(row.column("payload")[0].as_py(), starts, int(sizes.sum()), ids_of, bits_of)
                raw, ends = ids.astype("<u2").tobytes(), np.concatenate([[0], np.cumsum(sizes)])
                n = len(sizes)
                columns = [doc, row.column("file").take(pa.array([0] * n)), row.column("block").take(pa.array([0] * n)), pa.array(np.arange(n, dtype=np.int32)), pa.array(sizes)]
                columns.append(pa.array([raw[2 * a : 2 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "block", "place", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, block, place (in the block), n_tokens, ids (16-bit, little-endian) for each document stored."""
    return stored(spark, path).mapInArrow(decoder(spark, path), "doc_id long, file int, block int, place int, n_tokens long, ids binary")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """file, block, start: the ids of all documents before each block."""
    sizes = stored(spark, path).select("file", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    files = sizes.groupBy("file").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each file
    files = files.select(F.col("file").alias("_file"), before.alias("_before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select("file", "block", inside.alias("_in"))
    return placed.join(files, F.col("file") == F.col("_file")).select("file", "block", (F.col("_before") + F.col("_in")).alias("start"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, from the files alone.

    The task that decodes also digests: one ``mapInArrow`` after another would take two Python workers a core, which stay
    with their tables for the queries that follow.
    """
    documents = decoder(spark, path)

    def run(batches):
        for batch in documents(batches):
            crc = [zlib.crc32(np.frombuffer(i.as_buffer(), "<u2").astype("<u4").tobytes()) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "block", "place", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "file", "block", "place", "n_tokens", "ids_crc32"])

    rows = stored(spark, path).mapInArrow(run, "doc_id long, file int, block int, place int, n_tokens long, ids_crc32 long")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = starts(spark, path).select(F.col("file").alias("_f"), F.col("block").alias("_b"), "start")
    rows = rows.withColumn("_in", before).join(first, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return rows.select("doc_id", (F.col("start") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path("word_bpe_49k.json"))
    return digests(spark, path)

"""Document quality from random-indexing word vectors and a two-layer network with calibrated probabilities.

Every word has a sparse random index vector, drawn from its hash; its word vector is the sum of the index vectors of its
neighbours over the whole corpus.  A document is the mean and the spread of its words' vectors.  A two-layer network on
these is fitted on labelled rows, and its temperature on labelled rows kept apart from the fit.

Scale: word vectors live in ``BUCKETS`` rows by the hash of the word, so that their table has one size (4 MB) for any
corpus.  Words of one row share the sum of their neighbours' index vectors, which are each word's own; the README says what
that costs.  Sums are of whole numbers, the same in any order.  Tasks add up their own table and ship its rows once each.  The network is fitted on the driver on at most
``FIT_ROWS`` labelled documents (those whose doc_id hashes lowest).  Texts are read twice and never shuffled.

Defined cases: null and empty texts are documents without words, with all-zero features, and get the network's score for
these; rows without a label, or with a null one, only add to the word vectors; a doc_id labelled twice counts as good if
any of its labels is, and of rows with one labelled doc_id one is learned from; with no labels, or only one kind, all scores are the share of good labels (0.5 without any); a null
doc_id is scored and can't be labelled; equal rows get equal scores; an empty table gives an empty one; other input
columns pass through ``filter_quality`` and are ignored by ``scores``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACE, flat, mix, slices, span_hashes, spans
from .shared import has, ship

#: Rows and columns of the table of word vectors, and ones in an index vector.
BUCKETS, WIDTH, ONES = 1 << 14, 64, 2
#: Neighbours to either side; distances at which a document's words are compared.
REACH, LAGS = 2, 2
#: Labelled documents that the network is fitted on, at most.
FIT_ROWS = 20_000
#: A document with a lower score is rejected.
ACCEPT = 0.3
HIDDEN, EPOCHS, BATCH, SEED = 48, 40, 256, 7
#: Words whose vectors are gathered at once.
STEP = 1 << 15

#: 0 for white space, 1 for bytes of words, 2 for punctuation.
KIND = np.where(SPACE, 0, 2)
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of each word and each run of punctuation, in order."""
    kind = KIND[data]
    a, b = spans(kind == 1, offsets), spans(kind == 2, offsets)
    start, row = np.concatenate([a[0], b[0]]), np.concatenate([a[2], b[2]])
    end = np.concatenate([a[1], b[1]])
    order = np.argsort(start, kind="stable")
    return span_hashes(data, start[order], end[order]), row[order]


def bucket_of(word: np.ndarray) -> np.ndarray:
    return (word % np.uint64(BUCKETS)).astype(np.int64)


def index_vectors(word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and signs of the ONES ones in each word's index vector, drawn from its hash."""
    drawn = [mix(word + np.uint64(SEED + k)) for k in range(ONES)]
    return [((h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)) for h in drawn]


def rows_of(table: np.ndarray) -> pa.RecordBatch:
    """The rows of whole numbers that aren't all zero."""
    used = np.flatnonzero(table.any(1))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([table[i].tobytes() for i in used], pa.binary())], ["bucket", "vector"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors by bucket, from all texts: BUCKETS x WIDTH."""

    def add_up(batches):
        table = np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            for part in slices(batch, "text"):
                word, row = tokens(*flat(part.column("text")))
                place, drawn = bucket_of(word) * WIDTH, index_vectors(word)
                for far in range(1, REACH + 1):
                    near = np.flatnonzero(row[far:] == row[:-far]) if len(row) > far else np.zeros(0, np.int64)
                    for a, b in ((near, near + far), (near + far, near)):
                        for position, sign in drawn:
                            table += np.bincount(place[a] + position[b], sign[b], BUCKETS * WIDTH)
        yield rows_of(table.reshape(BUCKETS, WIDTH).astype("<i8"))

    def total(batches):
        table = np.zeros((BUCKETS, WIDTH), np.int64)
        for batch in batches:
            np.add.at(table, np.asarray(batch.column("bucket")), np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i8").reshape(-1, WIDTH))
        yield rows_of(table)

    kind = "bucket int, vector binary"
    rows = docs.select("text").mapInArrow(add_up, kind).repartition("bucket").mapInArrow(total, kind).collect()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for r in rows:
        out[r.bucket] = np.frombuffer(r.vector, "<i8")
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each row the mean and standard deviation of its word vectors, and how alike words one and two apart are.

    A row's sums run over it from its start in steps that don't depend on the rows around it.
    """
    word, row = tokens(data, offsets)
    word, rows = bucket_of(word), len(offsets) - 1
    counts = np.bincount(row, minlength=rows)
    ends = np.concatenate([[0], np.cumsum(counts)])
    sums = np.zeros((rows, 2 * WIDTH + 2 * LAGS))
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + STEP, "right")) - 1)
        for at in range(ends[i], ends[j], STEP if j == i + 1 else max(1, ends[j] - ends[i])):
            to = min(at + STEP, ends[j])
            over = min(to + LAGS, ends[j])
            r, w = row[at:over], word[at:over]
            v = vectors[w]
            n = to - at
            head = np.concatenate([[0], np.flatnonzero(r[1:n] != r[: n - 1]) + 1])
            parts = [np.add.reduceat(v[:n], head, axis=0), np.add.reduceat(v[:n] * v[:n], head, axis=0)]
            for lag in range(1, LAGS + 1):
                alike, same = np.zeros(n), np.zeros(n)
                m = min(n, len(w) - lag)
                if m > 0:
                    both = r[lag : lag + m] == r[:m]
                    alike[:m] = (v[lag : lag + m] * v[:m]).sum(1) * both
                    same[:m] = (w[lag : lag + m] == w[:m]) & both
                parts += [np.add.reduceat(alike, head)[:, None], np.add.reduceat(same, head)[:, None]]
            sums[r[head]] += np.hstack(parts)
        i = j
    n = np.maximum(counts, 1)[:, None]
    mean = sums[:, :WIDTH] / n
    return np.hstack([mean, np.sqrt(np.maximum(sums[:, WIDTH : 2 * WIDTH] / n - mean**2, 0)), sums[:, 2 * WIDTH :] / n])


class Network:
    """Two layers; ``fit`` by Adam, ``calibrate`` on other rows."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(SEED)
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.shift) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                i = order[at : at + BATCH]
                h = np.tanh(x[i] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                d = (p - y[i, None]) / len(i)
                dh = d @ w[2].T * (1 - h * h)
                g = [x[i].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum(0)]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.shift) / self.scale, -20, 20)
        return (np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        z = self.logit(x)
        loss = lambda t: float(np.mean(np.logaddexp(0, z / t) - y * z / t))
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def held_out(doc_id="doc_id"):
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, vectors) -> Network | Constant:
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    known = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    known = known.select(F.col("doc_id").alias("_labelled"), "_good", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("_apart"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_labelled")).select("_labelled", "text", "_good", "_apart")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(*flat(part.column("text")), vectors.value).astype("<f4")
                yield pa.RecordBatch.from_arrays([part.column("_labelled").cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()), part.column("_good").cast(pa.int32()), part.column("_apart")], ["id", "x", "good", "apart"])

    got = rows.mapInArrow(run, "id long, x binary, good int, apart boolean").groupBy("id").agg(F.min(F.struct("x", "good", "apart")).alias("r")).select("r.*").collect()  # a row for each of FIT_ROWS ids at most
    got.sort(key=lambda r: r.x)
    y = np.array([float(r.good) for r in got])
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    x, apart = np.frombuffer(b"".join(r.x for r in got), "<f4").reshape(len(y), -1).astype(float), np.array([r.apart for r in got])
    if len(set(y[~apart])) < 2 or not apart.any():
        apart = np.zeros(len(y), bool)
    model = Network().fit(x[~apart], y[~apart])
    return model.calibrate(x[apart], y[apart]) if apart.any() else model


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (probability of good quality) for each row of (doc_id, text); labels: (doc_id, quality)."""
    has(docs, "doc_id", "text")
    has(labels, "doc_id", "quality")
    spark = docs.sparkSession
    ship(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    model = fitted(docs, labels, vectors)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                score = model(features(*flat(part.column("text")), vectors.value))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that score ``accept`` or more, with all their columns; texts aren't shuffled."""
    spark = docs.sparkSession
    ship(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    model = fitted(docs, labels, vectors)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model(features(*flat(part.column("text")), vectors.value)) >= accept))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))

"""Exact top-k by inner product, term at a time.

A component is a term, a candidate's components are weighted postings.  Candidates stand in blocks; for each block the
postings of every term are a list of (candidate, weight).  A query takes its non-zero terms in turn and scatters each
term's postings, times the query's weight, into a dense array of scores for the block.  The block's best are partitioned
off, and those of all blocks are merged by rank.  All sums are of whole numbers, exact below 2**53.

Scale: queries are a set that grows with the table, so they are taken in blocks of ``QUERIES`` rows; one block is collected
(its bytes are bounded), broadcast, and meets all candidates in the tasks that read them.  A task gives k rows a query, so
the merge shuffles queries x tasks x k small rows, cut down to k by partial aggregation.  Candidates are never shuffled.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; vectors of different lengths
agree on the components both have, the rest counting as zero; fewer candidates than k: all of them; ties go to the smaller
vec_id; rows that repeat a vec_id are rows of their own: each is a candidate for all others, its namesakes too, and each that
asks gets its own k; a null vec_id takes no part; an empty table gives an empty one; other input columns are ignored.  Work
grows with queries times candidates, that is, with the square of the table where the share of queries is fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, has

#: Queries that are broadcast at once, and candidates in a block.
QUERIES, CANDIDATES = 20_000, 4096

def whole(vector: Column, scale: int) -> Column:
    """Components as whole numbers floor(scale * x); null for vectors that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lengths = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.flatten()).astype(np.float64)
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class Postings:
    """One block of candidates by term."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray):
        order = np.lexsort((numbers, ids))
        self.ids, self.numbers, rows = ids[order], numbers[order], rows[order]
        self.terms: list[tuple[np.ndarray | None, np.ndarray]] = []
        for t in range(rows.shape[1]):
            at = np.flatnonzero(rows[:, t])
            # A term that all candidates have needs no list of who they are.
            self.terms.append((None, rows[:, t].copy()) if len(at) == len(rows) else (at, rows[at, t]))

    def scores(self, query: np.ndarray, out: np.ndarray) -> None:
        out[:] = 0
        for t in np.flatnonzero(query[: len(self.terms)]):
            at, weights = self.terms[t]
            if at is None:
                out += query[t] * weights
            else:
                out[at] += query[t] * weights

    def best(self, query: np.ndarray, own: int, k: int, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best but the row ``own``, all that tie for the last place among them cut by id."""
        self.scores(query, out)
        out[self.numbers == own] = -np.inf
        if len(out) > k:
            least = np.partition(out, len(out) - k)[len(out) - k]
            at = np.flatnonzero(out >= least)
        else:
            at = np.arange(len(out))
        at = at[np.isfinite(out[at])]
        at = at[np.lexsort((self.ids[at], -out[at]))[:k]]
        return self.ids[at], out[at]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of (vec_id, embedding) where ``queries`` holds, the k best others."""
    has(vectors, "vec_id", "embedding")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("v"), queries.alias("_asks"))
    rows = scratch.write(rows.filter("vec_id is not null and v is not null").withColumn("number", F.monotonically_increasing_id()), "whole")
    asked = rows.filter("_asks").select("number", "vec_id", "v")
    number = asked.count()
    parts = max(1, -(-number // (QUERIES * 4 // 5)))
    found = []
    for part in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("number"), F.lit(parts)) == part).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        batch = block.to_batches()[0]
        held = spark.sparkContext.broadcast((np.asarray(batch.column("number")), np.asarray(batch.column("vec_id")), matrix(batch.column("v"))))

        def run(batches, held=held):
            numbers, ids, asks = held.value
            kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
            for got in batches:
                for at in range(0, got.num_rows, CANDIDATES):
                    some = got.slice(at, CANDIDATES)
                    lists = Postings(np.asarray(some.column("vec_id")), np.asarray(some.column("number")), matrix(some.column("v")))
                    out = np.zeros(some.num_rows)
                    for q in range(len(ids)):
                        who, score = lists.best(asks[q], numbers[q], k, out)
                        who, score = np.concatenate([kept[q][0], who]), np.concatenate([kept[q][1], score])
                        order = np.lexsort((who, -score))[:k]
                        kept[q] = who[order], score[order]
            sizes = [len(x) for x, _ in kept]
            if sum(sizes):
                columns = [np.repeat(numbers, sizes), np.repeat(ids, sizes), np.concatenate([x for x, _ in kept]), np.concatenate([s for _, s in kept]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "query_id", "vec_id", "score"])

        found.append(scratch.write(rows.select("number", "vec_id", "v").mapInArrow(run, "number long, query_id long, vec_id long, score long"), f"part{part}"))
        held.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256)


SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.number <> c.number)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

"""Ranked lists joined into one, and searches for several concepts at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONCEPT_DEPTH, RRF_K
from .knn import top_k_each


def ranked(list_no: int, hits: DataFrame, by: str) -> DataFrame:
    """(list_no, id, rank) of one search's hits, best first; hits are at most a few hundred rows."""
    rank = F.row_number().over(Window.orderBy(F.desc(by), "id"))
    return hits.select(F.lit(list_no).alias("list_no"), "id", rank.alias("rank"))


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (list_no, id, rank): id, score, rank_0, rank_1.

    An id's best rank in a list counts, once.  Ties go to the better rank in the first list, then in the second.
    """
    best = lists.groupBy("list_no", "id").agg(F.min("rank").alias("rank"))
    score = F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score")
    ranks = [F.max(F.when(F.col("list_no") == n, F.col("rank"))).alias(f"rank_{n}") for n in (0, 1)]
    return best.groupBy("id").agg(score, *ranks)


def in_order(fused: DataFrame, first: str = "rank_0", second: str = "rank_1") -> DataFrame:
    return fused.orderBy(F.round("score", 12).desc(), F.asc_nulls_last(first), F.asc_nulls_last(second), "id")


def union(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def all_concepts(vectors: DataFrame, concepts: list[list[float]], limit: int) -> DataFrame:
    """id, average, similarities (in the order of the concepts): ids among the best 5 x limit of every concept.

    Equal averages keep the order of the first concept's hits.
    """
    near = top_k_each(vectors, concepts, limit * CONCEPT_DEPTH)
    joined = near.groupBy("id").agg(
        F.count("*").alias("n"),
        F.avg("similarity").alias("average"),
        F.transform(F.array_sort(F.collect_list(F.struct("query_no", "similarity"))), lambda s: s["similarity"]).alias("similarities"),
        F.min(F.when(F.col("query_no") == 0, F.col("rank"))).alias("first_rank"),
    )
    return joined.filter(F.col("n") == len(concepts)).orderBy(F.desc("average"), "first_rank").limit(limit).select("id", "average", "similarities")

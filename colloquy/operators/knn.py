"""Exact nearest neighbours by inner product.

Filters are applied to the candidates before the ranking, so a filtered search fetches nothing in excess.  The query is a
literal; a top-k is one scan with a bounded heap in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: (x.cast("double") / norm(a)).cast("float"))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def of_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors of other lengths count as absent."""
    return vectors.filter(F.size("embedding") == dimension)


def top_k(vectors: DataFrame, query: list[float], k: int | None, dimension: int | None = None) -> DataFrame:
    """id, similarity of the k best of (id, embedding), or of all, in no order, where k is None; a query of another dimension
    than asked for raises ValueError."""
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"the query has {len(query)} dimensions, the index {dimension}")
    if k is not None and k <= 0:
        return vectors.filter("false").select("id", F.lit(0.0).alias("similarity"))
    near = of_dimension(vectors, len(query)).select("id", dot(F.col("embedding"), literal(query)).alias("similarity"))
    return near if k is None else near.orderBy(F.desc("similarity"), "id").limit(k)


def top_k_each(vectors: DataFrame, queries: list[list[float]], k: int) -> DataFrame:
    """query_no, id, similarity, rank: the k best for each of a few queries, in one scan."""
    asked = F.array(*[F.struct(F.lit(i).alias("query_no"), literal(q).alias("q")) for i, q in enumerate(queries)])
    each = of_dimension(vectors, len(queries[0])).select("id", "embedding", F.explode(asked).alias("a"))
    scored = each.select(F.col("a.query_no").alias("query_no"), "id", dot(F.col("embedding"), F.col("a.q")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)

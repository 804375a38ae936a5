"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

A source's expected copies a document are its target over its size.  Its documents stand in one order, each adds its
expected copies to a running sum that begins at one random offset, and a document is emitted once for each whole number
that the sum crosses at it.  So the copies of any stretch of the order are right to within one.  The order goes by size
class (an eighth of a step of the size's square root), so that long and short documents are taken in proportion.

Scale: the running sum of equal steps is a rank, built from counts in three tiers (source and size class; a slice of
doc_id in it; the rows of that slice), so no task sorts a whole source and a hot source or size is divided.  Only the
table of sources, one row each, is sorted as one.

Defined cases: a null text has size 0; a null source is a source, and the last; rows that repeat are separate documents,
whose copies depend on their order alone (equal rows are interchangeable); a document of size 0 is sampled as any other
and takes no words; an empty table gives an empty one.  Other input columns pass through ``mix`` unchanged; the columns
made here replace input columns of the same names.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, has, text_digest

#: Weights by the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST = 3
#: Parts of a size class, by doc_id.
PARTS = 256
#: Size classes to each step of 1 of the size's square root.
CLASSES = 8
SEED = 20240607


def offset(seed: int = SEED) -> float:
    """The random offset, in 1/2**20ths so that sums with it are exact."""
    return random.Random(seed).randrange(1 << 20) / (1 << 20)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target.  ``sizes``: a row (source, source_size) for each source.

    Sources share the total by weight; none gets over ``most`` times its size, and the excess goes to the others by
    weight.  With the sources sorted by limit over weight, those at their limit come first: the level of the rest is
    what is left over the weights that are left, and a source is at its limit if its limit is below that level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "_no", weight.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_no")
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    free = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_no", "_level"))).over(every)["_level"]
    return ranked.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * free).alias("target"))


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, digests: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (and, if asked for, the text's digest) for each row of (doc_id, source, text)."""
    has(docs, "doc_id", "source", "text")
    scratch = Scratch(docs.sparkSession, "mixing")
    size = words(F.col("text"))
    sized = docs.select("doc_id", "source", size.alias("size"), *[text_digest().alias("digest")] * digests).withColumns(
        {
            "_class": F.floor(F.sqrt(F.col("size").cast("double")) * CLASSES).cast("long"),
            "_part": F.coalesce(F.pmod(F.col("doc_id"), F.lit(PARTS)), F.lit(-1)).cast("long"),
        }
    )
    sized = scratch.write(sized, "sizes")
    parts = scratch.write(sized.groupBy("source", "_class", "_part").agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "parts")
    classes = parts.groupBy("source", "_class").agg(F.sum("_n").alias("_n"))
    before_class = F.sum("_n").over(Window.partitionBy("source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1))
    classes = classes.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.coalesce(before_class, F.lit(0)).alias("_before_class"))
    before_part = F.sum("_n").over(Window.partitionBy("source", "_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        parts.withColumn("_before_part", F.coalesce(before_part, F.lit(0)))
        .join(classes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
        .select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_part").alias("_p"), (F.col("_before_class") + F.col("_before_part")).alias("_start"))
    )
    targets = source_targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    targets = targets.select(F.col("source").alias("_ts"), "source_size", "target")
    targets = F.broadcast(targets) if few_sources(parts) else targets
    starts = scratch.write(starts.join(targets, F.col("_s").eqNullSafe(F.col("_ts"))).drop("_ts"), "starts")
    inside = Window.partitionBy("source", "_class", "_part").orderBy("size", F.col("doc_id").asc_nulls_first())
    ranked = sized.withColumn("_in", F.row_number().over(inside)).join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_part") == F.col("_p"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, u = (F.col("_start") + F.col("_in")).cast("double"), F.lit(offset(seed))
    crossed = F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)
    return ranked.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"), *["digest"] * digests)


#: Up to so many sources, their targets (a few dozen bytes each) are broadcast.
BROADCAST_SOURCES = 20_000


def few_sources(parts: DataFrame) -> bool:
    return parts.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, each row as often as it is taken, with the columns of ``docs``.

    Copies are joined on doc_id, source and the text's digest; rows equal in all of these get the largest number of theirs.
    """
    names = {"doc_id": "_colloquy_mixed", "source": "_colloquy_source", "digest": "_colloquy_digest"}
    taken = copies(docs, weights, most, seed, digests=True).filter("copies > 0").groupBy(*names).agg(F.max("copies").alias("_colloquy_copies"))
    taken = taken.withColumnsRenamed(names)
    same = F.col("doc_id").eqNullSafe(F.col("_colloquy_mixed")) & F.col("source").eqNullSafe(F.col("_colloquy_source"))
    out = docs.join(taken, same & (text_digest() == F.col("_colloquy_digest")))
    return out.withColumn("_colloquy_copy", F.explode(F.sequence(F.lit(1), F.col("_colloquy_copies").cast("int")))).select(*[docs[c] for c in docs.columns])


def op10_mix(spark, sf_dir: str) -> DataFrame:
    out = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
placed AS (
  SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE)) * {CLASSES}) AS BIGINT) AS class,
    coalesce(((doc_id % {PARTS}) + {PARTS}) % {PARTS}, -1) AS part FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM placed GROUP BY source),
weighed AS (
  SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][CAST(no % {len(WEIGHTS)} AS INT) + 1] AS DOUBLE) AS w, source_size * {MOST} AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= w * level THEN CAST(cap AS DOUBLE)
    ELSE w * (SELECT arg_min(level, {{'a': cap / w, 'b': no}}) FROM levels WHERE cap > w * level) END AS target FROM levels),
ranked AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(row_number() OVER (PARTITION BY p.source ORDER BY class, part, size, doc_id NULLS FIRST) AS DOUBLE) AS r
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CAST(least(floor(r * rate + {offset()!r}) - floor((r - 1) * rate + {offset()!r}), {MOST}) AS BIGINT) AS copies FROM ranked)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""

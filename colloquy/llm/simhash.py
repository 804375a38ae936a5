"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is 64 bits, each the majority of that bit over the XXH64 hashes of a document's word shingles.  Two
fingerprints within 2r bits share a variant within r bits of both, so every distinct fingerprint meets its neighbours
on the variants within half the radius: 2,081 for r = 2.  Those are not shuffled one by one.  The shuffle key is a
variant's leading bits; a fingerprint sends one row for each leading part that its variants have (37 for 8 bits), and
the task of that part makes the variants with it and sorts them.  All fingerprints on one variant are within 2r bits of
each other, so each links to the first of them: no pairs are listed.  Links become classes by contraction.

A ball of four of 64 bits holds few of the texts that share 0.8 of their shingles: these differ in nine or ten bits.
``sketches`` therefore gives a text several independent fingerprints, and two texts are linked where any of these are within
the radius: each is another chance to be found, and a chance link of unrelated texts stays as rare as for one.

Scale: texts are read once and never shuffled; copies collapse to one fingerprint by partial aggregation; the number of
leading bits follows the number of fingerprints, so that a part's variants stay near ``PART``; a part above that is
worked through by further bits, a bounded number of variants at once.  Class ids come from rounds of contraction, each
of which is a written table; nothing is collected.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; a null doc_id takes part and counts as larger than any other; rows that repeat each get their class;
an empty table gives an empty one.  Other input columns are ignored (``fingerprints``) or pass through (``dedup``).
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, flat, mix, run_hashes, slices, spaced_words, span_hashes
from .shared import Scratch, has, text_digest

#: Words in a shingle and differing bits in a link.  The contract of op3 fixes 4 and 4; 5 words are the general setting.
SHINGLE, RADIUS = 5, 4
#: Fixed value: the seed of the hash.
XX_SEED = 42
#: Variants that one part is meant to have, and that one step sorts at most.
PART, VARIANTS = 1 << 22, 1 << 20
NULL_ID = (1 << 63) - 1


def fingerprint(words: list[bytes], k: int) -> int:
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), XX_SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, total = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + k - 1]
        hashes = np.array([digest(join(x), XX_SEED) for x in zip(*(part[i:] for i in range(k)), strict=False)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, digests: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and, if asked for, the text's digest for each row of (doc_id, text)."""
    has(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = flat(part.column("text"))
                low = LOWER[data].tobytes()
                fps = [fingerprint(low[a:b].split(), k) for a, b in zip(at, at[1:], strict=False)]
                columns = [part.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), *([part.column("digest")] if digests else [])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *["digest"] * digests])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[text_digest().alias("digest")] * digests)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", digest binary" * digests)


#: Eight counters of a byte each, the bits of a hash that are shifted into them, and how often they can count.
LANES, LANE_MOST = np.uint64(0x0101010101010101), 255
#: Fixed value: what makes the fingerprints of one text independent.
FOLD = 0x9E3779B97F4A7C15


def majorities(hashes: np.ndarray, row: np.ndarray, rows: int, number: int) -> np.ndarray:
    """For each row so many 64-bit majorities over its hashes; rows are in order, and one without hashes gets zeros."""
    out = np.zeros((rows, number), np.uint64)
    if not len(hashes):
        return out
    at = np.arange(len(row))
    first = np.searchsorted(row, np.arange(rows))
    head = np.flatnonzero((at - first[row]) % LANE_MOST == 0)  # stretches that a lane can count
    of = row[head]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    total = np.bincount(row, minlength=rows)[of[begin]]
    for n in range(number):
        h = mix(hashes + np.uint64((n + 1) * FOLD % (1 << 64)))
        for bit in range(8):
            counts = np.add.reduceat(h >> np.uint64(bit) & LANES, head).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(counts, begin, axis=0, dtype=np.int64)
            for lane in range(8):
                out[of[begin], n] |= (ones[:, lane] * 2 > total).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def sketch(texts: pa.Array, k: int, number: int) -> np.ndarray:
    """So many fingerprints of each text's shingles; fewer words than a shingle make one, and without words all are zero."""
    data, at = flat(texts)
    low = LOWER[data]
    start, end, row = spaced_words(low, at)
    words = span_hashes(low, start, end)
    inside = row[: max(0, len(row) - k + 1)] == row[k - 1 :]
    hashes, owner = run_hashes(words, k)[inside], row[: len(inside)][inside]
    counts = np.bincount(row, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < k))
    first = np.cumsum(counts) - counts
    more = np.array([run_hashes(words[first[i] : first[i] + counts[i]], int(counts[i]))[0] for i in short], np.uint64)
    order = np.argsort(np.concatenate([owner, short]), kind="stable")
    return majorities(np.concatenate([hashes, more])[order], np.concatenate([owner, short])[order], len(texts), number)


def sketches(docs: DataFrame, k: int, number: int, digests: bool = False) -> DataFrame:
    """As ``fingerprints``, with ``fps``, an array of so many; fp is a hash of all of them."""
    has(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fps = sketch(part.column("text"), k, number).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * number), pa.array(fps.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, *([part.column("digest")] if digests else [])], ["doc_id", "fps", *["digest"] * digests])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[text_digest().alias("digest")] * digests)
    made = rows.mapInArrow(run, "doc_id long, fps array<long>" + ", digest binary" * digests)
    return made.select("doc_id", F.xxhash64("fps").alias("fp"), *["digest"] * digests, "fps")


@cache
def ball(bits: int, radius: int) -> list[int]:
    """All values of so many bits with at most ``radius`` ones."""
    return [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(bits), n)]


def leading_bits(fingerprints: int, radius: int) -> int:
    variants = fingerprints * len(ball(64, radius // 2))
    return min(23, max(6, math.ceil(math.log2(max(1, variants / PART)))))


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of each pair in ``root``, in place; every tree stays flat."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def link_part(members: np.ndarray, lead: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) among the fingerprints whose ball has variants with this leading part."""
    root = np.arange(len(members))
    meet(members, np.arange(len(members)), lead, bits, radius, root)
    linked = np.flatnonzero(root != np.arange(len(members)))
    return members[linked], members[root[linked]]


def meet(members: np.ndarray, some: np.ndarray, lead: int, bits: int, radius: int, root: np.ndarray) -> None:
    """Joins in ``root`` those of ``some`` that share a variant with this leading part.

    Where that would be too many variants to sort at once, the part is divided by its next bits.
    """
    half, rest = radius // 2, 64 - bits
    far = np.bitwise_count((members[some] >> np.uint64(rest)) ^ np.uint64(lead))
    some, far = some[far <= half], far[far <= half]
    if len(some) < 2:
        return
    made = sum(int((far == d).sum()) * math.comb(rest, n) for d in range(half + 1) for n in range(half - d + 1))
    if made > VARIANTS and rest:
        more = min(rest, 4)
        for block in range(1 << more):
            meet(members, some, lead << more | block, bits + more, radius, root)
        return
    tail = np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for d in range(half + 1):
        ring, own = np.array(ball(rest, half - d), np.uint64), some[far == d]
        variants.append(((members[own] & tail)[:, None] ^ ring[None, :]).ravel())
        owners.append(np.repeat(own, len(ring)).astype(np.int32))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    pairs = np.unique(o[same].astype(np.int64) * len(members) + o[same + 1])
    a, b = pairs // len(members), pairs % len(members)
    near = np.bitwise_count(members[a] ^ members[b]) <= radius  # holds for all on one variant
    merge(root, a[near], b[near])


def links(distinct: DataFrame, bits: int, radius: int = RADIUS) -> DataFrame:
    """(number, a, b): fingerprints in one class, such that all within ``radius`` bits are joined by links.

    ``distinct``: (number, fp); only fingerprints of one number are compared.
    """
    rest = 64 - bits
    masks = F.array(*[F.lit(m) for m in ball(bits, radius // 2)])
    lead = F.shiftrightunsigned("fp", rest)
    group = (F.col("number").cast("long") * (1 << bits)).cast("int")
    sent = distinct.select("fp", F.explode(F.transform(masks, lambda m: group + lead.bitwiseXOR(m).cast("int"))).alias("lead"))

    def run(batches):
        leads, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def groups(upto):
            cuts = np.concatenate([[0], np.flatnonzero(leads[1:upto] != leads[: upto - 1]) + 1, [upto]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j - i > 1:
                    a, b = link_part(np.sort(fps[i:j]), int(leads[i]) & (1 << bits) - 1, bits, radius)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), int(leads[i]) >> bits, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["number", "a", "b"])

        for batch in batches:
            leads, fps = np.concatenate([leads, np.asarray(batch.column("lead"))]), np.concatenate([fps, np.asarray(batch.column("fp")).view(np.uint64)])
            whole = int(np.searchsorted(leads, leads[-1])) if len(leads) else 0  # the last group may go on
            if whole:
                yield from groups(whole)
                leads, fps = leads[whole:], fps[whole:]
        if len(leads):
            yield from groups(len(leads))

    return sent.repartition("lead").sortWithinPartitions("lead").mapInArrow(run, "number int, a long, b long")


def sketch_links(distinct: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b) of the ``fp`` of sketches (fp, fps) that have a fingerprint of one number within ``radius`` bits.

    A fingerprint that several sketches share stands for the least of them, to which the others are linked.
    """
    each = scratch.write(distinct.select("fp", F.posexplode("fps").alias("number", "word")), "numbered")
    heads = scratch.write(each.groupBy("number", "word").agg(F.min("fp").alias("head"), F.count("*").alias("n")), "heads")
    near = scratch.write(links(heads.select("number", F.col("word").alias("fp")), leading_bits(distinct.count(), radius), radius), "near")
    scratch.free()
    side = lambda word, head: heads.select("number", F.col("word").alias(word), F.col("head").alias(head))
    across = near.join(side("a", "x"), ["number", "a"]).join(side("b", "y"), ["number", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = each.join(heads.filter("n > 1"), ["number", "word"]).select(F.col("fp").alias("a"), F.col("head").alias("b"))
    return across.union(same)


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(v, root) for every vertex of the edges (a, b): one root for each connected component; None without edges.

    In each round every vertex moves to the neighbour (or itself) that comes first in an order drawn anew for that
    round, and edges follow; a constant share of the vertices is expected to go each time, so rounds grow as the
    logarithm of the largest component.
    """
    edges = scratch.write(edges.filter("a <> b").distinct(), "edges")
    moves = None
    turn = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
        first = F.min(F.struct(F.xxhash64("b", F.lit(turn)), "b"))["b"]
        step = scratch.write(both.groupBy(F.col("a").alias("v")).agg(first.alias("to")), "moves")
        to_a, to_b = step.select(F.col("v").alias("a"), F.col("to").alias("x")), step.select(F.col("v").alias("b"), F.col("to").alias("y"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        after = scratch.write(moved, "edges")
        scratch.drop(edges)
        edges = after
        if moves is None:
            moves = step
        else:
            then = step.select(F.col("v").alias("to"), F.col("to").alias("next"))
            joined = scratch.write(moves.join(then, "to", "left").select("v", F.coalesce("next", "to").alias("to")), "moves")
            scratch.drop(moves, step)
            moves = joined
        turn += 1
    return moves and moves.withColumnRenamed("to", "root")


def classed(docs: DataFrame, k: int, radius: int, digests: bool, number: int = 0) -> DataFrame:
    """The rows of ``fingerprints``, or of ``sketches`` if a number is given, with ``own`` (doc_id, NULL_ID for none; with ``digests`` the pair of it and the digest)
    and ``component``, the smallest ``own`` of the class."""
    if radius % 2:
        raise ValueError("the radius must be even")
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(sketches(docs, k, number, digests) if number else fingerprints(docs, k, digests), "fingerprints")
    own = F.coalesce("doc_id", F.lit(NULL_ID))
    own = F.struct(own.alias("id"), "digest") if digests else own
    distinct = scratch.write(marked.groupBy("fp").agg(F.min(own).alias("least"), *[F.min("fps").alias("fps")] * bool(number)), "distinct")
    scratch.free()
    if number:
        found = sketch_links(distinct, radius, scratch)
    else:
        found = scratch.write(links(distinct.select(F.lit(0).alias("number"), "fp"), leading_bits(distinct.count(), radius), radius), "links").select("a", "b")
    roots = contract(found, scratch)
    if roots is None:
        known = distinct.select("fp", F.col("least").alias("component"))
    else:
        inside = scratch.write(distinct.join(roots, distinct.fp == roots.v).select("fp", "least", "root"), "inside")
        least = scratch.write(inside.groupBy("root").agg(F.min("least").alias("component")), "least")
        classed = inside.join(least, "root").select(F.col("fp").alias("_fp"), "component")
        known = distinct.join(classed, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("component", "least").alias("component"))
    known = scratch.write(known, "classes")
    return marked.join(known, "fp").withColumn("own", own)


def components(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the class) for each row of (doc_id, text)."""
    component = F.when(F.col("component") != NULL_ID, F.col("component"))
    return classed(docs, k, radius, False).select("doc_id", "fp", component.alias("component_id"))


def dedup(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, number: int = 0) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id, or of several texts with it that with the
    smallest digest; columns as in ``docs``.

    Rows with one doc_id and one text are one document and stay or go together; of those without a doc_id one stays.
    With ``number``, classes are by so many fingerprints a text (``sketches``), else by the one of ``fingerprints``.
    """
    kept = classed(docs, k, radius, True, number).filter("own = component").select(F.col("own.id").alias("_colloquy_id"), F.col("own.digest").alias("_colloquy_own")).distinct()
    marked = docs.withColumn("_colloquy_digest", text_digest())
    stays = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("_colloquy_id")) & (F.col("_colloquy_digest") == F.col("_colloquy_own"))
    out = marked.join(kept, stays, "left_semi")
    nameless = marked.filter("doc_id is null").join(kept, stays, "left_semi").dropDuplicates(["_colloquy_digest"])
    return out.filter("doc_id is not null").union(nameless).select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

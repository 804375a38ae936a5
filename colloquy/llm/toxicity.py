"""Toxicity from class-conditional Kneser-Ney models.

A toxic and an ordinary model of words are counted over the labelled documents.  The upper level counts how often each word
follows each other word (or begins a row) in a class.  Counts are discounted by one, two or three and more, with discounts
estimated from the counts of counts, and what that frees after a word goes to the lower level.  The lower level counts a
word's different words before it (Kneser-Ney's continuation counts), discounted likewise; what the discounts free there goes
to the word's share of contexts in both classes together, so that an expression which is rare in either class is judged by
counts that both share.  A document gets the difference of its two log-likelihoods by both levels divided by its length, the
same difference by the lower level alone, that of its most toxic stretches of ``STRETCHES`` words and of its striking words,
and a logistic calibration of these, fitted on a bounded sample of labelled rows, the only ones that may be learned from and
aren't counted.

The difference over whole documents alone finds one in ten toxic documents, as a few words in hundreds decide, so stretches
are scored too, by the lower level, which tells them apart better (README has the figures).

Scale: pairs are gathered by a shuffle of (word before, word), each once a task, and the tables of words and of pairs grow
with the labelled corpus; neither is ever collected or broadcast.  Each unit of texts (see ``exchange``) asks for the counts
of its different words and pairs, in rounds.  The driver gets counts of counts, and seven numbers for each calibration row.
Labels are joined to texts by broadcast while they are at most ``LABELS`` rows, else by a shuffle on doc_id.

Defined cases: null and empty texts have no words and get the calibrated score of a zero difference; rows without a label
or with a null one are scored only; a doc_id labelled twice counts as toxic if any of its labels is; with no labels of one
kind all scores are the share of toxic labels, at most 0.49 (0.0 without any); a null doc_id is scored and can't be
labelled; after a word that a class never has before another, its lower level decides; equal rows get equal scores; an empty
table gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, flat, pair_hashes, slices, span_hashes, spans
from .exchange import bucket_bits, looked_up, received, replies_of, units, unpacked
from .quality import held_out
from .shared import Scratch, has

#: Bytes of text in a unit: the more, the fewer words are asked for twice.
UNIT = 8 << 20
#: Units are scored in so many rounds, so that their texts aren't all on their way at once.
ROUNDS = 6
#: The table of pairs is in so many parts by the pairs' leading bits (a power of two, 64 at most), and a round asks each in turn.
PARTS = 2
#: Words in a stretch.
STRETCHES = (1, 3, 12)
#: A word whose difference is above this is an expression of the toxic model's own.
STRIKING = 3.0
#: Rows of labels that are broadcast at most (a few dozen bytes each).
LABELS = 1_000_000
#: doc_ids that the calibration is fitted on at most, of a fifth of all: those that hash lowest.  The others are counted.
CALIBRATION_ROWS = 20_000
#: Columns of what follows a word, by class: all, and different words that do so once, twice, and more often.
AFTER = [f"{c}_{n}" for c in ("o", "t") for n in ("all", "one", "two", "more")]
#: Columns of a unit's replies: about its words, and about its pairs in each part.
REPLIES = ["of_words", *[f"of_pairs_{i}" for i in range(PARTS)]]

#: True for bytes of words: letters, digits, apostrophe and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[0x27, *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of each word, in order."""
    data, offsets = flat(texts)
    low = LOWER[data]
    start, end, row = spans(WORD[low], offsets)
    return span_hashes(low, start, end), row


def befores(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hash of the word before each, 0 where a row begins."""
    before = np.zeros(len(word), np.uint64)
    before[1:] = np.where(row[1:] == row[:-1], word[:-1], 0)
    return before


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2, and 3 or more, by the numbers of counts of 1 to 4 (modified Kneser-Ney)."""
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.75, 1.0])
    share = n[0] / (n[0] + 2 * n[1])
    out = [0.0]
    for i in (1, 2, 3):
        out.append(min(max(i - (i + 1) * share * n[i] / n[i - 1], 0.0), i) if n[i - 1] else out[-1])
    return np.array(out)


class Statistics(NamedTuple):
    """By class (ordinary, toxic): all contexts, discounts, what these free; and for both together contexts and words."""

    contexts: np.ndarray
    discounts: np.ndarray
    freed: np.ndarray
    shared: int
    kinds: int


def counts_of_counts(c: str) -> list:
    return [F.count_if(F.col(c) == i).alias(f"{c}{i}") for i in (1, 2, 3, 4)]


def statistics(table: DataFrame) -> Statistics:
    """From (word, o, t, e): contexts of each word by class, and in either."""
    asked = [F.count_if(F.col("e") > 0).alias("kinds"), F.sum("e").alias("shared")]
    for c in ("o", "t"):
        asked += [F.sum(c).alias(c), *counts_of_counts(c), F.count_if(F.col(c) >= 3).alias(f"{c}more")]
    r = table.agg(*asked).first()
    taken = np.array([discounts([r[f"{c}{i}"] for i in (1, 2, 3, 4)]) for c in ("o", "t")])
    held = np.array([[0, r[f"{c}1"], r[f"{c}2"], r[f"{c}more"]] for c in ("o", "t")])
    return Statistics(np.array([float(r.o or 0), float(r.t or 0)]), taken, (taken * held).sum(1), int(r.shared or 0), int(r.kinds))


def pair_statistics(met: DataFrame) -> tuple[np.ndarray, int]:
    """From (o, t), how often each pair occurs by class: the discounts by class, and the number of pairs.

    As much is taken from higher counts as from one at least: their estimates may be nothing (where texts repeat), and a word
    whose pairs all occur often would leave nothing for others.
    """
    r = met.agg(F.count("*").alias("pairs"), *counts_of_counts("o"), *counts_of_counts("t")).first()
    taken = np.array([discounts([r[f"{c}{i}"] for i in (1, 2, 3, 4)]) for c in ("o", "t")])
    return np.where(np.arange(4) > 0, np.maximum(taken, taken[:, 1:2]), 0), int(r.pairs)


def continuations(o: np.ndarray, t: np.ndarray, e: np.ndarray, known: Statistics) -> list[np.ndarray]:
    """P(word | class) by the lower level for words with so many contexts by class and in either."""
    shared = (e + 0.5) / (known.shared + 0.5 * (known.kinds + 1))
    out = []
    for k, n in enumerate((o, t)):
        left = n - known.discounts[k][np.minimum(n, 3)]
        out.append((left + known.freed[k] * shared) / known.contexts[k])
    return out


def differences(o: np.ndarray, t: np.ndarray, e: np.ndarray, known: Statistics) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) by the lower level for words with so many contexts by class and in either."""
    ordinary, toxic = continuations(o, t, e, known)
    return np.log(toxic) - np.log(ordinary)


def followed(n: np.ndarray, after: list[np.ndarray], taken: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(word | word before) in a class for pairs that occur ``n`` times; ``after``: what follows the word before (all, and
    different words that do so once, twice, and more often), ``lower``: P of the word by the lower level."""
    total, *kinds = after
    freed = sum(d * x for d, x in zip(taken[1:], kinds, strict=True))
    return np.where(total > 0, (n - taken[np.minimum(n, 3)] + freed * lower) / np.maximum(total, 1), lower)


def features(gain: np.ndarray, chained: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row by the lower level the mean difference a word, that of the stretches where it is highest, and what is
    striking in it: the logarithm of the sum of differences, and their mean over the row; last, the mean by both levels."""
    out = np.zeros((rows, 4 + len(STRETCHES)))
    if not len(gain):
        return out
    counts = np.bincount(row, minlength=rows)
    sums, both = (np.concatenate([[0], np.cumsum(np.round(x * (1 << 20)).astype(np.int64))]) for x in (gain, chained))  # whole numbers: the same in any unit
    ends = np.concatenate([[0], np.cumsum(counts)])
    out[:, 0], out[:, -1] = ((x[ends[1:]] - x[ends[:-1]]) / (1 << 20) / np.maximum(counts, 1) for x in (sums, both))
    striking = np.bincount(row, np.where(gain > STRIKING, np.round(gain * (1 << 20)) / (1 << 20), 0), rows)
    out[:, -3], out[:, -2] = np.log1p(striking), striking / np.maximum(counts, 1)
    at = np.arange(len(gain))
    head = ends[:-1][counts > 0]
    for k, size in enumerate(STRETCHES):
        stop = np.minimum(at + size, ends[row + 1])
        whole = (stop - at == size) | (at == ends[row])
        out[counts > 0, 1 + k] = np.maximum.reduceat(np.where(whole, (sums[stop] - sums[at]) / (1 << 20) / size, -np.inf), head)
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, _toxic of the rows that are counted; _sampled, _toxic of the doc_ids that the calibration takes."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.filter(~held_out()).select(F.col("doc_id").alias("_labelled"), "_toxic", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("_apart"))
    few = labels.count() <= LABELS
    known = F.broadcast(known) if few else known
    there = known.filter("_apart").join(docs.select("doc_id"), F.col("_labelled") == F.col("doc_id")).select(F.col("_labelled").alias("_sampled"), "_toxic").distinct()
    sample = there.orderBy(F.xxhash64("_sampled"), "_sampled").limit(CALIBRATION_ROWS)
    counted = known.join(F.broadcast(sample.select("_sampled")), F.col("_labelled") == F.col("_sampled"), "left_anti").select("_labelled", "_toxic")
    return docs.select("doc_id", "text").join(F.broadcast(counted) if few else counted, F.col("doc_id") == F.col("_labelled")).drop("_labelled"), sample


def pairs(rows: DataFrame) -> DataFrame:
    """word, before, o, t: how often each word follows each (0: the row's beginning) in ordinary and in toxic rows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                word, row = words(part.column("text"))
                before = befores(word, row)
                toxic = (np.asarray(part.column("_toxic")) > 0)[row]
                order = np.lexsort((before, word))
                word, before, toxic = word[order], before[order], toxic[order]
                head = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (before[1:] != before[:-1]))[: len(word)])
                o, t = (np.add.reduceat(k.astype(np.int32), head) if len(head) else np.zeros(0, np.int32) for k in (~toxic, toxic))
                yield pa.RecordBatch.from_arrays([pa.array(word[head].view(np.int64)), pa.array(before[head].view(np.int64)), pa.array(o, pa.int32()), pa.array(t, pa.int32())], ["word", "before", "o", "t"])

    met = rows.select("text", "_toxic").mapInArrow(run, "word long, before long, o int, t int")
    return met.groupBy("word", "before").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))


def contexts(rows: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """word, o, t, e: the different words before each word (the row's beginning is one) in ordinary, toxic, and all rows;
    and by class (o, t) what follows it: all, and different words that do so once, twice, and more often.

    The row's beginning is a word 0 with nothing before it.  ``met`` is ``pairs(rows)``, where that is already written.
    """
    met = pairs(rows) if met is None else met
    sides = [[F.col("word"), *[(F.col(c) > 0).cast("int").alias(c) for c in ("o", "t")], F.lit(1).alias("e"), *[F.lit(0).alias(n) for n in AFTER]]]
    sides.append([F.col("before").alias("word"), *[F.lit(0).alias(n) for n in ("o", "t", "e")]])
    for c in ("o", "t"):
        sides[1] += [F.col(c).alias(f"{c}_all"), *[x.cast("int").alias(f"{c}_{n}") for n, x in (("one", F.col(c) == 1), ("two", F.col(c) == 2), ("more", F.col(c) >= 3))]]
    return met.select(*sides[0]).unionByName(met.select(*sides[1])).groupBy("word").agg(*[F.sum(n).alias(n) for n in ("o", "t", "e", *AFTER)])


def pair_table(met: DataFrame, bits: int) -> DataFrame:
    """pair (a hash), o, t, part: what ``pairs`` gives, to be looked up; in order within the pairs' leading bits, as ordered
    hashes take less room and go to a bucket in few messages."""

    def run(batches):
        for batch in batches:
            word, before = (np.asarray(batch.column(c)).view(np.uint64) for c in ("word", "before"))
            key = pair_hashes(before, word)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("o"), batch.column("t"), pa.array(part_of(key))], ["pair", "o", "t", "part"])

    made = met.mapInArrow(run, "pair long, o long, t long, part int")
    return made.repartition(F.shiftrightunsigned("pair", 64 - bits)).sortWithinPartitions("part", "pair")


def part_of(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(58)) // np.uint64(64 // PARTS)).astype(np.int32)


def asked_words(body: bytes) -> np.ndarray:
    """The different words of a unit, and 0, a row's beginning."""
    return np.unique(np.append(words(unpacked(body).column("text"))[0], np.uint64(0)))


def asked_pairs(body: bytes, part: int) -> np.ndarray:
    word, row = words(unpacked(body).column("text"))
    keys = pair_hashes(befores(word, row), word)
    return np.unique(keys[part_of(keys) == part])


def measured(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, x: the features of each row of (doc_id, text) by the models counted on ``rows``."""
    met = scratch.write(pairs(rows), "met")
    scratch.free()
    taken, n_pairs = pair_statistics(met)
    table = scratch.write(contexts(rows, met), "words")
    scratch.free()
    met_at = scratch.write(pair_table(met, bucket_bits(n_pairs)), "pairs", "part")
    scratch.drop(met)
    known = statistics(table)
    turn = F.pmod(F.col("unit") + F.shiftright("unit", 33), F.lit(ROUNDS)).cast("int")  # a task's units and tasks' first ones alike
    made = scratch.write(units(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), UNIT).withColumn("turn", turn), "units", "turn")
    turns = {r.turn: r.size for r in made.groupBy("turn").agg(F.sum("bytes").alias("size")).collect()}
    size = sum(turns.values())
    bits, pair_bits = bucket_bits(size // 20 + known.kinds), bucket_bits(size // 10 + n_pairs)

    def gains(text, answers):
        """The differences of a text column's words by the lower level and by both, and their rows."""
        word, row = words(text)
        if not known.contexts.all():
            return np.zeros(len(word)), np.zeros(len(word)), row
        before = befores(word, row)
        keys, place = np.unique(np.append(word, np.uint64(0)), return_inverse=True)
        o, t, e, *after = received(keys, bits, answers[0], 3 + len(AFTER))
        lower = [p[place[:-1]] for p in continuations(o, t, e, known)]
        pair, first, at = np.unique(pair_hashes(before, word), return_index=True, return_inverse=True)
        ahead = np.searchsorted(keys, before[first])
        found = received(pair, pair_bits, {b: r for a in answers[1:] for b, r in a.items()}, 2)
        chained = [followed(found[k], [x[ahead] for x in after[4 * k : 4 * k + 4]], taken[k], lower[k][first]) for k in (0, 1)]
        return np.log(lower[1]) - np.log(lower[0]), (np.log(chained[1]) - np.log(chained[0]))[at], row

    def run(batches):
        for batch in batches:
            for body, *replies in zip(batch.column("body"), *(batch.column(c) for c in REPLIES), strict=True):
                part = unpacked(body.as_py())
                gain, chained, row = gains(part.column("text"), [replies_of(r) for r in replies])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(features(gain, chained, row, part.num_rows)), pa.list_(pa.float64()))], ["doc_id", "x"])

    parts = []
    for turn in sorted(turns) or [0]:
        some = made.filter(F.col("turn") == turn)
        asked = [(asked_words, table, "word", ["o", "t", "e", *AFTER], bits)]
        asked += [(partial(asked_pairs, part=i), met_at.filter(F.col("part") == i), "pair", ["o", "t"], pair_bits) for i in range(PARTS)]
        replied = []
        for one in asked:
            replied.append(scratch.write(looked_up(some, *one), "replies"))
            scratch.free()
        answered = some.select("unit", "body")
        for name, r in zip(REPLIES, replied, strict=True):
            answered = answered.join(r.select("unit", F.col("replies").alias(name)), "unit", "left")
        parts.append(scratch.write(answered.select("body", *REPLIES).mapInArrow(run, "doc_id long, x array<double>"), "features"))
        scratch.drop(*replied)
    scratch.drop(made, table, met_at)
    return reduce(DataFrame.union, parts)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method with a small penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (probability of toxicity) for each row of (doc_id, text); labels: (doc_id, toxic)."""
    has(docs, "doc_id", "text")
    has(labels, "doc_id", "toxic")
    rows, sample = labelled(docs, labels)
    found = measured(docs, rows, Scratch(docs.sparkSession, "toxicity"))
    # CALIBRATION_ROWS rows at most: one for each doc_id.
    got = found.join(F.broadcast(sample), F.col("doc_id") == F.col("_sampled")).groupBy("doc_id", "_toxic").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: r.doc_id)
    y = np.array([float(r._toxic > 0) for r in got])
    if not len(y) or y.min() == y.max():
        return found.select("doc_id", F.lit(min(0.49, float(y.mean())) if len(y) else 0.0).alias("score"))
    weights = logistic(np.array([r.x for r in got]), y).tolist()
    z = reduce(lambda a, i: a + F.element_at("x", i + 1) * weights[i], range(len(weights) - 1), F.lit(weights[-1]))
    return found.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

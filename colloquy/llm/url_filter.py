"""URL filter: rules first, then the ratio of two character language models.

A rule is a host and the beginning of a path; it fits the host and all its subdomains, and the longest that fits decides.
URLs that no rule fits are judged by two variable-order Markov models of the characters (bytes) of host and path, one of
the URLs that rules accept and one of those they reject, both without the rule's own host and path.  Each order's
distribution, up to ``ORDER`` characters, is smoothed by the one below it with Witten-Bell weights, so a context counts as
far as the evidence for it goes.  The score is the difference of the two log-likelihoods divided by the length; the
threshold is calibrated on all ruled URLs of a fifth of the hashes, which the models aren't counted on.

Scale: pages are read once, for the url alone; the rulings are written, and everything else works on that table.  Counts of
sequences are gathered by a shuffle that adds up within tasks first; their table grows with the ruled URLs and is never
collected or broadcast: each unit of URLs (see ``exchange``) asks for the counts of its different sequences.  The driver
gets a histogram of scores.

Defined cases: a null url, or one without ``://``, has an empty host and path; a url without host and path scores zero; with
no accepted or no rejected URLs to learn from, URLs without a rule are allowed; rows that repeat are judged alike; an
empty table gives an empty one; other input columns are ignored by ``judge``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import flat, pair_hashes, slices
from .exchange import bucket_bits, looked_up, received, replies_of, units, unpacked
from .shared import Scratch, has

#: (verdict, host, path) of the contract's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Characters in the longest sequence counted, the last of which is predicted.
ORDER = 7
#: Symbols that the lowest order takes for equally likely.
SYMBOLS = 256
#: Steps of a score in the histogram that the threshold is read from.
STEPS = 1024
#: By model: a sequence's occurrences, and as a context its followers' and the different ones among them.
COLUMNS = ["good", "bad", "good_total", "bad_total", "good_kinds", "bad_kinds"]


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.instr("url", "://")
    after = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url")))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def ruled(split: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (text of the rule that decides, or null), ruling (its verdict, or null), and text: host and path without
    what the rule itself says, so that models learn what ruled URLs are like and not the rules."""
    rule, ruling, text = F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat("host", "path")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rest = F.concat(F.expr(f"left(host, length(host) - {len(host)})"), F.lit("/"), F.expr(f"substring(path, {len(path) + 1})"))
        rule, ruling, text = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling), F.when(fits, rest).otherwise(text)
    return split.withColumns({"rule": rule, "ruling": ruling, "text": text})


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the sequences of 1 to ORDER characters that end at each character, those of their contexts (both ORDER x
    characters), and the rows.  What is before a row's first character counts as a character of its own kind."""
    rows = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1) * (ORDER - 1), np.diff(offsets))
    padded = np.zeros(len(data) + rows * (ORDER - 1), np.uint64)
    padded[at] = data.astype(np.uint64) + np.uint64(1)
    found, contexts = np.empty((ORDER, len(data)), np.uint64), np.empty((ORDER, len(data)), np.uint64)
    before = np.zeros(len(padded) + 1, np.uint64)  # of the sequences that end just before each place
    for k in range(ORDER):
        here = pair_hashes(before[:-1], padded)
        found[k], contexts[k] = here[at], before[:-1][at]
        before[1:] = here
        before[0] = 0
    return found, contexts, np.repeat(np.arange(rows), np.diff(offsets))


def counts(known: DataFrame) -> DataFrame:
    """sequence and COLUMNS, from rows of (text, accepted)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                found, contexts, row = sequences(*flat(part.column("text")))
                good = np.tile(np.asarray(part.column("accepted").cast(pa.int8())).astype(bool)[row], ORDER)
                key, first, at = np.unique(found.ravel(), return_index=True, return_inverse=True)
                columns = [key.view(np.int64), contexts.ravel()[first].view(np.int64), *(np.bincount(at[m], minlength=len(key)) for m in (good, ~good))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sequence", "context", "good", "bad"])

    ends = known.select("text", "accepted").mapInArrow(run, "sequence long, context long, good long, bad long")
    ends = ends.groupBy("sequence", "context").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    none = [F.lit(0).cast("long")] * 4
    as_context = [F.col("context"), *none[:2], F.col("good"), F.col("bad"), (F.col("good") > 0).cast("long"), (F.col("bad") > 0).cast("long")]
    named = lambda columns: F.struct(*[c.alias(n) for c, n in zip(columns, ["sequence", *COLUMNS], strict=True)])
    both = F.array(named([F.col("sequence"), F.col("good"), F.col("bad"), *none]), named(as_context))
    rows = ends.select(F.inline(both))
    return rows.groupBy("sequence").agg(*[F.sum(c).alias(c) for c in COLUMNS])


def log_ratio(found: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
    """log2 of P(character | accepted) / P(character | rejected).

    COLUMNS of the sequences that end at each character and of their contexts, both ORDER x characters.
    """
    logs = []
    for k in (0, 1):
        p = np.full(found[0].shape[1], 1 / SYMBOLS)
        for n, total, kinds in zip(found[k], before[2 + k], before[4 + k], strict=True):
            p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
        logs.append(np.log2(p))
    return logs[0] - logs[1]


def keys_of(body: bytes) -> np.ndarray:
    found, contexts, _ = sequences(*flat(unpacked(body).column("text")))
    return np.unique(np.concatenate([found.ravel(), contexts.ravel()]))


def scored(split: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """``split`` with score: the log-likelihood difference of its ``text`` in bits a character."""
    made = scratch.write(units(split, 1 << 18), "units")
    bits = bucket_bits((made.agg(F.sum("bytes")).first()[0] or 0) + table.count())
    replied = scratch.write(looked_up(made, keys_of, table, "sequence", COLUMNS, bits), "replies")

    def run(batches):
        for batch in batches:
            for body, replies in zip(batch.column("body"), batch.column("replies"), strict=True):
                part = unpacked(body.as_py())
                found, contexts, row = sequences(*flat(part.column("text")))
                keys, at = np.unique(np.concatenate([found.ravel(), contexts.ravel()]), return_inverse=True)
                at = at.reshape(2, *found.shape)
                values = received(keys, bits, replies_of(replies), len(COLUMNS))
                gains = np.round(log_ratio([v[at[0]] for v in values], [v[at[1]] for v in values]) * (1 << 20)).astype(np.int64)
                length = np.bincount(row, minlength=part.num_rows)
                sums = np.concatenate([[0], np.cumsum(gains)])[np.concatenate([[0], np.cumsum(length)])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(sums) / (1 << 20) / np.maximum(length, 1))], [*part.schema.names, "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema.fields)
    return made.join(replied, "unit", "left").select("body", "replies").mapInArrow(run, f"{kind}, score double")


def threshold(histogram: list[tuple[int, int, int]]) -> float:
    """The cut between rejected and accepted with the greatest sum of both rates of right answers; the middle of a tie.

    ``histogram``: step, numbers of accepted and of rejected URLs whose score is in it.
    """
    rows = sorted(histogram)
    if not rows:
        return 0.0
    step, good, bad = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    if not good.sum() or not bad.sum():
        return 0.0
    right = np.concatenate([[0], np.cumsum(bad)]) / bad.sum() + np.concatenate([np.cumsum(good[::-1])[::-1], [0]]) / good.sum()
    edges = np.concatenate([[step[0]], (step[1:] + step[:-1] + 1) / 2, [step[-1] + 1]])
    best = np.flatnonzero(right == right.max())
    return float(edges[best[len(best) // 2]]) / STEPS


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score, verdict for each row of (page_id, url)."""
    has(pages, "page_id", "url")
    scratch = Scratch(pages.sparkSession, "urls")
    apart = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    split = scratch.write(ruled(parts(pages.select("page_id", "url")), rules).withColumns({"accepted": F.col("ruling") == "allow", "apart": apart}), "rulings")
    known = split.filter("ruling is not null")
    table = scratch.write(counts(known.filter("not apart")), "counts")
    sums = table.agg(F.sum("good"), F.sum("bad")).first()
    if not sums[0] or not sums[1]:
        return split.select("page_id", "host", "path", "rule", F.lit(0.0).alias("score"), F.coalesce("ruling", F.lit("allow")).alias("verdict"))
    out = scratch.write(scored(split, table, scratch), "scores")
    step = F.floor(F.col("score") * STEPS)
    # Scores are differences of log2 of probabilities a character, so the histogram has tens of thousands of steps at most.
    sizes = out.filter("ruling is not null and apart").groupBy(step.alias("step")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    cut = threshold([tuple(r) for r in sizes.collect()])
    verdict = F.coalesce("ruling", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))

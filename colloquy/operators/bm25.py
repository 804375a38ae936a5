"""Text search: an inverted index as tables, BM25 scores, phrases and boolean queries.

``postings``: term, id, tf, positions; ``lengths``: id, dl.  Statistics are of all documents, also of those that a search
never returns.  A query's terms are a handful of literals: they prune the postings by an IN predicate that reaches the
scan, and are joined to nothing larger than the documents that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Clause, Group, document_text, parse_query, stem, with_terms
from ..schema import LENGTH, POSTING

K1, B = 1.2, 0.75
PLACES = "array<struct<term:string,positions:array<int>>>"


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    lengths: DataFrame

    def statistics(self) -> DataFrame:
        """n, avgdl: one row."""
        return self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def build(documents: DataFrame, text: Column | str = "text", stemmed: bool = True, unique: bool = False) -> TextIndex:
    """The index of (id, text); one row of an id counts, so replayed rows replace (see ``latest``).

    Where ids are known to be ``unique``, a row makes its postings by itself, which suits an index that is written whole; else
    rows of one id are brought together, and a search's terms are picked before that.
    """
    text = F.col(text) if isinstance(text, str) else text
    raw = with_terms(documents, text, stemmed=False)  # a stem for each term: lengths are the same
    lengths = raw.select("id", F.size("terms").cast("long").alias("dl"))
    if unique:
        return TextIndex(row_postings(raw, stemmed), lengths)
    words = with_terms(documents, text, stemmed)
    postings = (
        words.select("id", F.posexplode("terms").alias("position", "term"))
        .groupBy("term", "id")
        .agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))
    )
    return TextIndex(postings, lengths)


def row_postings(raw: DataFrame, stemmed: bool) -> DataFrame:
    """The postings of each row of (id, terms), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            known, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if stemmed:
                stems = pa.array([stem(t) for t in known.to_pylist()], pa.string()).dictionary_encode()
                known, code = stems.dictionary, stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
            row = np.repeat(np.arange(len(size)), size)
            position = (np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            key = row * max(len(known), 1) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.append(first, len(code))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(position[order]))
            columns = [known.take(pa.array(code[order[first]])), b.column("id").take(pa.array(row[order[first]])), pa.array(np.diff(ends)), positions]
            yield pa.RecordBatch.from_arrays(columns, ["term", "id", "tf", "positions"])

    return raw.mapInArrow(run, POSTING)


def asked(documents: DataFrame, terms: list[str], path: str, text: Column | str = "text", stemmed: bool = True) -> TextIndex:
    """All lengths of (id, text), and the postings of a few terms alone, by one pass over the texts.

    The pass writes one row a document, its length and where it has the terms, so searches read no text and what is shuffled
    is of the documents that hold a term.
    """
    words = with_terms(documents, F.col(text) if isinstance(text, str) else text, stemmed)
    hit = lambda t, i: F.when(t.isin(*terms), F.struct(t.alias("term"), i.alias("position")))
    hits = words.select("id", F.size("terms").cast("long").alias("dl"), F.filter(F.transform("terms", hit), lambda h: h.isNotNull()).alias("hits"))
    at = lambda t: F.transform(F.filter("hits", lambda h: h["term"] == t), lambda h: h["position"])
    places = F.array(*[F.struct(F.lit(t).alias("term"), at(t).alias("positions")) for t in terms]).cast(PLACES)
    hits.select("id", "dl", F.filter(places, lambda p: F.size(p["positions"]) > 0).alias("places")).write.parquet(path)
    rows = documents.sparkSession.read.schema(f"{LENGTH}, places {PLACES}").parquet(path)
    each = rows.select("id", F.inline("places"))
    postings = each.groupBy("term", "id").agg(F.sum(F.size("positions")).alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return TextIndex(postings, rows.select("id", "dl"))


def exchange_documents(exchanges: DataFrame) -> DataFrame:
    return exchanges.select("id", document_text(F.col("user_message"), F.col("assistant_message")).alias("text"))


def latest(rows: DataFrame, version: str) -> DataFrame:
    """One row for each id, that of the greatest version."""
    columns = [c for c in rows.columns if c != "id"]
    best = F.max_by(F.struct(*columns), F.col(version))
    return rows.groupBy("id").agg(best.alias("_row")).select("id", *[f"_row.{c}" for c in columns])


def back_by(i: int):
    return lambda position: position - i


def phrases_of(group: Group) -> list[tuple[str, ...]]:
    """The terms of all clauses of a query, once each."""
    out: dict[tuple[str, ...], None] = {}
    for c in group.clauses:
        out |= dict.fromkeys([c.terms] if isinstance(c, Clause) else phrases_of(c))
    return list(out)


def terms_of(query: str, stemmed: bool = True) -> list[str]:
    """The terms of a query, once each."""
    return sorted({t for p in phrases_of(parse_query(query, stemmed)) for t in p})


def clause_frequencies(index: TextIndex, phrases: list[tuple[str, ...]]) -> DataFrame:
    """id and f0, f1, ...: how often a document has each term, or the terms of each phrase in adjacent places.

    One pass over the postings of the terms asked, for the documents that hold any of them.
    """
    terms = sorted({t for p in phrases for t in p})
    placed = {t for p in phrases if len(p) > 1 for t in p}
    one = lambda t, what: F.max(F.when(F.col("term") == t, F.col(what)))
    lists = [one(t, "positions").alias(f"p{terms.index(t)}") for t in sorted(placed)]
    counts = [F.coalesce(one(t, "tf"), F.lit(0)).alias(f"t{terms.index(t)}") for t in terms]
    held = index.postings.filter(F.col("term").isin(*terms)).groupBy("id").agg(*counts, *lists)

    def frequency(phrase: tuple[str, ...]) -> Column:
        if len(phrase) == 1:
            return F.col(f"t{terms.index(phrase[0])}")
        here = F.col(f"p{terms.index(phrase[0])}")
        for i, t in enumerate(phrase[1:], 1):
            here = F.array_intersect(here, F.transform(f"p{terms.index(t)}", back_by(i)))
        return F.coalesce(F.greatest(F.size(here), F.lit(0)), F.lit(0)).cast("long")

    return held.select("id", *[frequency(p).alias(f"f{i}") for i, p in enumerate(phrases)], *[F.col(f"t{i}") for i in range(len(terms))])


def clause_matches(index: TextIndex, phrase: tuple[str, ...]) -> DataFrame:
    """id, tf: documents with the term, or with the terms of a phrase in adjacent places."""
    return clause_frequencies(index, [phrase]).select("id", F.col("f0").alias("tf")).filter("tf > 0")


def satisfied(group: Group, phrases: list[tuple[str, ...]], score: list[Column]) -> tuple[Column, Column]:
    """Whether a document satisfies a group of clauses, and the sum of what its clauses score, those that exclude left out."""
    parts = []
    for c in group.clauses:
        if isinstance(c, Clause):
            i = phrases.index(c.terms)
            parts.append((c.occur, F.col(f"f{i}") > 0, score[i]))
        else:
            parts.append((c.occur, *satisfied(c, phrases, score)))
    must, should, never = ([p for p in parts if p[0] == kind] for kind in ("must", "should", "not"))
    wanted = reduce(and_, [m for _, m, _ in must]) if must else reduce(or_, [m for _, m, _ in should], F.lit(False))
    fits = reduce(and_, [~m for _, m, _ in never], wanted)
    return fits, reduce(add, [F.when(m, s).otherwise(F.lit(0.0)) for _, m, s in must + should], F.lit(0.0))


def boolean_scores(index: TextIndex, asked: Group, stats: DataFrame) -> DataFrame:
    """id, score of the documents that satisfy a query; a phrase counts as a term of its own with its parts' weights."""
    phrases = phrases_of(asked)
    terms = sorted({t for p in phrases for t in p})
    found = clause_frequencies(index, phrases)
    known = index.postings.filter(F.col("term").isin(*terms)).agg(*[F.count_if(F.col("term") == t).alias(f"d{i}") for i, t in enumerate(terms)])
    n, tf = F.col("n"), lambda i: F.col(f"f{i}")
    weight = lambda t: F.log(1 + (n - F.col(f"d{terms.index(t)}") + 0.5) / (F.col(f"d{terms.index(t)}") + 0.5))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    score = [reduce(add, [weight(t) for t in p]) * tf(i) * (K1 + 1) / (tf(i) + norm) for i, p in enumerate(phrases)]
    fits, total = satisfied(asked, phrases, score)
    joined = found.join(index.lengths, "id").crossJoin(F.broadcast(known)).crossJoin(F.broadcast(stats))  # one row each
    return joined.filter(fits).select("id", total.alias("score"))


def prose_scores(index: TextIndex, words: dict[str, int], stats: DataFrame) -> DataFrame:
    """id, score for any of the terms, in one pass over their postings."""
    times = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    held = index.postings.filter(F.col("term").isin(*words))
    frequency = held.groupBy("term").agg(F.count("*").alias("df"))  # one row for each term of the query
    n, df, tf, dl = F.col("n"), F.col("df"), F.col("tf"), F.col("dl")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5)) * times[F.col("term")]
    score = F.sum(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl"))))
    joined = held.join(F.broadcast(frequency), "term").join(index.lengths, "id").crossJoin(F.broadcast(stats))
    return joined.groupBy("id").agg(score.alias("score"))


def search(index: TextIndex, query: str, limit: int | None, allowed: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """id, score: the best of the documents whose ids are in ``allowed`` (None: of all), ties by id.

    Without a limit all that match, in no order.
    """
    asked = parse_query(query, stemmed)
    stats = index.statistics()
    if not asked.clauses or (limit is not None and limit <= 0):
        return index.lengths.filter("false").select("id", F.lit(0.0).alias("score"))
    if all(isinstance(c, Clause) and len(c.terms) == 1 and c.occur == "should" for c in asked.clauses):
        words: dict[str, int] = {}
        for c in asked.clauses:
            words[c.terms[0]] = words.get(c.terms[0], 0) + 1
        scored = prose_scores(index, words, stats)
    else:
        scored = boolean_scores(index, asked, stats)
    if allowed is not None:
        scored = scored.join(allowed.select("id"), "id", "left_semi")
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)

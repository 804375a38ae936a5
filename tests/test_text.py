import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import Clause, Group, parse_query, query_terms, raw_terms, snippet, stem, transcript_text


@pytest.mark.parametrize(("word", "want"), [("running", "run"), ("happiness", "happi"), ("hopped", "hop"), ("hoping", "hope"), ("cries", "cri"), ("dying", "die"), ("sky", "sky"), ("generously", "generous"), ("naïve", "naïve"), ("at", "at")])
def test_stems(word, want):
    assert stem(word) == want


def test_query_and_document_terms_agree(spark):
    for text in ("Memory leak, again!", "内存泄漏 leak", "a" * 50 + " b", "x_y 3.14", ""):
        got = spark.createDataFrame([(text,)], "t string").select(raw_terms(F.col("t"))).first()[0]
        assert got == query_terms(text, stemmed=False)


def test_pairs_meet_across_an_inserted_character():
    assert set(query_terms("内存泄漏")) & set(query_terms("内存的泄漏"))


def test_parsing():
    assert parse_query("a b, a", False) == Group((Clause(("a",), "should"), Clause(("b",), "should"), Clause(("a",), "should")), "should")
    assert parse_query('"x y" -z', False) == Group((Clause(("x", "y"), "should"), Clause(("z",), "not")), "should")
    assert parse_query('"x" AND "y"', False) == Group((Clause(("x",), "must"), Clause(("y",), "must")), "should")
    assert parse_query('say "hi', False) == Group((Clause(("say",), "should"), Clause(("hi",), "should")), "should")
    assert parse_query("?!", False).clauses == ()


def test_snippet(spark):
    rows = spark.createDataFrame([("  two\n words ", "x"), (" ", "answer"), ("y" * 201, "")], "u string, a string")
    assert [r[0] for r in rows.select(snippet(F.col("u"), F.col("a"))).collect()] == ["two words", "answer", "y" * 200 + "..."]


def test_transcript_keeps_head_and_tail(spark):
    row = spark.range(1).select(F.array(F.struct(F.lit("q" * 30).alias("user"), F.lit("a" * 30).alias("assistant"))).alias("t"))
    text = row.select(transcript_text(F.col("t"), 20)).first()[0]
    assert text == "User: qqqq\n[…]\n" + "a" * 10

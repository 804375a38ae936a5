import pytest
from pyspark.sql import functions as F

from colloquy.operators import bm25, filters, fusion, knn
from colloquy.operators.filters import SearchFilter, SearchRequest


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")


def ids(df):
    return [r.id for r in df.collect()]


def test_denser_and_rarer_first(spark):
    index = bm25.build(texts(spark, "cache cache miss", "cache one two three four five", "other words here", "leak leak leak cache"))
    assert ids(bm25.search(index, "cache", 3))[0] == 0
    assert ids(bm25.search(index, "cache leak", 5))[0] == 3
    assert 2 not in ids(bm25.search(index, "cache leak", 5))


@pytest.mark.parametrize("stemmed", [True, False])
def test_index_of_asked_terms(spark, tmp_path, stemmed):
    docs = texts(spark, "Red greens, blue greens", "", None, "greens", "日本語 red 日本", "blue").unionByName(spark.createDataFrame([(0, "blue greens red"), (7, "none")], "id long, text string"))
    want, terms = bm25.build(docs, stemmed=stemmed), bm25.terms_of('"red greens" -blue 日本', stemmed)
    got = bm25.asked(docs, terms, f"{tmp_path}/a", stemmed=stemmed)
    key = lambda r: str(tuple(r))
    postings = lambda i: sorted(i.postings.filter(F.col("term").isin(*terms)).select("term", "id", "tf", "positions").collect(), key=key)
    assert postings(got) == postings(want)
    assert got.postings.count() == len(postings(want)) == 7
    assert sorted(got.lengths.collect(), key=key) == sorted(want.lengths.collect(), key=key)
    nothing = bm25.asked(docs, [], f"{tmp_path}/b", stemmed=stemmed)
    assert (nothing.postings.count(), nothing.lengths.count()) == (0, docs.count())


def test_stemmed_forms_match_and_punctuation_is_harmless(spark):
    index = bm25.build(texts(spark, "the indexes were rebuilt", "nothing"))
    assert ids(bm25.search(index, "index()[]{}*?~^:\\", 5)) == [0]
    assert ids(bm25.search(index, "()[]", 5)) == []
    assert ids(bm25.search(index, "index", 0)) == []


def test_phrase_and_boolean(spark):
    index = bm25.build(texts(spark, "red green blue", "green red blue", "blue only", None), stemmed=False)
    assert ids(bm25.search(index, '"red   green"', 5, stemmed=False)) == [0]
    assert sorted(ids(bm25.search(index, '"blue" -red', 5, stemmed=False))) == [2]
    assert sorted(ids(bm25.search(index, '+"blue" (red OR only)', 5, stemmed=False))) == [0, 1, 2]
    assert ids(bm25.search(index, "blue", 5, allowed=texts(spark, "x").filter("id = 9"))) == []


def test_knn_boundaries(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0]), (3, [1.0])], "id long, embedding array<float>")
    assert ids(knn.top_k(v, [1.0, 0.0], 2)) == [0, 1]
    assert len(ids(knn.top_k(v, [1.0, 0.0], 99))) == 3
    assert ids(knn.top_k(v, [1.0, 0.0], 0)) == []
    with pytest.raises(ValueError, match="dimensions"):
        knn.top_k(v, [1.0], 2, dimension=2)


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 1, 1), (0, 5, 2), (1, 2, 1), (1, 5, 2), (1, 5, 9)], "list_no int, id long, rank int")
    got = fusion.in_order(fusion.fuse(lists)).collect()
    assert [r.id for r in got] == [5, 1, 2]
    assert got[0].score == pytest.approx(2 / 62)
    assert got[1].rank_1 is None
    assert fusion.fuse(lists.filter("false")).count() == 0


def test_concepts(spark):
    v = spark.createDataFrame([(i, [1 - i / 10, i / 10]) for i in range(11)], "id long, embedding array<float>")
    got = fusion.all_concepts(v, [[1.0, 0.0], [0.0, 1.0]], 2).collect()
    assert all(len(r.similarities) == 2 for r in got)
    assert {r.id for r in got} <= set(range(1, 10))


EX = "id long, project string, session_id string, harness string, timestamp string, user_message string, assistant_message string, is_sidechain boolean"


def test_dates_differ_by_path(spark):
    rows = spark.createDataFrame([(0, "p", None, None, "2026-06-01T10:00:00Z", "a", "b", None), (1, "p2", None, "codex", "", "a", "b", None)], EX)
    where = SearchFilter(before="2026-06-01")
    assert ids(rows.filter(filters.lexical(where))) == [0]
    assert ids(rows.filter(filters.by_epoch(where))) == [1]
    assert ids(rows.filter(filters.by_epoch(SearchFilter(before="2026-13-45")))) == [0, 1]
    assert ids(rows.filter(filters.equal(SearchFilter(project="p")))) == [0]
    assert ids(rows.filter(filters.equal(SearchFilter(harness="claude")))) == [0]
    assert filters.matching_ids(rows, SearchFilter()) is None


def test_substring_scan(spark):
    rows = spark.createDataFrame([(i, "p", None, None, "2026-01-01T00:00:00Z", "Find ME", "x", i == 2) for i in range(4)], EX)
    assert ids(filters.substring_scan(rows, "me", limit=2)) == [3, 1]


def test_requests():
    for bad in ({"query": "x"}, {"query": ("ab",)}, {"query": "ab", "limit": 0}, {"query": "ab", "mode": "fast"}, {"query": "ab", "where": SearchFilter(after="today")}, {"query": "ab", "where": SearchFilter(project="")}, {"query": "ab", "where": SearchFilter(session_id="")}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)
    assert SearchRequest("ab").limit == 10


def test_epoch(spark):
    rows = spark.createDataFrame([("1969-01-01T00:00:00Z",), ("nonsense",), ("1970-01-01T00:00:01Z",)], "t string")
    assert [r[0] for r in rows.select(filters.epoch_ms(F.col("t"))).collect()] == [0, 0, 1000]


def test_stemmed_search_equals_plain_bm25(spark, tmp_path):
    """The registered query against dictionaries: tokens by a pattern, stems by the published rules, scores summed up."""
    import math
    import random
    import re
    from collections import Counter

    from colloquy.functions.text import stem
    from colloquy.plans import catalogue

    rng = random.Random(2)
    words = ["thing", "things", "thinging", "sting", "stings", "stinging", "other", "others", "run", "Running", "sky", "x" * 45]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for i in range(60)}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()] + [(90, None, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    stems = {i: Counter(stem(w) for w in re.findall("[a-z]+", t.lower()) if len(w) < 40) for i, t in texts.items()}
    mean = sum(c.total() for c in stems.values()) / len(stems)
    score = Counter()
    for term in ("thing", "sting"):
        df = sum(term in c for c in stems.values())
        for i, c in stems.items():
            if tf := c[term]:
                score[i] += math.log(1 + (len(stems) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * c.total() / mean))
    want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10]
    got = catalogue.QUERIES["bm25_stemmed"](spark, str(tmp_path)).collect()
    assert [r.id for r in got] == [i for i, _ in want] and [r.score for r in got] == pytest.approx([s for _, s in want], abs=1e-6)


def test_boolean_queries_equal_sets(spark):
    import itertools

    rows = [" ".join(c) for n in range(5) for c in itertools.combinations("abcd", n)]
    index = bm25.build(texts(spark, *rows), stemmed=False)
    has = [set(r.split()) for r in rows]
    for query, fits in {
        '"a" AND "b"': lambda h: {"a", "b"} <= h,
        '"a" OR "b"': lambda h: bool({"a", "b"} & h),
        '+"a" -b -"c"': lambda h: "a" in h and not {"b", "c"} & h,
        '("a" AND "b") OR ("c" AND "d")': lambda h: {"a", "b"} <= h or {"c", "d"} <= h,
        '+"d" ("a" OR "b")': lambda h: "d" in h,
        '"b c" -d': lambda h: {"b", "c"} <= h and "d" not in h,
        '-"a"': lambda h: False,
    }.items():
        assert sorted(ids(bm25.search(index, query, None, stemmed=False))) == [i for i, h in enumerate(has) if fits(h)], query
    scored = {r.id: r.score for r in bm25.search(index, '"a" AND "b"', None, stemmed=False).collect()}
    plain = {r.id: r.score for r in bm25.search(index, "a b", None, stemmed=False).collect()}
    assert all(scored[i] == pytest.approx(plain[i]) for i in scored)


def test_terms_of_scripts_without_spaces(spark):
    from colloquy.functions.text import query_terms, raw_terms

    rows = ["plain words 12", "数据库index很慢", "한국어 text", "", None, "データ!"]
    got = [r[0] for r in texts(spark, *rows).orderBy("id").select(raw_terms(F.col("text"))).collect()]
    assert got[0] == ["plain", "words", "12"] and got[1] == ["数据", "据库", "index", "很慢"] and got[4] is None
    assert [g for g, r in zip(got, rows, strict=True) if r is not None] == [query_terms(r, stemmed=False) for r in rows if r is not None]


@pytest.mark.parametrize("stemmed", [True, False])
def test_rows_make_their_postings_without_a_shuffle(spark, stemmed):
    docs = texts(spark, "Red greens, green reds red", "", None, "greens", "日本語 red 日本", "blue").repartition(2)
    want, got = bm25.build(docs, stemmed=stemmed), bm25.build(docs, stemmed=stemmed, unique=True)
    assert sorted(map(tuple, got.postings.collect())) == sorted(map(tuple, want.postings.collect()))
    assert sorted(map(str, got.lengths.collect())) == sorted(map(str, want.lengths.collect()))
    assert "hashpartitioning" not in got.postings._jdf.queryExecution().executedPlan().toString()


def test_formats_are_told_by_the_files_own_rows(spark):
    from colloquy.plans.catalogue import FILES
    from colloquy.sources import transcripts

    second = '{"type":"event_msg","payload":{"a":1}}'
    odd = [("x1", 1, "not json\r\n\n" + second), ("x2", 1, '{"type":"event_msg","payload":""}\n' + second), ("x3", 1, "3\n" + second), ("x4", 1, second + '\n{"type":"user"}'), ("x5", 1, "no")]
    files = spark.createDataFrame(FILES + odd, "path string, mtime_ms long, text string")
    lines = transcripts.lines_of(files)
    for harness, got in zip(("claude", "codex"), transcripts.lines_by_format(files), strict=True):
        want = lines.join(transcripts.detect_formats(lines).filter(F.col("harness") == harness), "path", "left_semi")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_stream_looks_at_many_files_in_few_tasks(spark, tmp_path):
    from colloquy.operators.store import Store
    from colloquy.streaming import ingest

    (tmp_path / "in").mkdir()
    for i in range(60):
        (tmp_path / "in" / f"{i}.jsonl").write_text('{"type":"user","message":{"content":"q"}}\n{"type":"assistant","message":{"content":"a"}}\n')
    held = Store(spark, f"{tmp_path}/store")
    status = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    ingest.sync_stream(spark, f"{tmp_path}/in", held, f"{tmp_path}/checkpoint", "2026-06-01T00:00:00Z").awaitTermination()
    assert held.read("exchanges").count() == 60
    found = stages()
    assert max(found.apply(i).numTasks() for i in range(found.size()) if found.apply(i).stageId() not in known) < 60

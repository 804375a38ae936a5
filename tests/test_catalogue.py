import math
import os

import pytest

from colloquy.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows(df):
    cell = lambda x: None if x is None or x != x else float(f"{x:.5f}") if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) else str(x)
    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        for t in os.listdir(DATA):
            con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
        want = con.sql(catalogue.SQL[name]).df()
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    na = lambda df: df.astype(object).where(df.notna(), None)
    assert rows(na(got)) == rows(na(want))


TEXT = ("doc_lengths", "phrase_match", "hybrid_provenance", "bm25_dup_term", "hybrid_filtered", "bm25_stemmed", "bm25_or", "bool_and", "corpus_stats", "term_df")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", TEXT)
def test_text_queries_write_a_row_a_document_at_most(spark, name, tmp_path, monkeypatch):
    folders = []
    monkeypatch.setattr(catalogue, "scratch_folder", lambda _: folders.append(f"{tmp_path}/{len(folders)}") or folders[-1])
    catalogue.QUERIES[name](spark, DATA).collect()
    wrote = sum(spark.read.option("recursiveFileLookup", "true").parquet(f).count() for f in folders)
    assert wrote <= catalogue.table(spark, DATA, "documents").count()
    assert len(folders) == (name not in ("doc_lengths", "corpus_stats", "term_df"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_migrated_vectors_are_the_new_embedders(spark):
    from colloquy.functions.embed import HashEmbedder
    from colloquy.functions.text import embedded_text

    rows = catalogue.exchanges(spark, DATA).orderBy(catalogue.F.col("conv_id").cast("string"), "line_start").select(embedded_text(catalogue.F.col("user_message"), catalogue.F.col("assistant_message")).alias("text")).collect()
    want = HashEmbedder(32).embed([r.text for r in rows])
    got = {r.id: r.embedding for r in catalogue.QUERIES["embed_migration"](spark, DATA).collect()}
    assert sorted(got) == list(range(len(rows)))
    assert all(got[i] == pytest.approx(list(map(float, want[i])), abs=1e-6) for i in got)

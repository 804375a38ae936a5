"""Each stage of the pipeline on what the one before it kept, against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from colloquy.llm import mixing, quality, simhash
from colloquy.llm.tokens import tokenizer_path

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def rows():
    out = [(i, prose(i, 40 + i % 90), "en", f"s{i % 3}") for i in range(240)]
    out += [(i, " ".join(w + "&&&#" for w in prose(i, 50).split()), "en", "s0") for i in range(240, 360)]
    shared = prose(9001, 70)
    out += [(400 + i, f"{prose(7000 + i, 30)} {shared} {prose(8000 + i, 30)}", "en", "s1") for i in range(6)]
    out += [(500 + i, out[7][1], "fr", "s2") for i in range(5)]  # exact copies
    out += [(600 + i, out[80 + i][1] + " oneword", "fr", None) for i in range(5)]  # near ones
    out += [(700, "", "en", "s0"), (701, None, None, None), (702, " \n", "en", "s1"), (703, prose(3, 4000), "en", "s0")]
    out += [(704, prose(4, 60), "en", "s0"), (704, prose(5, 60), "en", "s0"), (None, prose(6, 60), "en", "s0"), (None, prose(8, 60), "en", None)]
    return [(*r, len(r[1] or "")) for r in out]


def cut_plainly(docs, window=20):
    seen, out = set(), Counter()
    for r in docs:
        words = (r["text"] or "").split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        if not any(gone):
            out[r["doc_id"], r["text"]] += 1
        elif kept:
            out[r["doc_id"], " ".join(kept)] += 1
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 240)) for i in range(360)] + [(None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in before.schema]
        found[name] = [r.asDict() for r in docs.collect()]
    key = lambda r: (r["doc_id"], r["text"])

    start = spark.read.parquet(f"{folder}/documents.parquet")
    scores = Counter((r.doc_id, r.score >= quality.ACCEPT) for r in quality.scores(start, spark.read.parquet(f"{folder}/labels.parquet")).collect())
    assert Counter(r["doc_id"] for r in found["quality"]) == Counter({i: n for (i, good), n in scores.items() if good})
    held = [i for i in range(360) if zlib.crc32(str(i).encode()) % 5 == 0]
    there = {r["doc_id"] for r in found["quality"]}
    assert np.mean([(i in there) == (i < 240) for i in held]) > 0.95

    texts = [r["text"] for r in found["quality"]]
    fps = simhash.sketch(pa.array(texts), 5, 16)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        merged = {group[j] for j in np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= 4).any(1))}
        group = [min(merged) if g in merged else g for g in group]
    assert len(found["near_copies"]) == len(set(group))
    assert not Counter(map(key, found["near_copies"])) - Counter(map(key, found["quality"]))
    kept = {r["doc_id"] for r in found["near_copies"]}
    assert not kept & set(range(500, 505)) and len(kept & set(range(80, 85))) == 5 and not kept & set(range(600, 605))

    order = sorted(found["near_copies"], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert Counter(map(key, found["passages"])) == cut_plainly(order)
    assert all(r["n_chars"] == len(r["text"] or "") for r in found["passages"])

    passages = spark.read.parquet(str(tmp_path / "passages"))
    assert len(found["mixing"]) == sum(r.copies for r in mixing.copies(passages).collect())
    assert set(map(key, found["mixing"])) <= set(map(key, found["passages"]))
    sizes = {}
    for r in mixing.copies(passages).collect():
        sizes[r.source] = (r.target, r.source_size)
    for source, (target, size) in sizes.items():
        words = sum(len((r["text"] or "").split()) for r in found["mixing"] if r["source"] == source)
        longest = max(len((r["text"] or "").split()) for r in found["passages"] if r["source"] == source)
        assert abs(words - target) <= 0.1 * size + longest, source  # documents are taken whole

    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], len(tool.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in found["mixing"])
    whole = Counter()
    for r in found["packing"]:
        whole[r["doc_id"]] += r["length"]
    totals = Counter()
    for (i, n), times in want.items():
        totals[i] += n * times
    assert whole == totals
    ends = Counter()
    for r in found["packing"]:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024


def test_run_is_the_stages_in_turn(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    first = sorted(map(tuple, got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    again = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    assert first and first == again


def test_stages_of_nothing(spark, folder):
    none = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name

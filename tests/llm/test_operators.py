"""Each document operator against a plain version on a small table that holds the awkward cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import media, mixing, packing, quality, simhash, substring, token_store, topk, toxicity, url_filter
from colloquy.llm.shared import shared_path
from colloquy.llm.tokens import Encoder, encoder, tokenizer_path

#: Columns whose names clash with the operators' own.
KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, _class string, fp string, score string"


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(n))


def texts():
    shared, long = passage(1, 60), passage(2, 9000)
    rows = [(i, passage(100 + i, 30 + i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(40, "", "en", "s0"), (41, None, None, None), (42, "one two", "en", "s1"), (43, " \t\n", "en", "s1"), (44, long, "en", "s0")]
    rows += [(50 + i, passage(200 + i, 15) + "\n" + shared + " " + passage(300 + i, 15), "en", "s2") for i in range(5)]
    rows += [(60 + i, rows[3][1], "en", "s0") for i in range(4)] + [(70, rows[3][1].upper(), "fr", "s1"), (71, "word " * 90, "fr", "s1")]
    rows += [(45, "marked <|endoftext|> text", "en", "s1"), (46, passage(8, 30) + " " + "z" * 5000, "en", "s0")]
    rows += [(72, long + " end", "fr", "s1"), (80, passage(9, 50), "en", "s1"), (80, passage(9, 50), "en", "s1")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "k", "x", "c", "f", "s") for r in rows], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_simhash(docs, none):
    def plain(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {i: plain(t) for i, t, *_ in texts()}
    group = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    got = simhash.components(docs, k=4, radius=4).collect()
    assert len(got) == len(texts())
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (fps[i], group[i]) for i in fps}
    assert sorted(r.doc_id for r in simhash.dedup(docs, 4, 4).select("doc_id").collect()) == sorted(i for i, *_ in texts() if group[i] == i)
    assert simhash.components(none).count() == 0


def components_by_brute_force(numbers):
    """Each number's class under links of four differing bits or fewer."""
    values = np.unique(np.array(numbers, np.uint64))
    root = np.arange(len(values))
    for i, v in enumerate(values):
        near = np.flatnonzero(np.bitwise_count(values ^ v) <= 4)
        root[np.isin(root, root[near])] = root[near].min()
        root[i] = root[near].min()
    return {int(v): int(r) for v, r in zip(values, root, strict=True)}


@pytest.mark.parametrize("small", [False, True])
def test_simhash_finds_all_within_the_radius(spark, monkeypatch, small):
    """Random fingerprints and, of each, one at each distance from 0 to 6, over the whole path; small parts divide further."""
    if small:
        monkeypatch.setattr(simhash, "VARIANTS", 2000)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 60).astype(np.uint64)
    made = [int(b) for b in base]
    for b in base:
        for distance in range(7):
            made.append(int(b) ^ sum(1 << int(i) for i in rng.choice(64, distance, replace=False)))
    want = components_by_brute_force(made)
    signed = [(0, int(np.uint64(v).view(np.int64))) for v in want]
    found = simhash.links(spark.createDataFrame(signed, "number int, fp long").repartition(3), 7).collect()
    root = {v: v for v in want}
    for r in found:
        a, b = (int(np.int64(x).view(np.uint64)) for x in (r.a, r.b))
        assert r.number == 0
        x, y = root[a], root[b]
        root = {v: min(x, y) if c in (x, y) else c for v, c in root.items()}
    groups = lambda m: sorted(sorted(v for v in m if m[v] == c) for c in set(m.values()))
    assert groups(root) == groups(want)


def test_sketches_equal_plain_ones():
    import pyarrow as pa

    from colloquy.llm.bytewords import flat, mix, pair_hashes, run_hashes, span_hashes, spaced_words

    rows = [passage(i, n) for i, n in enumerate((0, 1, 3, 5, 6, 40, 700))] + [None, passage(5, 40).upper()]
    got = simhash.sketch(pa.array(rows), 5, 3)
    for text, fps in zip(rows, got, strict=True):
        data, at = flat(pa.array([(text or "").lower()]))
        words = span_hashes(data, *spaced_words(data, at)[:2])
        hashes = [int(run_hashes(words[i : i + 5], min(5, len(words)))[0]) for i in range(max(1, len(words) - 4))] if len(words) else []
        for n in range(3):
            mixed = [int(mix(np.array([(h + (n + 1) * simhash.FOLD) % (1 << 64)], np.uint64))[0]) for h in hashes]
            assert int(fps[n]) == sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed))
    assert (got[5] == got[8]).all() and not got[0].any()


def test_sketch_classes_equal_brute_force(spark):
    import pyarrow as pa

    rng = random.Random(6)
    rows = []
    for i in range(40):
        words = passage(500 + i, rng.randrange(3, 300)).split()
        for j in range(4):
            copy = [w if rng.random() > 0.01 * j else "new" + w for w in words]
            rows.append((10 * i + j, " ".join(copy), "en", "s"))
    rows += [(900, "", "en", "s"), (901, None, "en", "s"), (7, rows[3][1], "en", "s"), (None, rows[50][1], "en", "s"), (None, "of its own and of no other here", "en", "s")]
    fps = simhash.sketch(pa.array([r[1] for r in rows]), 5, 6)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        near = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= 4).any(1))
        least = min(group[j] for j in near)
        merged = {group[j] for j in near}
        group = [least if g in merged else g for g in group]
    classes = {}
    for r, g in zip(rows, group, strict=True):
        classes.setdefault(g, []).append(r)
    kept = simhash.dedup(frame(spark, rows).repartition(3), 5, 4, number=6).collect()
    assert len(kept) == len(classes)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(min(r[0] for r in c if r[0] is not None) for c in classes.values() if any(r[0] is not None for r in c))
    assert simhash.dedup(frame(spark, []), 5, 4, number=6).count() == 0


def test_contraction(spark):
    from colloquy.llm.shared import Scratch

    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (102, 101), (7, 7)], "a long, b long"))
    got = simhash.contract(chain, Scratch(spark, "t")).collect()
    roots = {r.v: r.root for r in got}
    assert len({roots[i] for i in range(41)}) == 1 and len({roots[i] for i in (100, 101, 102)}) == 1 and len(set(roots.values())) == 2


def cut_plainly(rows, window=20):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        if i in out:
            continue
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = b" ".join(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_substring(docs, none):
    want = cut_plainly(texts())
    got = substring.removals(docs, 20).collect()
    assert len(got) == len(texts())
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha256) for r in got} == {i: w[:3] for i, w in want.items()}
    kept = {r.doc_id: r.text for r in substring.dedup(docs, 20).collect()}
    source = {i: t for i, t, *_ in texts()}
    assert kept == {i: source[i] if not w[1] else w[3] for i, w in want.items() if not w[1] or w[3]}
    assert substring.removals(none, 20).count() == 0 and substring.dedup(none, 20).count() == 0


@pytest.mark.parametrize(("window", "seed"), [(20, 0), (8, 1), (7, 2), (1, 3), (40, 4)])
def test_substring_on_few_words(spark, monkeypatch, window, seed):
    """Words of a small alphabet repeat in every way; small units and buckets make all of them exchange."""
    rng = random.Random(seed)
    blocks = [" ".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(blocks) for _ in range(rng.randrange(4))), "en", "s") for i in range(60)]
    want = cut_plainly(rows, window)
    monkeypatch.setattr(substring.units, "__defaults__", (300,))
    got = substring.removals(frame(spark, rows).repartition(5), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha256) for r in got} == {i: w[:3] for i, w in want.items()}


def test_substring_tells_alternating_words_apart(spark):
    """Two words of 1,024 bytes that a polynomial modulo a power of two takes for one another."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    common = passage(77, 19)
    got = {r.doc_id: r.n_removed for r in substring.removals(frame(spark, [(1, f"{common} {one}", "en", "s"), (2, f"{common} {other}", "en", "s"), (3, f"{common} {one}", "en", "s")]), 20).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_substring_levels():
    assert substring.levels(20) == [5, 10, 20] and substring.levels(7) == [7] and substring.levels(40) == [5, 10, 20, 40]


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    bits = ["'s", "'t", "'re", "'", "s", " ", "  ", "\n", "\t", "a", "B", "é", "Σ", "1", "²", "漢", ".", "!", "_", " ", "　", "́", "word", "ß", "İ", "😀", "x" * 300]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        plain = Tokenizer.from_file(tokenizer_path(name))
        plain.encode_special_tokens = True
        tool = Encoder(tokenizer_path(name), spaced)
        rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(10))) for _ in range(1500)] + ["<|endoftext|> x", ""]
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
        ids, sizes = tool.encode(data, offsets)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [plain.encode(r, add_special_tokens=False).ids for r in rows]


def test_added_tokens_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|", "|>", "'s", "'", " ", "\n", "a", "B", "é", "́", "漢", "1", "x" * 300]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        default, tool = Tokenizer.from_file(tokenizer_path(name)), encoder(tokenizer_path(name), spaced)
        rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(1500)] + ["a <|endoftext|> b", "", "<|endoftext|>", "<|endof", "text|>", "<|endoftext|", "<|endoftext|>"]
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
        ids, sizes = tool.encode(data, offsets)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [default.encode(r, add_special_tokens=False).ids for r in rows]


def plain_ids(name):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: [*tool.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing(docs, none):
    ids = plain_ids("byte_bpe_50k.json")
    got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=256).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, *_ in texts())
    for i, text, *_ in texts():
        own = ids(text)
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i})
        assert [m[0] for m in mine] == list(range(len(mine))) and sum(m[2] for m in mine) == len(own) and all(m[2] == 256 for m in mine[1:])
        assert all(crc(own[s : s + n]) == c for _, s, n, c in mine)
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 256 and len(at) <= -(-sum(at.values()) // 256) + 2
    assert packing.pack(none, tokenizer_path("byte_bpe_50k.json")).count() == 0


def best_fit_decreasing(sizes, capacity):
    """The number of bins that best fit needs for the sizes, longest first."""
    bins, rooms = 0, [0] * (capacity + 1)
    for s in sorted(sizes, reverse=True):
        room = next((r for r in range(s, capacity + 1) if rooms[r]), None)
        bins += room is None
        rooms[capacity if room is None else room] -= room is not None
        rooms[(capacity if room is None else room) - s] += 1
    return bins


LENGTHS = {
    **{f"lognormal{i}": lambda rng, i=i: np.minimum(1024, np.exp(rng.normal(5.5 + i / 3, 1, 4000)).astype(int) + 1) for i in range(4)},
    "uniform": lambda rng: rng.integers(1, 1025, 3000),
    "middle": lambda rng: rng.integers(300, 480, 3000),
    "few": lambda rng: rng.choice([400, 312, 324, 300, 1024], 3000),
    "corpus": lambda rng: np.concatenate([np.full(1800, 1024), rng.integers(2, 1024, 3000), np.exp(rng.normal(3, 1, 900)).astype(int) + 1]),
}


@pytest.mark.parametrize("kind", sorted(LENGTHS))
def test_plans_hold_all_and_are_no_worse_than_best_fit(kind):
    sizes = LENGTHS[kind](np.random.default_rng(7))
    counts = Counter(sizes.tolist())
    runs, held = packing.plan(counts), Counter()
    for n, lengths in runs:
        assert n > 0 and sum(lengths) <= 1024
        for s in lengths:
            held[s] += n
    assert held == counts
    used = sum(n for n, _ in runs)
    assert -(-int(sizes.sum()) // 1024) <= used <= best_fit_decreasing(sizes.tolist(), 1024)
    if kind == "few":  # by configurations: 400 + 312 + 312 and 400 + 324 + 300 are full
        assert used < best_fit_decreasing(sizes.tolist(), 1024)


def test_plans_of_nothing_and_of_one_length():
    assert packing.plan({}) == []
    assert packing.plan({1024: 5}) == [[5, [1024]]]
    assert sum(n for n, _ in packing.plan({512: 7})) == 4 and sum(n for n, _ in packing.plan({1: 3000})) == 3


@pytest.mark.parametrize("kinds", [1, 2, 3, 700, 20000])
def test_huffman(kinds):
    rng = np.random.default_rng(kinds)
    counts = np.zeros(65536, np.int64)
    counts[rng.choice(65536, kinds, False)] = rng.zipf(1.4, kinds).clip(1, 10**6)
    lengths = token_store.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= token_store.LIMIT and (2.0 ** -lengths[lengths > 0]).sum() <= 1
    codes, tables = token_store.canonical(lengths), token_store.decoding_table(lengths)
    for n in (0, 1, 128, 129, 5000):
        ids = rng.choice(np.flatnonzero(counts), n).astype(np.uint16)
        bits, at = token_store.pack_bits(ids, codes, lengths)
        assert (token_store.unpack_bits(bits, at[:: token_store.CHECKPOINT], n, *tables) == ids).all()


def test_token_files(spark, docs, none, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_BYTES", 20_000)
    ids = plain_ids("word_bpe_49k.json")
    path = shared_path(spark, "t")
    token_store.write(docs, path, tokenizer_path("word_bpe_49k.json"))
    got = sorted(token_store.digests(spark, path).collect(), key=lambda r: r.start)
    assert len(spark.read.parquet(f"{path}/blocks").select("file").distinct().collect()) > 1
    want, at = [], 0
    for i, text, *_ in sorted(texts(), key=lambda r: r[0]):
        own = ids(text)
        want.append((i, at, len(own), crc(own)))
        at += len(own)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    path = shared_path(spark, "t")
    token_store.write(none, path, tokenizer_path("word_bpe_49k.json"))
    assert token_store.digests(spark, path).count() == 0


def test_token_digests_take_one_worker_a_core(spark, docs):
    """Two Python steps in one stage hold two workers a core, each with its tables, for whatever runs next."""
    path = shared_path(spark, "t")
    token_store.write(docs, path, tokenizer_path("word_bpe_49k.json"))
    digests = token_store.digests(spark, path)
    assert digests._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    read = {(r.file, r.block, r.place): (r.doc_id, r.n_tokens, zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())) for r in token_store.read(spark, path).collect()}
    assert sorted(read.values()) == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in digests.collect())


def test_media(spark, docs, none):
    folder = shared_path(spark, "m")
    stored = docs.sparkSession.createDataFrame(media.store(docs, folder).collect(), media.STORED)
    assert stored.count() == len(texts())
    objects = media.catalogue(stored)
    found = {r.digest: r for r in media.features(objects, folder).collect()}
    shapes = {r.digest: r for r in media.headers(objects, folder).collect()}
    for r in stored.collect():
        text = dict((i, t) for i, t, *_ in texts())[r.doc_id]
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        f = found[r.digest]
        assert (r.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (shapes[r.digest].width, shapes[r.digest].height) == (64, len(padded) // 64)
        plain = b"".join(b"\0" + padded[i : i + 64] for i in range(0, len(padded), 64))
        head = struct.pack(">IIBBBBB", 64, len(padded) // 64, 8, 0, 0, 0, 0)
        png = b"\x89PNG\r\n\x1a\n"
        for kind, body in ((b"IHDR", head), (b"IDAT", zlib.compress(plain, 6)), (b"IEND", b"")):
            png += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        assert (f.media_bytes, f.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        steps = sum(abs(padded[i] - padded[i - 1]) for i in range(1, len(padded)) if i % 64)
        histogram = zlib.crc32(struct.pack("<256q", *(padded.count(b) for b in range(256))))
        assert f.feature == f"64x{len(padded) // 64} sum={sum(padded)} distinct={len(set(padded))} steps={steps} histogram={histogram:08x}"
    import tarfile

    shard = stored.first().shard
    with tarfile.open(f"{folder.removeprefix('file://')}/{shard}") as tar:
        assert all(hashlib.sha256(media.from_png(tar.extractfile(m).read()).tobytes()).hexdigest() == m.name[:-4] for m in tar)
    assert media.store(none, folder).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.copies(docs).collect()
    assert len(got) == len(texts())
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    targets = {s: rows[0].target for s, rows in by.items()}
    assert sum(targets.values()) == pytest.approx(min(total, sum(3 * rows[0].source_size for rows in by.values())))
    for s, rows in by.items():
        size, rate = rows[0].source_size, rows[0].target / max(1, rows[0].source_size)
        assert size == sum(r.size for r in rows) and rows[0].target <= 3 * size + 1e-6 and all(0 <= r.copies <= 3 for r in rows)
        assert abs(sum(r.copies for r in rows) - rate * len(rows)) < 1, s
    taken = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert taken == Counter({i: n for i, n in ((r.doc_id, r.copies) for r in got) if n} | ({80: 2 * max(r.copies for r in got if r.doc_id == 80)} if any(r.copies for r in got if r.doc_id == 80) else {}))
    assert mixing.copies(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_matches_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    rows = [(i, passage(i, rng.randrange(0, 200)) or None, "en", rng.choice(["a", "b", "é", "z", None, "a", "a"])) for i in range(600)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, mixing.op10_mix(spark, str(tmp_path)).collect()))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(con.sql(mixing.SQL).fetchall())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_stages_tell_rows_with_one_id_apart(spark):
    a, b, c, d, e = (passage(900 + i, 60) for i in range(5))
    rows = [(1, a, "en", "s"), (None, a, "en", "s"), (None, b, "en", "s"), (None, b, "en", "s"), (None, c, "en", "t"), (7, a, "en", "s"), (7, d, "en", "t"), (8, e, "en", "s")]
    docs = frame(spark, rows)
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.dedup(docs, 4, 4).collect())
    assert kept == sorted([(1, a), (0, b), (0, c), (7, d), (8, e)])
    tail = passage(990, 25)
    got = Counter((r.doc_id, r.text) for r in substring.dedup(frame(spark, [(None, a, "en", "s"), (None, b + " " + tail, "en", "s"), (3, tail + " x", "en", "s"), (4, a, "en", "s"), (4, c, "en", "s"), (5, d, "en", "s"), (5, d + " y", "en", "s")]), 20).collect())
    assert got[(None, a)] == 1 and got[(None, b + " " + tail)] == 1 and got[(3, "x")] == 1 and got[(4, c)] == 1 and (4, a) not in got and got[(5, d)] + got[(5, d + " y")] >= 1
    nulls = frame(spark, [(None, f"{passage(3000 + i, 25)} {a} {passage(4000 + i, 25)}", "en", "s") for i in range(30)])
    assert sorted(r.n_removed >= 60 for r in substring.removals(nulls, 20).collect()) == [False] + [True] * 29
    docs = frame(spark, [(None if i % 2 else 5, passage(2000 + i, 50), "en", "s" + str(i % 3)) for i in range(90)])
    assert mixing.mix(docs).count() == sum(r.copies for r in mixing.copies(docs).collect())


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (rng.random(6) < 0.7)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (250, rows[3][1]), (300, [0.5, 0.25])]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = {}
    for r in topk.top_k(v, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    whole = {i: np.floor(256 * np.array(x, np.float32).astype(float)) for i, x in rows if x and None not in x and np.isfinite(x).all()}
    whole = {i: np.pad(x, (0, 6 - len(x))) for i, x in whole.items()}
    for q in (0, 50, 100, 250, 300):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
        assert got[q] == {n: (i, -s) for n, (s, i) in enumerate(best, 1)}
    twice = topk.top_k(v.union(v.filter("vec_id in (0, 7)")), F.col("vec_id") == 0, k=200).collect()
    others = len(whole) + 1  # candidates of each of the two rows: all but itself
    assert sorted(r.rank for r in twice) == sorted([*range(1, others + 1)] * 2)
    assert sum(r.vec_id == 0 for r in twice) == 2 and sum(r.vec_id == 7 for r in twice) == 4
    assert topk.top_k(v.filter("false"), F.lit(True)).count() == 0
    assert topk.top_k(v.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_quality(spark, none):
    rows = [(i, (passage(i, 40) if i % 3 else " ".join(w + "&&&" for w in passage(i, 40).split())), "en", "s") for i in range(600)] + [(900, "", "en", "s"), (901, None, "en", "s"), (0, passage(0, 40), "fr", "t")]
    d, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scores(d, labels).collect()}
    held = [i for i in range(1, 600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    kept = quality.filter_quality(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect() if r.doc_id in held} >= {i for i in held if got[i] >= 0.3}
    assert quality.scores(none, labels).count() == 0
    assert {r.score for r in quality.scores(d, labels.filter("false")).collect()} == {0.5}
    assert quality.filter_quality(none, labels).count() == 0
    again = quality.scores(d.repartition(7).union(d.filter("doc_id = 0")), labels).collect()
    assert {r.doc_id: r.score for r in again}.keys() == got.keys()


def test_quality_features_equal_plain_ones(spark):
    """Word vectors and features from loops over words, with the module's hashes of words alone."""
    import re

    import pyarrow as pa

    from colloquy.llm.bytewords import flat

    rows = [passage(i, 30).replace(" a", ", a!") for i in range(20)] + ["", None, "one", "é漢 one-two"]
    cut = [re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0d0-9A-Za-z\x80-\xff]+", (r or "").encode()) for r in rows]
    hashes = {w: int(quality.tokens(*flat(pa.array([w], pa.binary())))[0][0]) for c in cut for w in c}
    table = np.zeros((quality.BUCKETS, quality.WIDTH))
    for c in cut:
        for i, w in enumerate(c):
            for j in range(max(0, i - quality.REACH), min(len(c), i + quality.REACH + 1)):
                if j != i:
                    for position, sign in quality.index_vectors(np.array([hashes[c[j]]], np.uint64)):
                        table[hashes[w] % quality.BUCKETS, position[0]] += sign[0]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    vectors = quality.word_vectors(frame(spark, [(i, r, "en", "s") for i, r in enumerate(rows)]).repartition(3))
    assert np.abs(vectors - table).max() < 1e-6
    got = quality.features(*flat(pa.array(rows)), vectors)
    for c, x in zip(cut, got, strict=True):
        v = np.array([table[hashes[w] % quality.BUCKETS] for w in c]).reshape(-1, quality.WIDTH)
        n = max(1, len(c))
        want = [*(v.sum(0) / n), *np.sqrt(np.maximum((v * v).sum(0) / n - (v.sum(0) / n) ** 2, 0))]
        for lag in (1, 2):
            want += [sum(v[i] @ v[i + lag] for i in range(len(c) - lag)) / n, sum(hashes[c[i]] == hashes[c[i + lag]] for i in range(len(c) - lag)) / n]
        assert np.abs(x - want).max() < 1e-4


def test_toxicity(spark, none):
    bad = ["vile", "rotten", "wretch"]
    rows = [(i, passage(i, 60) + (f" {bad[i % 3]} {passage(i + 5000, 5)} {bad[(i + 1) % 3]}" if i % 4 == 0 else ""), "en", "s") for i in range(800)] + [(900, "", "en", "s"), (901, None, "en", "s")]
    d, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scores(d, labels).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert toxicity.scores(none, labels).count() == 0
    assert {r.score for r in toxicity.scores(d, labels.filter("false")).collect()} == {0.0}


def plain_kneser_ney(rows):
    """Each word's log P(word | toxic) - log P(word | ordinary), from sets and dictionaries."""
    import math
    import re

    before = [{}, {}]
    for text, toxic in rows:
        last = None
        for w in re.findall("[a-z0-9']+", text.lower()):
            before[toxic].setdefault(w, set()).add(last)
            last = w
    every = {w: before[0].get(w, set()) | before[1].get(w, set()) for w in {*before[0], *before[1]}}
    shared = sum(map(len, every.values()))

    def log_p(word, k):
        n = {w: len(s) for w, s in before[k].items()}
        c = [sum(v == i for v in n.values()) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        d = [0, 1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]]
        freed = sum(d[min(v, 3)] for v in n.values())
        backoff = (len(every.get(word, ())) + 0.5) / (shared + 0.5 * (len(every) + 1))
        return math.log((n.get(word, 0) - d[min(n.get(word, 0), 3)] + freed * backoff) / sum(n.values()))

    return lambda word: log_p(word, 1) - log_p(word, 0)


def test_toxicity_equals_plain_kneser_ney(spark):
    import pyarrow as pa

    from colloquy.llm.shared import Scratch

    rows = [(i, passage(i % 37, 50) + " " + passage(i, 9), int(i % 3 == 0)) for i in range(200)]
    counted = spark.createDataFrame(rows, "doc_id long, text string, _toxic int").repartition(3)
    asked = [(i, passage(i + 30, 40) + " unseen", "en", "s") for i in range(40)] + [(90, "", "en", "s"), (None, None, "en", "s"), (91, rows[5][1], "en", "s"), (91, rows[5][1], "en", "s")]
    plain = plain_kneser_ney([(t, k) for _, t, k in rows])
    got = toxicity.measured(frame(spark, asked).repartition(4), counted, Scratch(spark, "t")).collect()
    assert len(got) == len(asked)
    by = {(r.doc_id, i): r.x for r in got for i in range(1)}
    for i, text, *_ in asked:
        gains = [plain(w) for w in (text or "").split()]
        assert by[i, 0][0] == pytest.approx(np.mean(gains) if gains else 0, abs=1e-5)
        assert by[i, 0][1] == pytest.approx(max(gains, default=0), abs=1e-5)
        assert by[i, 0][2] == pytest.approx(max((np.mean(gains[j : j + 3]) for j in range(max(1, len(gains) - 2))), default=0) if gains else 0, abs=1e-5)
    words, _ = toxicity.words(pa.array([" ".join(sorted({w for _, t, *_ in asked for w in (t or "").split()}))]))
    table = {r.word: r for r in toxicity.contexts(counted).collect()}
    known = toxicity.statistics(spark.createDataFrame(list(table.values())))
    values = [np.array([getattr(table[h], c) if (h := int(w)) in table else 0 for w in words.view(np.int64)]) for c in ("o", "t", "e")]
    want = [plain(w) for w in sorted({w for _, t, *_ in asked for w in (t or "").split()})]
    assert toxicity.differences(*values, known) == pytest.approx(want, abs=1e-9)


def plain_bigram_kneser_ney(rows):
    """Each (word before, word)'s log P(word | word before, toxic) - log P(word | word before, ordinary), from counters."""
    import math
    import re

    every, shared = {}, 0
    n = [Counter(), Counter()]
    for text, toxic in rows:
        found = re.findall("[a-z0-9']+", text.lower())
        n[toxic].update(zip([None, *found], found))
    for before, w in {*n[0], *n[1]}:
        every[w] = every.get(w, 0) + 1
        shared += 1

    def estimated(values):
        c = [sum(v == i for v in values) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        return [0, *(max(0, i - (i + 1) * y * c[i] / c[i - 1]) for i in (1, 2, 3))]

    def model(counts):
        contexts = Counter(w for _, w in counts)
        d, low = estimated(counts.values()), estimated(contexts.values())
        d = [0, *(max(x, d[1]) for x in d[1:])]
        spread = sum(low[min(v, 3)] for v in contexts.values())
        total, freed = Counter(), Counter()
        for (before, _), v in counts.items():
            total[before] += v
            freed[before] += d[min(v, 3)]

        def log_p(before, w):
            lower = (contexts[w] - low[min(contexts[w], 3)] + spread * (every.get(w, 0) + 0.5) / (shared + 0.5 * (len(every) + 1))) / len(counts)
            v = counts[before, w]
            return math.log((v - d[min(v, 3)] + freed[before] * lower) / total[before] if total[before] else lower)

        return log_p

    ordinary, toxic = model(n[0]), model(n[1])
    return lambda before, w: toxic(before, w) - ordinary(before, w)


def test_toxicity_scores_pairs_by_plain_kneser_ney(spark):
    from colloquy.llm.shared import Scratch

    once, more = "he will say so and", "well then who knows"
    rows = [(i, passage(i % 37, 50) + " " + passage(i, 9) + f" {once}" * (i % 5) + f" {more}" * (i % 4), int(i % 3 == 0)) for i in range(200)]
    counted = spark.createDataFrame(rows, "doc_id long, text string, _toxic int").repartition(3)
    asked = [(i, passage(i + 30, 40) + f" unseen {once} {more} so well will", "en", "s") for i in range(40)] + [(90, "", "en", "s"), (91, None, "en", "s"), (92, "knows", "en", "s")]
    plain = plain_bigram_kneser_ney([(t, k) for _, t, k in rows])
    got = {r.doc_id: r.x for r in toxicity.measured(frame(spark, asked).repartition(4), counted, Scratch(spark, "t")).collect()}
    for i, text, *_ in asked:
        found = (text or "").split()
        gains = [plain(*pair) for pair in zip([None, *found], found)]
        assert got[i][6] == pytest.approx(np.mean(gains) if gains else 0, abs=1e-6)
    texts = [(" ".join(["", *t.split()]), k) for _, t, k in rows]
    met = {(r.o, r.t) for r in toxicity.pairs(counted).collect()}
    assert tuple(sum(t.count(" say so") for t, k in texts if k == c) for c in (0, 1)) in met


def test_toxicity_counts_what_it_does_not_calibrate_on(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 10)
    docs, labels = frame(spark, [(i, "a", "en", "s") for i in range(300)]), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    rows, sample = toxicity.labelled(docs, labels)
    counted, apart = [r.doc_id for r in rows.collect()], [r._sampled for r in sample.collect()]
    assert sorted(counted + apart) == [i for i in range(300) if zlib.crc32(str(i).encode()) % 5] and len(apart) == 10
    assert all(zlib.crc32(str(i).encode()) % 5 == 1 for i in apart)


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/2", "http://example.com/fr/", "http://x.net/es/1", "http://x.net/de/1", "http://com", "nothing", None, "://", "ftp://h.org/a#b", "http://notcom/x"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://good{i}.com/fr/{i}") for i in range(40)] + [(200 + i, f"http://spam{i}.net/es/{i}") for i in range(40)]
    pages = spark.createDataFrame([(*r, "h", "s") for r in rows], "page_id long, url string, html string, score string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(rows)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("com/", "allow")
    assert (got[3].rule, got[3].verdict) == ("net/es/", "block")
    assert [got[i].rule for i in range(4, 11)] == [None] * 7
    assert [(got[i].host, got[i].path) for i in (5, 6, 7, 8, 9)] == [("com", ""), ("", ""), ("", ""), ("", ""), ("h.org", "/a")]
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge(pages.filter("false")).count() == 0


def plain_log_ratio(urls, asked):
    """Mean log2 P(character | good) / P(character | bad) of the URLs asked, by Witten-Bell from dictionaries."""
    import math

    follow = [{}, {}]
    pad = [0] * (url_filter.ORDER - 1)
    for text, good in urls:
        padded = pad + [b + 1 for b in text.encode()]
        for i in range(len(pad), len(padded)):
            for k in range(url_filter.ORDER):
                context = follow[0 if good else 1].setdefault(tuple(padded[i - k : i]), Counter())
                context[padded[i]] += 1

    def log_p(seen, padded, i):
        p = 1 / 256
        for k in range(url_filter.ORDER):
            c = seen.get(tuple(padded[i - k : i]))
            if c:
                p = (c[padded[i]] + len(c) * p) / (c.total() + len(c))
        return math.log2(p)

    out = []
    for text in asked:
        padded = pad + [b + 1 for b in text.encode()]
        each = [log_p(follow[0], padded, i) - log_p(follow[1], padded, i) for i in range(len(pad), len(padded))]
        out.append(sum(each) / max(1, len(each)))
    return out


def test_url_models_equal_plain_ones(spark):
    from colloquy.llm.shared import Scratch

    rng = random.Random(8)
    known = [(f"{rng.choice(['www.', ''])}{passage(i, 1)}{rng.choice(['é', '漢', ''])}./{'good' if i % 3 else 'casino'}/{i}", bool(i % 3)) for i in range(90)]
    asked = ["new.org/good/5", "new.org/casino/win", "", "a", "www.é./good/1", *(t for t, _ in known[:5])] + ["x" * 3000]
    scratch = Scratch(spark, "t")
    table = scratch.write(url_filter.counts(spark.createDataFrame(known, "text string, accepted boolean").repartition(3)), "counts")
    got = {r.n: r.score for r in url_filter.scored(spark.createDataFrame(list(enumerate(asked)), "n long, text string").repartition(4), table, scratch).collect()}
    assert [got[i] for i in range(len(asked))] == pytest.approx(plain_log_ratio(known, asked), abs=1e-5)
    assert got[0] > 0 > got[1] and got[2] == 0


def test_urls_without_a_rule_are_not_judged_by_their_top_level(spark):
    """Rules accept .com and reject .net in part; what is learned is the rest of the URL."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [f"http://{word()}.com/news/{word()}" for _ in range(300)] + [f"http://{word()}.net/es/casino/{word()}" for _ in range(150)] + [f"http://{word()}.net/fr/casino/{word()}" for _ in range(150)]
    asked = [f"http://{word()}.net/{kind}/{word()}" for kind in ("news", "casino") for _ in range(50)]
    pages = spark.createDataFrame([(i, u, "h", "r", 1.0) for i, u in enumerate(rows + asked)], "page_id long, url string, host string, rule string, verdict double")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert all(got[i].rule is None for i in range(600, 700))
    assert sum(got[i].verdict == "allow" for i in range(600, 650)) >= 48 and sum(got[i].verdict == "block" for i in range(650, 700)) >= 48


def test_url_threshold():
    assert url_filter.threshold([]) == 0 and url_filter.threshold([(3, 1, 0)]) == 0
    assert url_filter.threshold([(-10, 0, 5), (-2, 1, 4), (4, 6, 0)]) == pytest.approx(1.5 / url_filter.STEPS)


def test_encoder_takes_any_number_of_pretokens(monkeypatch):
    """More distinct pre-tokens than the table keeps, in one text that is worked through in parts."""
    from tokenizers import Tokenizer

    from colloquy.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 700)
    monkeypatch.setattr(tokens, "SLOTS", 1 << 11)
    monkeypatch.setattr(tokens, "GROUP", 500)
    monkeypatch.setattr(tokens, "PART", 3000)
    rng = random.Random(12)
    long = " ".join(f"w{i}x{rng.choice(['', 'é', '!', ' ', chr(0x3000)])}" for i in range(6000)) + " " + "y" * 9000
    rows = ["a b", long, "", "c <|endoftext|> d", long[:40000], "z"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        tool, library = tokens.Encoder(tokenizer_path(name), spaced, added=True), Tokenizer.from_file(tokenizer_path(name))
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        ids, sizes = tool.encode(data, np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])]))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [library.encode(r, add_special_tokens=False).ids for r in rows]


def test_encoder_ends_on_millions_of_pretokens():
    words = " ".join(f"w{i:x}" for i in range(2_500_000))
    data = np.frombuffer(words.encode(), np.uint8)
    ids, sizes = encoder(tokenizer_path("word_bpe_49k.json"), False).encode(data, np.array([0, len(data)]))
    assert len(ids) == sizes.sum() > 2_500_000


def test_encoder_is_kept():
    assert encoder(tokenizer_path("byte_bpe_50k.json"), True) is encoder(tokenizer_path("byte_bpe_50k.json"), True)

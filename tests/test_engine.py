import json
import os
import socket
import subprocess
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from colloquy.functions.embed import HashEmbedder
from colloquy.operators import store as store_module
from colloquy.operators.filters import SearchFilter, SearchRequest
from colloquy.operators.fold import fold_a
from colloquy.operators.store import Busy, Store
from colloquy.plans import printed
from colloquy.plans.engine import Engine
from colloquy.schema import Config, ttl_days
from colloquy.sources import archive, transcripts
from colloquy.streaming.ingest import sync_stream


def turn(role, text, at="2026-05-01T10:00:00Z", **more):
    return json.dumps({"type": role, "message": {"role": role, "content": text}, "timestamp": at, "sessionId": "s"} | more)


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Config(str(tmp_path / "store"), [str(tmp_path / "src"), str(tmp_path / "absent")], ttl_days=0))


def test_sync_search_read_expire(spark, tmp_path, engine):
    one = str(tmp_path / "src/alpha/one.jsonl")
    write(one, turn("user", "How to fix a memory leak?"), "broken", turn("assistant", "Close the handle."))
    got = engine.sync()
    assert (got.files_scanned, got.files_copied, got.exchanges_inserted, got.text_indexed) == (1, 1, 1, 1)
    assert engine.sync().exchanges_inserted == 0
    time.sleep(0.01)
    write(one, turn("user", "How to fix a memory leak?"), "broken", turn("assistant", "Close the handle."), turn("user", "And a slow scan?"), turn("assistant", "Prune columns."))
    assert engine.sync().exchanges_inserted == 1
    rows = engine.search(SearchRequest("memory leak")).collect()
    assert rows[0].id == 0 and rows[0].line_end == 3 and rows[0].text_rank == 1
    assert engine.search(SearchRequest("memory leak", where=SearchFilter(project="beta"))).count() == 0
    assert engine.search(SearchRequest("memory leak", mode="text", limit=1)).count() == 1
    assert len(engine.search(SearchRequest(("memory leak", "close handle"))).collect()) >= 1
    assert "Lines 1-3 in" in engine.print_search(SearchRequest("memory leak"))
    assert engine.read(one, 4, 4) == turn("user", "And a slow scan?")
    os.remove(one)
    assert engine.read(one, 1, 1) == turn("user", "How to fix a memory leak?")
    with pytest.raises(FileNotFoundError):
        engine.read(str(tmp_path / "src/alpha/none.jsonl"))
    copy = archive.archive_path(engine.config.archive, "claude", "alpha", one)
    old = time.time() - 400 * 86400
    os.utime(copy, (old, old))
    keeper = Engine(spark, Config(engine.config.root, engine.config.sources, ttl_days=180))
    got = keeper.sync()
    assert (got.conversations_expired, got.exchanges_expired) == (1, 2)
    assert keeper.store.read("exchanges").count() == 0 and keeper.store.read("vectors").count() == 0
    assert keeper.store.next_id() == 2


def test_writers_exclude_each_other(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    assert a.acquire() and a.acquire() and not b.acquire()
    with pytest.raises(Busy), b.writing(patience=0.2):
        pass
    a.release()
    assert b.acquire()
    b.release()


def test_a_dead_writers_lock_is_taken_over(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    dead = subprocess.Popen(["true"])
    dead.wait()
    for owner, age in (({"token": "x", "host": socket.gethostname(), "pid": dead.pid}, 0), ({"token": "x", "host": "elsewhere", "pid": 1}, 1000)):
        with open(s.lock, "w") as f:
            json.dump(owner, f)
        os.utime(s.lock, (time.time() - age,) * 2)
        assert s.acquire()
        s.release()
    with open(s.lock, "w") as f:
        json.dump({"token": "x", "host": "elsewhere", "pid": 1}, f)
    assert not s.acquire()


def test_racing_syncs_store_each_exchange_once(spark, tmp_path):
    lines = [turn(role, f"{role} {i}") for i in range(4) for role in ("user", "assistant")]
    write(str(tmp_path / "src/alpha/one.jsonl"), *lines)
    config = Config(str(tmp_path / "store"), [str(tmp_path / "src")], ttl_days=0)
    one, other = Engine(spark, config), Engine(spark, config)
    with ThreadPoolExecutor(3) as pool:
        done = [f.result() for f in [pool.submit(e.sync) for e in (one, other, one)]]
    rows = one.store.read("exchanges").collect()
    assert sum(d.exchanges_inserted for d in done) == 4 and sorted(r.id for r in rows) == [0, 1, 2, 3]
    assert len({(r.archive_path, r.line_start) for r in rows}) == 4 and one.store.read("vectors").count() == 4
    assert not os.path.exists(one.store.lock)


class Killed(Exception):
    pass


def test_a_write_that_is_cut_short_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "src/alpha/one.jsonl")
    write(path, turn("user", "q"), turn("assistant", "a"))
    engine = Engine(spark, Config(str(tmp_path / "store"), [str(tmp_path / "src")], ttl_days=0))
    engine.sync()
    write(path, turn("user", "q"), turn("assistant", "a"), turn("user", "q2"), turn("assistant", "a2"))
    whole_part, whole_file = Store.write_part, store_module.put_file
    steps = ("exchanges", "cursors", "vectors", "manifest")
    for step in steps:
        def part(self, table, df, step=step):
            if table == step:
                raise Killed
            return whole_part(self, table, df)

        def file(name, text, step=step):
            if step == "manifest" and name.endswith("manifest.json"):
                raise Killed
            whole_file(name, text)

        monkeypatch.setattr(Store, "write_part", part)
        monkeypatch.setattr(store_module, "put_file", file)
        with pytest.raises(Killed):
            engine.sync()
        fresh = Store(spark, engine.config.root)
        assert fresh.read("exchanges").count() == 1 and fresh.read("vectors").count() == 1 and fresh.read("cursors").first().line_end == 2
    monkeypatch.setattr(Store, "write_part", whole_part)
    monkeypatch.setattr(store_module, "put_file", whole_file)
    assert engine.sync().exchanges_inserted == 1
    assert sorted(r.id for r in engine.store.read("exchanges").collect()) == [0, 1] and engine.store.read("lengths").count() == 2
    assert engine.store.vacuum(0) and engine.store.read("exchanges").count() == 2


def test_readers_keep_the_last_good_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_vectors(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"))
    assert s.read("vectors").count() == 1
    s.publish(append={"vectors": spark.createDataFrame([(2, [1.0])], "id long, embedding array<float>")})
    folder = f"{s.root}/{s.manifest()['tables']['vectors'][-1]['path']}"
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            with open(f"{folder}/{name}", "wb") as f:
                f.write(b"damaged")
        if name.endswith(".crc"):
            os.remove(f"{folder}/{name}")
    for reader in (s, Store(spark, s.root)):
        with pytest.warns(UserWarning, match="can't be read"):
            assert [r.id for r in reader.read("vectors").collect()] == [1]
        assert [r.id for r in reader.read("vectors").collect()] == [1]


def test_parts_merge_and_deleted_ids_go(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = lambda ids: spark.createDataFrame([(i, [float(i)]) for i in ids], "id long, embedding array<float>")
    for i in range(9):
        s.publish(append={"vectors": rows([i])})
    parts = s.manifest()["tables"]["vectors"]
    assert sum(p["rows"] for p in parts) == 9 and len(parts) <= 4
    assert sorted(r.id for r in s.read("vectors").collect()) == list(range(9))
    s.put_vectors(rows([3]))
    assert s.read("vectors").count() == 9
    exchanges = fold_a(transcripts.lines_of(spark.createDataFrame([(f"/p/f{i}.jsonl", turn("user", "q") + "\n" + turn("assistant", "a")) for i in range(6)], "path string, text string")), "2026-06-01T00:00:00Z")
    assert s.insert(exchanges) == 6 and s.next_id() == 6
    assert s.delete(spark.createDataFrame([(0,), (0,), (77,)], "id long")) == 1
    assert sorted(r.id for r in s.read("exchanges").collect()) == [1, 2, 3, 4, 5]
    assert s.delete(spark.createDataFrame([(5,), (4,)], "id long")) == 2
    assert not s.manifest()["tables"]["deleted"] and s.read("exchanges").count() == 3 and s.next_id() == 6
    assert s.insert(exchanges) == 0 and s.insert(exchanges, use_cursors=False) == 6 and s.next_id() == 12


def test_meta_and_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.meta_put("a", {"x": 1})
    s.meta_put("a", 2)
    assert s.meta_get("a") == 2 and s.meta_get("b") is None
    assert s.meta_remove("a") and not s.meta_remove("a")
    v = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    for _ in range(6):
        s.replace_vectors(v)
    s.read("vectors")
    assert len(s.vacuum(3600)) == 0 and len(s.vacuum(0)) >= 2 and s.vacuum(0) == [] and s.read("vectors").count() == 1


def test_stores_that_nobody_opens_go(spark, tmp_path):
    here, idle, used, other = (str(tmp_path / n) for n in ("here", "idle", "used", "other"))
    stores = [Store(spark, p) for p in (here, idle, used)]
    os.makedirs(other)
    for s in stores:
        s.meta_put("a", 1)
        for name in os.listdir(s.root):
            os.utime(f"{s.root}/{name}", (1, 1))
    Store(spark, used)  # opened, not written
    assert stores[0].vacuum_idle_roots(str(tmp_path)) == [idle] and sorted(os.listdir(tmp_path)) == ["here", "other", "used"]


def test_only_new_exchanges_are_embedded_and_an_idle_sync_writes_nothing(spark, tmp_path):
    class Counting(HashEmbedder):
        def embed(self, texts):
            with open(tmp_path / "log", "a") as f:
                f.write("x" * len(texts))
            return super().embed(texts)

    path = str(tmp_path / "src/alpha/one.jsonl")
    write(path, turn("user", "q"), turn("assistant", "a"))
    write(path + ".bak", "not a transcript")
    engine = Engine(spark, Config(str(tmp_path / "store"), [str(tmp_path / "src")], ttl_days=0), Counting(64))
    assert engine.sync().files_scanned == 1
    write(path, turn("user", "q"), turn("assistant", "a"), turn("user", "q2"), turn("assistant", "a2"))
    engine.sync()
    version = engine.store.manifest()["version"]
    engine.sync()
    assert engine.store.manifest()["version"] == version and os.path.getsize(tmp_path / "log") == 2


def test_summarise(spark, tmp_path):
    asked = []

    def writer(text):
        asked.append(text)
        if "boom" in text:
            raise ValueError("no answer")
        return "Short."

    for name, q in (("one", "hello"), ("two", "boom")):
        write(str(tmp_path / f"src/alpha/{name}.jsonl"), turn("user", q), turn("assistant", "a"))
    engine = Engine(spark, Config(str(tmp_path / "store"), [str(tmp_path / "src")], ttl_days=0))
    later = int(time.time() * 1000) + 3 * 3600 * 1000
    got = engine.sync(later, {"claude": writer})
    assert (got.summaries_written, got.summaries_failed) == (1, 1) and any("User: hello" in t for t in asked)
    got = engine.sync(later, {"claude": lambda t: "Now."})
    assert (got.summaries_written, got.summaries_failed) == (1, 0)


def test_stream(spark, tmp_path):
    write(str(tmp_path / "in/alpha/a.jsonl"), turn("user", "q"), turn("assistant", "a"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        sync_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "ck"), "2026-06-01T00:00:00Z").awaitTermination()
        assert store.read("exchanges").count() == 1


def test_summaries(tmp_path):
    p = str(tmp_path / "x/y-summary.txt")
    assert archive.read_summary(p).kind == "missing"
    archive.write_summary(p, " ")
    assert archive.read_summary(p).kind == "empty"
    archive.write_error(p, ValueError("no\nmore"))
    assert archive.read_summary(p) == archive.SummaryState("error", "no")
    archive.write_summary(p, "Fine.")
    assert archive.shown(archive.read_summary(p)) == "Fine."
    assert archive.shown(archive.SummaryState("valid", "x" * 300)) is None


def test_settings_and_print():
    assert [ttl_days(x) for x in (None, "0", "-3", "abc", "7")] == [180, 0, 0, 0, 7]
    assert printed.results([]) == "No results found."
    row = {"project": "p", "timestamp": "2026-01-02T03", "harness": "codex", "similarity": 0.125, "snippet": "s", "line_start": 1, "line_end": 2, "archive_path": "/a"}
    assert printed.results([row]) == '1. [p, 2026-01-02, codex] - 13% match\n   "s"\n   Lines 1-2 in /a\n'

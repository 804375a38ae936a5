"""Tables of the engine: exchanges, vectors, cursors, postings and lengths, with settings, as one versioned whole.

A table is a list of parts, folders of Parquet files that are never changed.  A manifest names the parts of all tables and
holds the settings; the current one is replaced by renaming a file, so all that a write changes becomes visible at once, and
a write that is cut short leaves the version before it.  Writes append parts; of parts at the end of a list that are small
beside those before them the next write makes one, so there are about as many as the logarithm of the rows, and a row is
rewritten about as often.  Deleted ids are a table too, left out when reading, until ``compact`` writes live rows alone.

Readers pin the version they have opened: one whose new parts can't be read is reported and passed over, and the last good
one goes on answering.  Writers hold a lock file with owner and heartbeat; a writer waits for another, and takes over the
lock of one that has died.  Manifests and locks are small files that the driver keeps on the file system of the root.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import socket
import threading
import time
import uuid
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CURSOR, DELETED, EXCHANGE, IDLE_DAYS, LENGTH, POSTING, SWEEP_SECONDS, VECTOR

KINDS = {"exchanges": EXCHANGE, "vectors": VECTOR, "cursors": CURSOR, "postings": POSTING, "lengths": LENGTH, "deleted": DELETED}
#: Tables whose rows go with their id.
BY_ID = ("exchanges", "vectors", "postings", "lengths")
#: Parts that are merged at once at least.
MERGED = 4
#: A share of deleted ids from which a delete compacts, and manifests that are kept beside the current one.
STALE_SHARE, KEPT = 0.25, 3
#: Seconds between heartbeats of a lock, without one until it counts as abandoned, and that a writer waits for another.
HEARTBEAT, ABANDONED, PATIENCE = 5, 60, 3600
OPENED = ".opened"


class Busy(RuntimeError):
    """Another writer has held the lock for too long."""


def put_file(path: str, text: str) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.token, self.owner = spark, root, None, None
        self.good: dict | None = None
        self.passed_over: int | None = None
        os.makedirs(root, exist_ok=True)
        with open(f"{root}/{OPENED}", "w"):
            pass
        os.utime(f"{root}/{OPENED}")

    # Versions

    def manifest(self) -> dict:
        """The current version, as writers see it."""
        try:
            with open(f"{self.root}/manifest.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"version": 0, "tables": {}, "meta": {}}

    def opened(self) -> dict:
        """The version that readers see: the current one, or the last good one where that can't be read."""
        for candidate in self.candidates():
            if self.good is not None and candidate["version"] == self.good["version"]:
                break
            if candidate["version"] == self.passed_over:
                continue
            try:
                self.check(candidate)
            except Exception as e:  # noqa: BLE001 - whatever makes a version unreadable
                self.passed_over = candidate["version"]
                warnings.warn(f"version {candidate['version']} of {self.root} can't be read ({type(e).__name__}); the one before is used", stacklevel=2)
                if self.good is not None:
                    break
                continue
            self.good = candidate
            break
        if self.good is None:
            raise FileNotFoundError(f"no version of {self.root} can be read")
        return self.good

    def candidates(self) -> Iterator[dict]:
        """The current manifest and those kept before it, the newest first."""
        names = [f"{self.root}/manifest.json", *(f"{self.root}/manifest-{v}.json" for v in sorted(self.kept_versions(), reverse=True))]
        if not os.path.exists(names[0]):
            yield {"version": 0, "tables": {}, "meta": {}}
            return
        for name in names:
            with contextlib.suppress(ValueError, FileNotFoundError), open(name) as f:
                yield json.load(f)

    def kept_versions(self) -> list[int]:
        found = [n.removeprefix("manifest-").removesuffix(".json") for n in os.listdir(self.root) if n.startswith("manifest-") and n.endswith(".json")]
        return [int(n) for n in found if n.isdigit()]

    def check(self, manifest: dict) -> None:
        """Reads the footers of all parts that the last good version doesn't have."""
        known = {p["path"] for parts in (self.good or {}).get("tables", {}).values() for p in parts}
        for name, parts in manifest["tables"].items():
            new = [f"{self.root}/{p['path']}" for p in parts if p["path"] not in known]
            if new:
                there = self.spark.read.option("mergeSchema", "true").parquet(*new).schema.names
                if missing := {f.split()[0] for f in KINDS[name].split(", ")} - set(there):
                    raise ValueError(f"{name} lacks {sorted(missing)}")

    def raw(self, table: str, manifest: dict) -> DataFrame:
        parts = manifest["tables"].get(table, [])
        if not parts:
            return self.spark.createDataFrame([], KINDS[table])
        return self.spark.read.schema(KINDS[table]).parquet(*[f"{self.root}/{p['path']}" for p in parts])

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        """A table's live rows; one that was never written is empty, and a cursor is the furthest of its file's."""
        manifest = manifest or self.opened()
        rows = self.raw(table, manifest)
        if table == "cursors":
            return rows.groupBy("source_path").agg(F.max("line_end").alias("line_end"))
        if table in BY_ID and manifest["tables"].get("deleted"):
            rows = rows.join(self.raw("deleted", manifest), "id", "left_anti")
        return rows

    def write_part(self, table: str, df: DataFrame) -> dict | None:
        """A new part; None where there are no rows."""
        path = f"{table}/part-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        columns = [f.split()[0] for f in KINDS[table].split(", ")]
        df = df.select(*columns)
        if table == "postings":
            df = df.repartition("term").sortWithinPartitions("term", "id")  # ranges would make the postings twice, once to sample them
        df.write.parquet(f"{self.root}/{path}")
        rows = self.spark.read.schema(KINDS[table]).parquet(f"{self.root}/{path}").count()
        if not rows:
            shutil.rmtree(f"{self.root}/{path}")
            return None
        return {"path": path, "rows": rows}

    def publish(self, append: dict[str, DataFrame | dict | None] | None = None, replace: dict[str, DataFrame] | None = None, meta: dict | None = None) -> None:
        """One new version: parts appended (a frame, or a part that is written already), tables replaced, settings changed."""
        with self.writing():
            now = self.manifest()
            tables = {k: list(v) for k, v in now["tables"].items()}
            for name, df in (replace or {}).items():
                part = self.write_part(name, df)
                tables[name] = [part] if part else []
            for name, more in (append or {}).items():
                part = self.write_part(name, more) if isinstance(more, DataFrame) else more
                if part:
                    tables[name] = self.merged(name, [*tables.get(name, []), part])
            settings = {k: v for k, v in (now["meta"] | (meta or {})).items() if v is not None}
            new = {"version": now["version"] + 1, "tables": tables, "meta": settings}
            put_file(f"{self.root}/manifest-{new['version']}.json", json.dumps(new))
            put_file(f"{self.root}/manifest.json", json.dumps(new))
            for version in sorted(self.kept_versions())[: -KEPT - 1]:
                os.remove(f"{self.root}/manifest-{version}.json")

    def merged(self, table: str, parts: list[dict]) -> list[dict]:
        """The parts, with those at the end that are small beside the ones before them made into one."""
        first, rows = len(parts) - 1, parts[-1]["rows"]
        while first and parts[first - 1]["rows"] <= 2 * rows:
            first -= 1
            rows += parts[first]["rows"]
        if len(parts) - first < MERGED:
            return parts
        tail = {"tables": {table: parts[first:]}}
        one = self.write_part(table, self.read(table, tail) if table == "cursors" else self.raw(table, tail))
        return [*parts[:first], *([one] if one else [])]

    def compact(self) -> None:
        """Writes live rows alone, one part a table."""
        with self.writing():
            now = self.manifest()
            tables = [t for t in (*BY_ID, "cursors") if now["tables"].get(t)]
            empty = self.spark.createDataFrame([], DELETED)
            self.publish(replace={t: self.read(t, now) for t in tables} | {"deleted": empty})

    def vacuum(self, min_age_seconds: float = SWEEP_SECONDS) -> list[str]:
        """Removes parts that no kept manifest names and that are old enough; returns their paths."""
        named = {p["path"] for m in self.candidates() for parts in m["tables"].values() for p in parts}
        if self.good:
            named |= {p["path"] for parts in self.good["tables"].values() for p in parts}
        gone = []
        for table in KINDS:
            for part in os.listdir(f"{self.root}/{table}") if os.path.isdir(f"{self.root}/{table}") else []:
                path = f"{table}/{part}"
                if part.startswith("part-") and path not in named and time.time() - os.path.getmtime(f"{self.root}/{path}") >= min_age_seconds:
                    shutil.rmtree(f"{self.root}/{path}", ignore_errors=True)
                    gone.append(f"{self.root}/{path}")
        return gone

    def vacuum_idle_roots(self, parent: str, days: float = IDLE_DAYS) -> list[str]:
        """Removes other stores beside this one that nobody has opened for so long; never this one, nor what is no store."""
        gone = []
        for name in os.listdir(parent):
            path = os.path.join(parent, name)
            if os.path.realpath(path) == os.path.realpath(self.root) or not os.path.isfile(f"{path}/manifest.json"):
                continue
            marker = f"{path}/{OPENED}" if os.path.exists(f"{path}/{OPENED}") else f"{path}/manifest.json"
            if time.time() - os.path.getmtime(marker) > days * 86400:
                shutil.rmtree(path)
                gone.append(path)
        return gone

    # Lock

    @property
    def lock(self) -> str:
        return f"{self.root}/writer.lock"

    def acquire(self) -> bool:
        """True if this thread with this store is now, or was already, the only writer."""
        if self.token:
            return self.owner == threading.get_ident()
        token = uuid.uuid4().hex
        for _ in range(2):
            try:
                handle = os.open(self.lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if not self.break_abandoned():
                    return False
                continue
            with os.fdopen(handle, "w") as f:
                json.dump({"token": token, "host": socket.gethostname(), "pid": os.getpid()}, f)
            self.token, self.owner = token, threading.get_ident()
            self.stop = threading.Event()
            threading.Thread(target=self.beat, args=(self.stop,), daemon=True).start()
            return True
        return False

    def beat(self, stop: threading.Event) -> None:
        while not stop.wait(HEARTBEAT):
            with contextlib.suppress(OSError):
                os.utime(self.lock)

    def break_abandoned(self) -> bool:
        """Takes away the lock of a writer that has died: its process is gone from this host, or it doesn't beat."""
        try:
            age = time.time() - os.path.getmtime(self.lock)
            with open(self.lock) as f:
                owner = json.load(f)
        except FileNotFoundError:
            return True
        except ValueError:  # being written, or cut short
            owner = {}
        dead = age > ABANDONED
        if owner.get("host") == socket.gethostname() and not dead:
            try:
                os.kill(owner["pid"], 0)
            except ProcessLookupError:
                dead = True
            except PermissionError:
                pass
        if dead:
            aside = f"{self.lock}.{uuid.uuid4().hex}"
            with contextlib.suppress(FileNotFoundError):
                os.rename(self.lock, aside)
                os.remove(aside)
        return dead

    def release(self) -> None:
        if self.token and self.owner == threading.get_ident():
            self.stop.set()
            with contextlib.suppress(FileNotFoundError, ValueError), open(self.lock) as f:
                if json.load(f)["token"] == self.token:
                    os.remove(self.lock)
            self.token = None

    @contextlib.contextmanager
    def writing(self, patience: float = PATIENCE) -> Iterator[None]:
        """Holds the lock, which is waited for."""
        had, until = self.token and self.owner == threading.get_ident(), time.time() + patience
        while not self.acquire():
            if time.time() > until:
                raise Busy(self.root)
            time.sleep(0.1)
        try:
            yield
        finally:
            if not had:
                self.release()

    # Settings

    def meta_get(self, key: str):
        return self.manifest()["meta"].get(key)

    def meta_put(self, key: str, value) -> None:
        self.publish(meta={key: value})

    def meta_remove(self, key: str) -> bool:
        with self.writing():
            there = self.meta_get(key) is not None
            if there:
                self.publish(meta={key: None})
            return there

    # Rows

    def next_id(self) -> int:
        """One above every id that was ever given out: the manifest's, never below the rows'."""
        return max(self.meta_get("next_id") or 0, id_after(self.raw("exchanges", self.manifest())).first()[0])

    def exchanges_from(self, first: int = 0) -> DataFrame:
        """All live exchanges whose id is ``first`` or above."""
        return self.read("exchanges").filter(F.col("id") >= first)

    def insert(self, parsed: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, use_cursors: bool = True) -> int:
        """Appends the exchanges whose last line is beyond their file's cursor; returns how many.

        ``parsed`` has the columns of an exchange but id.  ``embed`` gets the new rows alone and gives (id, embedding) of those
        that aren't of a side chain.  Rows, vectors, cursors and the next id become visible together.
        """
        with self.writing():
            now = self.manifest()
            fresh = parsed
            if use_cursors:
                fresh = new_rows(parsed, self.read("cursors", now).withColumnRenamed("line_end", "_to"))
            first = now["meta"].get("next_id") or self.next_id()
            # Read and folded once; ids take two passes.  Named like a part, so that a vacuum takes what a broken insert leaves.
            staged = f"{self.root}/exchanges/part-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
            try:
                fresh.write.parquet(staged)
                part = self.write_part("exchanges", assign_ids(self.spark.read.schema(fresh.schema).parquet(staged), first))
            finally:
                shutil.rmtree(staged, ignore_errors=True)
            if part is None:
                return 0
            numbered = self.raw("exchanges", {"tables": {"exchanges": [part]}})
            more: dict[str, DataFrame | dict | None] = {"exchanges": part}
            if use_cursors:
                more["cursors"] = numbered.groupBy(F.col("archive_path").alias("source_path")).agg(F.max("line_end").alias("line_end"))
            if embed is not None:
                more["vectors"] = embed(numbered).filter("embedding is not null")
            self.publish(append=more, meta={"next_id": first + part["rows"]})
            return part["rows"]

    def delete(self, ids: DataFrame) -> int:
        """Removes rows, vectors and postings of the ids; returns how many rows there were of them."""
        with self.writing():
            now = self.manifest()
            there = self.read("exchanges", now).join(ids.select("id").distinct(), "id", "left_semi").select("id")
            part = self.write_part("deleted", there)
            if part is None:
                return 0
            self.publish(append={"deleted": part}, meta={"next_id": self.next_id()})
            tables = self.manifest()["tables"]
            if sum(p["rows"] for p in tables["deleted"]) > STALE_SHARE * sum(p["rows"] for p in tables["exchanges"]):
                self.compact()
            return part["rows"]

    def put_vectors(self, vectors: DataFrame) -> None:
        """Replaces the vectors of the ids given."""
        with self.writing():
            kept = self.read("vectors", self.manifest()).join(vectors.select("id"), "id", "left_anti")
            self.publish(replace={"vectors": kept.unionByName(vectors.select("id", "embedding"))})

    def replace_vectors(self, vectors: DataFrame, **meta) -> None:
        self.publish(replace={"vectors": vectors}, meta=meta)


def id_after(exchanges: DataFrame, least: int = 0) -> DataFrame:
    """next_id: one above all ids, and ``least`` at least."""
    return exchanges.agg(F.greatest(F.coalesce(F.max("id") + 1, F.lit(0)), F.lit(least)).cast("long").alias("next_id"))


def new_rows(parsed: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows whose last line is beyond the cursor (source_path, _to) of their file."""
    return parsed.join(cursors, parsed.archive_path == cursors.source_path, "left").filter(F.col("line_end") > F.coalesce("_to", F.lit(0))).drop("source_path", "_to")


def assign_ids(rows: DataFrame, first: int) -> DataFrame:
    """Consecutive ids from ``first`` in the order of path and lines.

    Files are numbered by a running sum of their numbers of rows (one row for each file), and rows within their file, so
    no task sorts all rows.
    """
    files = rows.groupBy("archive_path").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("archive_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("archive_path").alias("_path"), start.alias("_start"))
    inside = F.row_number().over(Window.partitionBy("archive_path").orderBy("line_start", "line_end"))
    out = rows.withColumn("_in", inside).join(files, F.col("archive_path") == F.col("_path"))
    return out.withColumn("id", (F.col("_start") + F.col("_in") - 1 + first).cast("long")).drop("_in", "_path", "_start")


def latest_exchanges(exchanges: DataFrame) -> DataFrame:
    """Of an exchange that was stored while it grew, the longest."""
    columns = exchanges.columns
    best = F.max_by(F.struct(*columns), F.struct("line_end", "id"))
    return exchanges.groupBy("archive_path", "line_start").agg(best.alias("_r")).select(*[f"_r.{c}" for c in columns])


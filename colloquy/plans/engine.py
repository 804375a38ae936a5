"""The engine: search, read and sync over one store."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import Embedder, HashEmbedder, embed_exchanges
from ..functions.text import snippet, transcript_text
from ..operators import bm25, filters, fusion, knn, lifecycle
from ..operators.filters import SearchFilter, SearchRequest
from ..operators.fold import fold_a, fold_b
from ..operators.store import Store
from ..schema import CANDIDATES, DEFAULT_HARNESS, Config
from ..sources import archive, transcripts
from . import printed

#: The setting that holds the first id that isn't indexed, by the version of the analyser.
TEXT_CURSOR = "text_cursor_v1"


@dataclass
class SyncResult:
    """What a sync did."""

    files_scanned: int = 0
    files_copied: int = 0
    exchanges_inserted: int = 0
    conversations_expired: int = 0
    exchanges_expired: int = 0
    expiry_skipped: bool = False
    vectors_rebuilt: bool = False
    text_indexed: int = 0
    text_rebuilt: bool = False
    text_skipped: bool = False
    summaries_written: int = 0
    summaries_failed: int = 0


class Engine:
    def __init__(self, spark: SparkSession, config: Config, embedder: Embedder | None = None):
        self.spark, self.config = spark, config
        self.embedder = embedder or HashEmbedder(config.dimension)
        self.store = Store(spark, config.root)

    # Searching

    def index(self) -> bm25.TextIndex:
        """The stored postings, with those of exchanges that came after them made on the way."""
        known = self.store.opened()
        stored = bm25.TextIndex(self.store.read("postings", known), self.store.read("lengths", known))
        cursor = known["meta"].get(TEXT_CURSOR) or 0 if known["tables"].get("lengths") else 0
        fresh = self.store.read("exchanges", known).filter(F.col("id") >= cursor)
        made = bm25.build(bm25.exchange_documents(fresh))
        return bm25.TextIndex(stored.postings.unionByName(made.postings), stored.lengths.unionByName(made.lengths))

    def search(self, request: SearchRequest) -> DataFrame:
        """Exchanges with score, similarity, vector_rank, text_rank and snippet, best first."""
        if not isinstance(request.query, str):
            return self.search_all(request)
        exchanges, where = self.store.read("exchanges"), request.where
        return hybrid(exchanges, self.store.read("vectors"), self.index(), request.query, self.embedder.embed([request.query])[0].tolist(), request.limit, request.mode, where)

    def search_all(self, request: SearchRequest) -> DataFrame:
        """Exchanges that are near every concept, by mean similarity; dates in the request don't count here."""
        exchanges = self.store.read("exchanges")
        where = SearchFilter(request.where.project, request.where.session_id, request.where.harness)
        allowed = filters.matching_ids(exchanges, where)
        vectors = self.store.read("vectors")
        vectors = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
        found = fusion.all_concepts(vectors, [v.tolist() for v in self.embedder.embed(list(request.query))], request.limit)
        shown = exchanges.withColumn("snippet", snippet(F.col("user_message"), F.col("assistant_message")))
        return F.broadcast(found).join(shown, "id").orderBy(F.desc("average"), "id")  # ``limit`` rows are broadcast

    def print_search(self, request: SearchRequest) -> str:
        rows = [r.asDict() for r in self.search(request).collect()]  # a page
        path = lambda r: archive.resolve(self.config.archive, r["archive_path"], r["harness"] or DEFAULT_HARNESS, r["project"])

        def summary(r: dict) -> str | None:
            copy = archive.archive_path(self.config.archive, r["harness"] or DEFAULT_HARNESS, r["project"], r["archive_path"])
            return archive.shown(archive.read_summary(archive.summary_path(copy)))

        if isinstance(request.query, str):
            return printed.results(rows, summary, path)
        return printed.concept_results(rows, list(request.query), summary, path)

    def read(self, path: str, start: int | None = None, end: int | None = None) -> str:
        """Lines of a transcript, or of its copy where the transcript is gone."""
        if not os.path.exists(path):
            project = os.path.basename(os.path.dirname(path))
            copies = [archive.archive_path(self.config.archive, h, project, path) for h in ("claude", "codex")]
            path = next((c for c in copies if os.path.exists(c)), path)
        return transcripts.read_range(self.spark, path, start, end)

    # Syncing

    def sync(self, now_ms: int | None = None, summarisers: dict[str, Callable[[str], str]] | None = None) -> SyncResult:
        """Reads what is new, forgets what is old, and brings vectors, text index and summaries up to date."""
        now_ms = now_ms or int(time.time() * 1000)
        now = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(now_ms / 1000)) + f".{now_ms % 1000:03d}Z"
        out = SyncResult()
        cutoff = lifecycle.cutoff_ms(now_ms, self.config.ttl_days)
        self.migrate_vectors()
        files = transcripts.read_files(self.spark, self.config.sources)
        listing = files.select("path", "mtime_ms")
        out.files_scanned = listing.count()
        recent = lifecycle.recent_files(files, cutoff)
        first, second = transcripts.lines_by_format(recent)
        parsed = fold_a(first, now).unionByName(fold_b(second, now))
        # New exchanges are written by the insert; what has been stored says where files belong.
        out.exchanges_inserted = self.store.insert(parsed, lambda new: embed_exchanges(new, self.embedder))
        out.files_copied = self.copy_files(lifecycle.recent_files(listing, cutoff))
        self.expire(out, cutoff, listing)
        out.vectors_rebuilt = bool(out.exchanges_inserted or out.exchanges_expired)
        self.sync_text(out)
        if summarisers:
            self.summarise(out, now_ms, listing, summarisers)
        if self.store.acquire():
            try:
                self.store.vacuum()
            finally:
                self.store.release()
        return out

    def talks(self) -> DataFrame:
        """Conversations with ``copy_path``, where their transcript's copy is or would be."""
        talks = lifecycle.conversations(self.store.read("exchanges"))
        return talks.withColumn("copy_path", archive.archive_path_column(self.config.archive, F.col("harness"), F.col("project"), F.col("archive_path")))

    def copies(self) -> DataFrame:
        """copy_path, copy_mtime_ms of the copies that are there."""
        found = transcripts.listed(self.spark, [self.config.archive], "*.gz")
        return found.select(F.col("path").alias("copy_path"), F.col("mtime_ms").alias("copy_mtime_ms"))

    def copy_files(self, listing: DataFrame) -> int:
        """Copies, in the tasks, the transcripts of conversations whose copy isn't there or of another time."""
        known = self.talks().select("archive_path", "copy_path").join(listing, F.col("archive_path") == F.col("path")).join(self.copies(), "copy_path", "left")
        changed = known.filter("copy_mtime_ms is null or copy_mtime_ms <> mtime_ms").select("archive_path", "copy_path")

        def run(frames):
            for f in frames:
                yield f.assign(n=[int(archive.copy_if_changed(a, b)) for a, b in zip(f.archive_path, f.copy_path, strict=True)])[["n"]]

        changed = changed.repartition(2 * self.spark.sparkContext.defaultParallelism)  # short rows, long work
        return changed.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def migrate_vectors(self) -> bool:
        """Embeds everything anew if the vectors are another embedder's; vectors and embedder are published together."""
        if self.store.meta_get("embedder") == self.embedder.name:
            return False
        with self.store.writing():
            exchanges = self.store.read("exchanges", self.store.manifest())
            self.store.replace_vectors(embed_exchanges(exchanges, self.embedder), embedder=self.embedder.name)
        return True

    def expire(self, out: SyncResult, cutoff: int | None, listing: DataFrame) -> None:
        if cutoff is None:
            return
        if not self.store.acquire():
            out.expiry_skipped = True
            return
        try:
            talks = self.talks()
            files = talks.select("archive_path", "copy_path").join(self.copies(), "copy_path", "left")
            files = files.join(listing.select(F.col("path").alias("archive_path"), F.col("mtime_ms").alias("source_mtime_ms")), "archive_path", "left")
            gone = lifecycle.expired(talks.drop("copy_path"), files, cutoff)
            lost = gone.select("copy_path").collect()  # what this sync forgets
            if lost:
                out.exchanges_expired = self.store.delete(lifecycle.expired_ids(gone))
                out.conversations_expired = len(lost)
                for r in lost:
                    for f in (r.copy_path, archive.summary_path(r.copy_path)):
                        if os.path.exists(f):
                            os.remove(f)
        finally:
            self.store.release()

    def sync_text(self, out: SyncResult) -> None:
        """Indexes exchanges after the text cursor; skips, and leaves the cursor, where another writer is at it.

        Postings are appended, and published with the cursor; nothing is written where nothing is new.
        """
        if not self.store.acquire():
            out.text_skipped = True
            return
        try:
            known = self.store.manifest()
            cursor = known["meta"].get(TEXT_CURSOR) or 0
            if cursor and not known["tables"].get("lengths"):
                cursor, out.text_rebuilt = 0, True
            fresh = self.store.read("exchanges", known).filter(F.col("id") >= cursor)
            out.text_indexed, top = fresh.agg(F.count("*"), F.max("id")).first()
            if out.text_indexed:
                made = bm25.build(bm25.exchange_documents(fresh), unique=True)
                self.store.publish(append={"postings": made.postings, "lengths": made.lengths}, meta={TEXT_CURSOR: top + 1})
        finally:
            self.store.release()

    def summarise(self, out: SyncResult, now_ms: int, listing: DataFrame, summarisers: dict[str, Callable[[str], str]]) -> None:
        exchanges = self.store.read("exchanges")
        talks = self.talks().join(listing.select(F.col("path").alias("archive_path"), F.col("mtime_ms").alias("source_mtime_ms")), "archive_path")
        states = transcripts.read_files(self.spark, [self.config.archive], "*-summary.txt").select(F.col("path").alias("_summary"), archive.kind_column(F.col("text")).alias("kind"))
        states = talks.select("archive_path", archive.summary_path_column(F.col("copy_path")).alias("_summary")).join(states, "_summary").select("archive_path", "kind")
        picked = [r.asDict() for r in lifecycle.summary_candidates(talks, states, now_ms, self.config.summary_limit).collect()]

        def transcript(c: dict) -> str:
            turns = F.array_sort(F.collect_list(F.struct("line_start", F.col("user_message").alias("user"), F.col("assistant_message").alias("assistant"))))
            row = exchanges.filter(F.col("archive_path") == c["source"]).groupBy().agg(turns.alias("turns")).select(transcript_text(F.col("turns"))).first()
            return row[0] or ""

        asked = [c | {"source": c["archive_path"], "archive_path": c["copy_path"]} for c in picked]
        out.summaries_written, out.summaries_failed = archive.summarise(asked, transcript, summarisers)


def hybrid(exchanges: DataFrame, vectors: DataFrame, index: bm25.TextIndex, query: str, query_vector: list[float], limit: int, mode: str = "hybrid", where: SearchFilter = SearchFilter(), stemmed: bool = True) -> DataFrame:
    """Both searches, each filtered by itself, fused by rank; the limit counts exchanges that are still there."""
    mode = "hybrid" if mode == "both" else mode
    depth = max(CANDIDATES, limit) if mode == "hybrid" else limit
    lists, near = [], None
    if mode in ("hybrid", "vector"):
        allowed = filters.matching_ids(exchanges, where)
        candidates = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
        near = knn.top_k(candidates, query_vector, depth)
        lists.append(fusion.ranked(0, near, "similarity"))
    if mode in ("hybrid", "text"):
        allowed = exchanges.filter(filters.by_epoch(where) & filters.searchable()).select("id")
        lists.append(fusion.ranked(1, bm25.search(index, query, depth, allowed, stemmed), "score"))
    fused = fusion.fuse(fusion.union(lists)).withColumnsRenamed({"rank_0": "vector_rank", "rank_1": "text_rank"})
    if near is not None:
        fused = fused.join(F.broadcast(near), "id", "left")  # ``depth`` rows
    else:
        fused = fused.withColumn("similarity", F.lit(None).cast("double"))
    shown = exchanges.withColumn("snippet", snippet(F.col("user_message"), F.col("assistant_message")))
    return fusion.in_order(F.broadcast(fused).join(shown, "id"), "vector_rank", "text_rank").limit(limit)  # 2 x ``depth`` rows are broadcast

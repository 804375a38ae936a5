"""Packing token sequences by linear grouping and best fit.

The plan depends on how many pieces there are of each length only, at most ``capacity`` numbers, and is made on the
driver.  Pieces of the full capacity are sequences by themselves.  Large lengths, sorted, are put into groups of equal
cardinality, and each is rounded up to the longest of its group.  The few sizes left make a cutting-stock problem, solved by column generation over configurations; whole
multiples of its configurations become runs of equal sequences, and what remains is packed by the best configurations in
turn.  Actual lengths then replace the rounded ones, longest first, which splits runs; and small pieces go, longest first,
into the run with the least room that holds them.  What counts as large is tried at each of ``LARGE`` shares of the
capacity, and the plan with the fewest sequences is taken; with half of it, a configuration holds one large piece, so no
plan needs more sequences than best fit of all pieces, longest first.  Runs, not sequences, are stored, so the plan's size
doesn't follow the number of documents.

Scale: texts are tokenized once, in the tasks that read them, and never shuffled; a piece travels as a few numbers.  Its
rank among pieces of its length comes from counts by (length, part), so a common length is divided; its place follows
from the rank by binary search in the plan.

Defined cases: a null text is empty and packs as its end id alone; a null doc_id is kept; equal rows are separate pieces,
in either order; a document longer than the capacity is cut from its end, so that its first piece may be shorter; an empty
table gives no sequences; other input columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, has
from .tokens import encoded, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Lengths above one of these shares of the capacity are large; they make so many groups.
LARGE, GROUPS = (0.3, 0.45, 0.5), 96
#: Parts of a length's pieces, by doc_id.
PARTS = 1024


def pieces(docs: DataFrame, path: str, spaced: bool = True, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each row of (doc_id, text)."""
    has(docs, "doc_id", "text")

    def run(batches):
        for part, ids, ends in encoded(batches, path, spaced, end):
            wide = ids.astype("<u4")
            lengths = np.diff(ends)
            number = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            head = lengths - (number - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            view = memoryview(wide.tobytes())
            at = (ends[row] + start) * 4
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def groups_of(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """Longest length and cardinality of each group, longest first; a length may be divided between groups."""
    total = sum(counts.values())
    share = -(-total // groups)
    out: list[tuple[int, int]] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            if not out or out[-1][1] == share:
                out.append((size, 0))
            take = min(left, share - out[-1][1])
            out[-1] = (out[-1][0], out[-1][1] + take)
            left -= take
    merged: dict[int, int] = {}
    for size, n in out:
        merged[size] = merged.get(size, 0) + n
    return sorted(merged.items(), reverse=True)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration (copies of each size) with the greatest total price."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gain = value[room - sizes[fits]] + prices[fits]
        k = int(np.argmax(gain))
        value[room] = value[room - 1]
        if gain[k] > value[room] + 1e-12:
            value[room], choice[room] = gain[k], fits[k]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and their (fractional) numbers that cover ``counts`` with the fewest bins: column generation."""
    m = len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    inverse = np.linalg.inv(basis)
    x = inverse @ counts
    for turn in range(60 * m + 200):
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
            x = inverse @ counts
        prices = inverse.sum(0)
        value, column = best_pattern(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        way = inverse @ column
        up = np.flatnonzero(way > 1e-9)
        if not len(up):
            break
        ratio = x[up] / way[up]
        out = up[int(np.argmin(ratio))]
        step = max(0.0, float(ratio.min()))
        x = x - step * way
        x[out] = step
        basis[:, out] = column
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
    return basis, np.maximum(x, 0)


def rounded_runs(groups: list[tuple[int, int]], capacity: int) -> list[list]:
    """Runs [number, [(group, copies)]] that hold each group's cardinality exactly."""
    sizes, left = np.array([s for s, _ in groups]), np.array([n for _, n in groups])
    columns, x = configurations(sizes.astype(float).astype(int), left.astype(float), capacity)
    runs = []

    def add(number: int, pattern: np.ndarray) -> None:
        nonlocal left
        if number:
            left = left - number * pattern
            runs.append([number, [(int(g), int(pattern[g])) for g in np.flatnonzero(pattern)]])

    for j in np.argsort(-x):
        pattern = columns[:, j].astype(int)
        fits = [left[g] // pattern[g] for g in np.flatnonzero(pattern)]
        add(int(min([int(np.floor(x[j] + 1e-9)), *fits])), pattern)
    while left.any():
        # What rounding down has left, a few bins for each configuration: the longest first, as many as fit.
        pattern, room = np.zeros(len(sizes), int), capacity
        for g in np.flatnonzero(left):
            pattern[g] = min(left[g], room // sizes[g])
            room -= int(pattern[g]) * int(sizes[g])
        add(int(min(left[g] // pattern[g] for g in np.flatnonzero(pattern))), pattern)
    return runs


def substitute(runs: list[list], counts: dict[int, int], groups: list[tuple[int, int]]) -> list[list]:
    """Runs [number, [length, ...]] with actual lengths: each group's pieces, longest first, in the order of its runs."""
    queue, lengths = [], iter(sorted(counts.items(), reverse=True))
    size, n = next(lengths)
    for _, total in groups:
        mine = []
        while total:
            if not n:
                size, n = next(lengths)
            take = min(n, total)
            mine.append([size, take])
            total, n = total - take, n - take
        queue.append(mine[::-1])
    out = []
    for number, parts in runs:
        slots = [g for g, c in parts for _ in range(c)]
        while number:
            # As many sequences alike as every group's next lengths allow, one slot after the other.
            some, need = number, {g: slots.count(g) for g in set(slots)}
            for g, c in need.items():
                have = queue[g][-1][1]
                some = min(some, max(1, have // c))
            made = []
            for g in slots:
                count = some
                size, have = queue[g][-1]
                take = min(have, count)
                if take < count:
                    # Only single sequences take slots of different lengths.
                    raise AssertionError("a run takes equal lengths")
                made.append(size)
                queue[g][-1][1] -= take
                if not queue[g][-1][1]:
                    queue[g].pop()
            out.append([some, made])
            number -= some
    return out


def best_fit(runs: list[list], counts: dict[int, int], capacity: int) -> list[list]:
    """Puts small pieces, longest first, into the runs with the least room that holds them; opens new runs for the rest."""
    rooms: dict[int, list[list]] = {}
    for run in runs:
        rooms.setdefault(capacity - sum(run[1]), []).append(run)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in rooms if r >= size and rooms[r]), default=None)
            if room is None:
                each = capacity // size
                whole, rest = divmod(left, each)
                if whole:
                    rooms.setdefault(capacity - each * size, []).append([whole, [size] * each])
                if rest:
                    rooms.setdefault(capacity - rest * size, []).append([1, [size] * rest])
                break
            run = rooms[room].pop()
            each = min(room // size, left)
            some = min(run[0], left // each)
            rooms.setdefault(room - each * size, []).append([some, run[1] + [size] * each])
            if run[0] > some:
                rooms[room].append([run[0] - some, run[1]])
            left -= some * each
    return [run for runs in rooms.values() for run in runs]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[list]:
    """Runs [number of sequences, [lengths in each]] that hold ``counts[length]`` pieces of each length."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    full = counts.pop(capacity, 0)
    plans = [grouped(counts, capacity, share) for share in LARGE]
    return [[full, [capacity]]] * bool(full) + min(plans, key=lambda runs: sum(n for n, _ in runs))


def grouped(counts: dict[int, int], capacity: int, share: float) -> list[list]:
    """Runs for the pieces, of which those longer than this share of the capacity are large."""
    large = {s: n for s, n in counts.items() if s > capacity * share}
    runs = []
    if large:
        groups = groups_of(large, GROUPS)
        runs = substitute(rounded_runs(groups, capacity), large, groups)
    return best_fit(runs, {s: n for s, n in counts.items() if s not in large}, capacity)


def places(runs: list[list]) -> dict[str, np.ndarray]:
    """The plan by length: a stretch of ranks begins at ``rank`` and fills the offset of sequences from ``sequence`` on."""
    at, sequence, rows = {}, 0, []
    for number, lengths in runs:
        offset = 0
        for size in lengths:
            rows.append((size, at.get(size, 0), sequence, offset))
            at[size] = at.get(size, 0) + number
            offset += size
        sequence += number
    rows.sort()
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(("size", "rank", "sequence", "offset"))}


def pack(docs: DataFrame, path: str, spaced: bool = True, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "packing")
    made = scratch.write(pieces(docs, path, spaced, end, capacity), "pieces").withColumn("_part", F.coalesce(F.pmod("doc_id", F.lit(PARTS)), F.lit(0)).cast("int"))
    parts = scratch.write(made.groupBy("length", "_part").agg(F.count("*").alias("n")), "parts")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))  # see plan: bounded by the capacity
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("_in", F.row_number().over(inside) - 1).join(begins, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))

    def run(batches):
        t = table.value
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            key = np.int64(1) << 40
            at = np.searchsorted(t["size"] * key + t["rank"], size * key + rank, "right") - 1
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_begin") + F.col("_in")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))

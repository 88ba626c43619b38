"""Best-fit packing by length patterns (non-negative least squares on the length histogram).

1. Each document becomes pieces of at most ``capacity`` tokens; only longer documents are cut.
2. The lengths' histogram (at most ``capacity`` numbers, whatever the corpus) is binned on a
   grid; all patterns of one to three bins that fill a sequence are enumerated, and
   non-negative least squares finds how often to use each so that the bins' documents are
   used up. Counts are rounded, and cut to what the bins hold.
3. In each pattern all documents but the shortest are fixed; its place and all that remains
   (the residual) are filled by best fit, longest first, with exact lengths. This works on
   counts of equal sequences, so its cost depends on the grid and not on the corpus.
4. Pieces get their rank among the pieces of their length by counts per task and a prefix
   sum, and the rank gives the place in the plan. No group of pieces meets in one task.

Defined cases: null text is empty; an empty document is its end-of-document id alone; rows
that repeat a doc_id are documents of their own; equal lengths are ranked by task and row
order of the written pieces; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import columns_of, frees_memory
from parcelwise.llm.tokens import default_tokenizer, encoder, forget
from parcelwise.sources.scratch import Scratch

CAPACITY, END_ID, GRID = 4096, 1, 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
                 path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with the task that made each (``part``) and its number
    among that task's pieces of its length (``nth``); ``ids`` (binary) on request."""
    path = path or default_tokenizer()

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b, ids, bounds in encoder(path).encode(batch.column(1), end_id):
                sizes = np.diff(bounds)
                pieces = (sizes + capacity - 1) // capacity
                doc = np.repeat(np.arange(b - a), pieces)
                no = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = no * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                data, at = memoryview(ids.astype("<u4").tobytes()), bounds[doc] + start
                cuts = [data[4 * i:4 * (i + n)] for i, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order])
                nth = np.empty(len(doc), dtype=np.int64)
                nth[order] = np.arange(len(doc)) - run_start
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).take(pa.array(a + doc)), pa.array(no.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                           pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    columns.append(pa.array([bytes(c) for c in cuts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        forget()
    schema = PIECES + ", part int, nth long" + (", ids binary" if with_ids else "")
    return columns_of(docs, "doc_id", "text").mapInArrow(run, schema)


def patterns(units: int) -> list[tuple[int, ...]]:
    """One to three bins, largest first, that fill a sequence of ``units``."""
    out: list[tuple[int, ...]] = [(units,)]
    out += [(a, units - a) for a in range((units + 1) // 2, units)]
    for a in range(1, units - 1):
        rest = units - a
        out += [(a, b, rest - b) for b in range((rest + 1) // 2, min(a, rest - 1) + 1)]
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |a x - b| over x >= 0 by an active set: free the column with the steepest
    descent, solve on the free columns, and step back to the border where one turns negative."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        slope = np.where(free, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        free[best] = True
        while free.any():
            at = np.flatnonzero(free)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = solved <= 0
            if not low.any():
                x[:] = 0
                x[at] = solved
                break
            room = x[at][low] - solved[low]
            step = float(np.min(np.where(room > 0, x[at][low] / np.where(room > 0, room, 1), 0.0)))
            x[at] += step * (solved - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
    return x


def pattern_counts(histogram: np.ndarray, capacity: int, grid: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern in grid bins, times), rounded and cut to what the bins hold."""
    units = capacity // grid
    lengths = np.arange(1, capacity + 1)
    bins = np.bincount((lengths + grid - 1) // grid, weights=histogram[1:], minlength=units + 1).astype(np.int64)
    shapes = patterns(units)
    matrix = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        for size in shape:
            matrix[size - 1, j] += 1
    weight = np.arange(1, units + 1) / units  # a leftover long document costs more than a short one
    times = non_negative_least_squares(matrix * weight[:, None], bins[1:] * weight)
    chosen = []
    for j in np.argsort(-times, kind="stable"):
        if times[j] < 0.5:
            break
        shape = shapes[j]
        n = min([int(round(times[j])), *(int(bins[s]) // shape.count(s) for s in set(shape))])
        if n > 0:
            chosen.append((shape, n))
            for s in shape:
                bins[s] -= n
    return chosen


class _Bin:
    """The documents of a grid bin, shortest first, as counts by length."""

    def __init__(self, left: np.ndarray, low: int, high: int):
        self.left, self.at, self.high = left, low, high

    def take(self, most: int) -> tuple[int, int]:
        while self.at < self.high and self.left[self.at] == 0:
            self.at += 1
        n = int(min(most, self.left[self.at]))
        self.left[self.at] -= n
        return self.at, n

    def give_back(self, length: int, n: int) -> None:
        self.left[length] += n


def plan(histogram: np.ndarray, capacity: int = CAPACITY, grid: int = GRID) -> tuple[np.ndarray, int]:
    """Slots and the number of sequences for ``histogram[length]`` pieces of each length.

    A slot row is (length, first rank, pieces, first sequence, offset, pieces a sequence):
    the pieces of the length with ranks from ``first rank`` go to consecutive sequences, so
    many to each, one behind the other from ``offset``.
    """
    left = histogram.astype(np.int64).copy()
    groups: dict[int, list[tuple[int, tuple]]] = {}  # room -> (sequences, items so far)

    def add(room: int, count: int, items: tuple) -> None:
        if count:
            groups.setdefault(room, []).append((count, items))

    units_bins = {u: _Bin(left, (u - 1) * grid + 1, u * grid) for u in range(1, capacity // grid + 1)}
    for shape, times in pattern_counts(histogram, capacity, grid):
        fixed = shape[:-1] or shape
        todo = times
        while todo:
            got, n = [], todo
            for u in fixed:
                length, m = units_bins[u].take(n)
                for other, _ in got:
                    if m < n:
                        units_bins[(other + grid - 1) // grid].give_back(other, n - m)
                n = m
                got.append((length, m))
            if n == 0:
                break
            items: tuple = ()
            for length, _ in got:
                items = (items, length, 1)
            add(capacity - sum(length for length, _ in got), n, items)
            todo -= n
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity + 1) if groups.get(r)), 0) if groups else 0
            each = (room or capacity) // length
            if not room:
                count, items, room = n // each + (n % each > 0), (), capacity
            else:
                count, items = groups[room].pop()
            full = min(count, n // each)
            add(room - each * length, full, (items, length, each))
            n -= full * each
            rest = count - full
            if rest and n:  # fewer are left than one more sequence would take
                k = min(n, each)
                add(room - k * length, 1, (items, length, k))
                n -= k
                rest -= 1
            if items != () or rest:
                add(room, rest, items)
    used = np.zeros(capacity + 1, dtype=np.int64)
    slots, sequence = [], 0
    for room in sorted(groups):
        for count, items in groups[room]:
            chain = []
            while items:
                items, length, each = items
                chain.append((length, each))
            offset = 0
            for length, each in reversed(chain):
                slots.append((length, used[length], count * each, sequence, offset, each))
                used[length] += count * each
                offset += each * length
            sequence += count
    rows = np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)
    return rows, sequence


def place(slots: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks."""
    big = np.int64(1) << np.int64(48)
    at = np.searchsorted(slots[:, 0] * big + slots[:, 1], length * big + rank, side="right") - 1
    slot = slots[at]
    nth = rank - slot[:, 1]
    return slot[:, 3] + nth // slot[:, 5], slot[:, 4] + nth % slot[:, 5] * length


def pack(pieces: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """``token_pieces`` with ``sequence_id`` and ``offset``. The plan that each task gets is
    bounded by the grid and the capacity, not by the corpus."""
    scratch = Scratch(pieces.sparkSession, "packing")
    written = scratch.table(pieces, "pieces")
    counts = scratch.table(written.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    slots, _ = plan(histogram, capacity, grid)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    names = [c for c in written.columns if c not in ("part", "nth")]
    ranked = written.join(bases, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    kinds = {f.name: f.dataType.simpleString() for f in written.schema.fields}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "sequence_id long", "offset long"])

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            sequence, offset = place(slots, length, batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])
    return ranked.select(*names, "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(token_pieces(docs, capacity, path=path), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (one array a sequence)."""
    packed = pack(token_pieces(docs, capacity, path=path, with_ids=True), capacity)
    one = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("items"))

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in items), dtype="<u4").astype(np.int64)
                   for items in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))],
                names=["sequence_id", "n_tokens", "ids"])
    return one.mapInArrow(run, "sequence_id long, n_tokens long, ids array<long>")

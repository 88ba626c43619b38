"""Exact k-nearest-neighbour scoring (Euclidean, uniform vote) with an index of boxes.

A tree of at most about ``LISTS`` cells is fitted on a bounded sample of the training rows (``SAMPLE_ROWS``
least hashes of the id); every training row is assigned to a cell, and the rows are written to the shared
folder in the order of the cells as files of at most ``BLOCK_ROWS`` rows. A directory has the least and
largest coordinates (boxes) per file and cell. A file whose boxes are beyond the k-th best distance of
a query so far is not measured for it, and not read if that holds for all queries at hand. A file that
is read is split into parts of at most ``PART_ROWS`` rows that lie together (``Parts``), and its parts are
tested again by box and ball. The tree and the parts cut coordinates of two values (one-hot levels)
first, as such a cut is clean. The result is exact whatever cells and parts are; they only decide how
much is skipped.

Query rows are brought together by their cell. A task holds ``QUERY_ROWS`` of them at a time; small groups
begin with the rows about them, then all go through the files, one at a time: neither the driver nor
a task ever holds more than one file, and no pair becomes a row. Distances (at most ``QUERY_TILE`` x
``PART_ROWS``) come from one matrix product of centred rows. That form rounds, so every training row within
a proven rounding bound of the k-th best is measured again by exact differences; ties go to the
smaller training id. Rows without a vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.sources.scratch import Scratch

BLOCK_ROWS, PART_ROWS, TILE_ROWS, QUERY_ROWS = 8192, 64, 1024, 16_384
#: Queries of a product, whose bounds are in the cache, and of a group that begins with its nearest FIRST_ROWS rows.
QUERY_TILE, BOUND_ROWS, GROUP_ROWS, FIRST_ROWS = 4096, 128, 256, 512
#: How many times the variance of a coordinate of two values counts when rows are parted.
CLEAN = 16.0
#: Rows of which a cut must take off one at least.
LEAST = 32
#: Coordinates that a part's box is tested in one by one.
WIDE = 12
#: The index: training rows that cells are fitted on, cells (about), rows of the sample in a cell at least.
SAMPLE_ROWS, LISTS, ROWS_PER_LIST = 10_000, 256, 16
#: Pairs measured exactly at a time.
PAIRS = 1 << 20
_EPS = np.finfo(float).eps


def _exact(rows: np.ndarray, v: np.ndarray, row: np.ndarray | slice = slice(None),
           other: np.ndarray | tuple = ()) -> np.ndarray:
    """Squared distances (of rows to the one row ``v``, or pair by pair of ``rows[row]`` to ``v[other]``) summed
    coordinate by coordinate in a fixed order, so that a value (and the order of ties) never depends on
    how rows were batched. One coordinate of the pairs is held at a time, not their vectors."""
    acc = np.zeros(len(rows[:, :0][row]))
    for j in range(rows.shape[1]):
        step = rows[:, j][row] - v[..., j][other]
        acc += step * step
    return acc


class Tile:
    """Queries that lie together: their numbers and the factors of one matrix product, moved by their mean."""

    def __init__(self, queries: np.ndarray, mine: np.ndarray):
        x = queries[mine]
        self.mine, self.centre = mine, x.mean(axis=0)
        moved = x - self.centre
        self.squares = np.einsum("ij,ij->i", moved, moved)
        self.factors = np.column_stack([moved * -2.0, self.squares, np.ones(len(x))])


class Nearest:
    """The k nearest training rows of some query rows, block after block. Places not taken yet have an
    infinite distance; ``measured`` counts the pairs compared per query. ``cut`` is never below the k-th
    best distance: it comes from the k least upper bounds of distances so far (``low``)."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, exclude_self: bool):
        self.queries, self.query_ids, self.k, self.exclude_self = queries, query_ids, k, exclude_self
        n = len(queries)
        self.distance = np.full((n, k), np.inf)
        self.known = np.zeros((n, k), dtype=query_ids.dtype)
        self.votes = np.zeros((n, k))
        self.measured = np.zeros(n, dtype=np.int64)
        self.low, self.cut = np.full((n, k), np.inf), np.full(n, np.inf)
        self._pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._pairs = 0

    @property
    def best(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per query (squared distances, ids, labels), nearest first."""
        found = np.isfinite(self.distance).sum(axis=1)
        return [(d[:n], i[:n], v[:n]) for d, i, v, n in zip(self.distance, self.known, self.votes, found)]

    def add(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, which: np.ndarray | None = None) -> None:
        """Compares the block with the queries (numbers ``which``, or all)."""
        which = np.arange(len(self.queries)) if which is None else which
        for at in range(0, len(which), TILE_ROWS):
            tile = Tile(self.queries, which[at:at + TILE_ROWS])
            for first in range(0, len(rows), TILE_ROWS):
                self.offer(tile, np.arange(len(tile.mine)), rows, ids, labels, first, min(first + TILE_ROWS, len(rows)))
            self.settle(rows, ids, labels)

    def offer(self, tile: Tile, which: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray,
              first: int, last: int) -> None:
        """Compares rows ``first`` to ``last`` of the block with the queries ``which`` of a tile. Pairs that may
        be among the k best are kept until ``settle`` measures them exactly."""
        mine = tile.mine[which]
        self.measured[mine] += last - first
        near = rows[first:last] - tile.centre
        near_sq = np.einsum("ij,ij->i", near, near)
        factors = tile.factors if len(which) == len(tile.mine) else tile.factors[which]
        rough = factors @ np.column_stack([near, np.ones(len(near)), near_sq]).T
        # differences, squares and product each round by at most (dims + 2) units
        slack = 16 * (rows.shape[1] + 2) * _EPS * (tile.squares[which] + near_sq.max())
        close = rough <= (self.cut[mine] + slack)[:, None]
        some = np.flatnonzero(close.any(axis=1))
        if not len(some):
            return
        if len(some) < len(mine):
            mine, rough, close, slack = mine[some], rough[some], close[some], slack[some]
        if self.exclude_self:
            close &= ids[None, first:last] != self.query_ids[mine][:, None]
        upper = np.where(close, rough + slack[:, None], np.inf)
        upper = np.concatenate([self.low[mine], upper], axis=1)
        upper.partition(self.k - 1, axis=1)
        self.low[mine] = upper[:, :self.k]
        self.cut[mine] = np.minimum(self.cut[mine], upper[:, self.k - 1])
        close &= rough <= (self.cut[mine] + slack)[:, None]
        query, row = np.nonzero(close)
        self._pending.append((mine[query], row + first, rough[query, row] - slack[query]))
        self._pairs += len(query)
        if self._pairs > PAIRS:
            self.settle(rows, ids, labels)

    def settle(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Measures the pairs kept from this block."""
        if not self._pairs:
            return
        query, row, least = map(np.concatenate, zip(*self._pending))
        self._pending, self._pairs = [], 0
        still = least <= self.cut[query]
        order = np.argsort(query[still], kind="stable")
        query, row = query[still][order], row[still][order]
        mine, place = np.unique(query, return_inverse=True)
        ends = np.searchsorted(place, np.arange(len(mine)), side="right")
        first = 0
        while first < len(mine):  # as many queries at a time as have PAIRS rows, at least one
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            self._merge(mine[first:last], place[done:ends[last - 1]] - first, row[done:ends[last - 1]], rows, ids, labels)
            first = last
        self.cut[mine] = np.minimum(self.cut[mine], self.distance[mine, -1])

    def _merge(self, mine: np.ndarray, query: np.ndarray, row: np.ndarray, rows: np.ndarray, ids: np.ndarray,
               labels: np.ndarray) -> None:
        old_query, old_place = np.nonzero(np.isfinite(self.distance[mine]))
        held = mine[old_query]
        whose = np.concatenate([old_query, query])
        distance = np.concatenate([self.distance[held, old_place], _exact(rows, self.queries, row, mine[query])])
        known = np.concatenate([self.known[held, old_place], ids[row]])
        votes = np.concatenate([self.votes[held, old_place], labels[row]])
        order = np.lexsort((known, distance, whose))
        whose = whose[order]
        place = np.arange(len(whose)) - np.searchsorted(whose, whose)
        order, whose, place = order[place < self.k], whose[place < self.k], place[place < self.k]
        if known.dtype != self.known.dtype:  # longer text ids
            self.known = self.known.astype(np.promote_types(known.dtype, self.known.dtype))
        at = mine[whose]
        self.distance[at, place], self.known[at, place], self.votes[at, place] = distance[order], known[order], votes[order]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _two_valued(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which coordinates take two values at most, and the least values."""
    if not len(x):
        return np.ones(x.shape[1], dtype=bool), np.zeros(x.shape[1])
    low, high = x.min(axis=0), x.max(axis=0)
    return ((x == low) | (x == high)).all(axis=0), low


def _halves(x: np.ndarray, two: np.ndarray, least: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """The coordinate and value that part the rows, and which rows are at or below it; None for equal rows and
    where that would take off less than one row in ``LEAST`` (a vine of hundreds of rare levels).
    The coordinate that varies most is cut at its median; one of two values parts the rows cleanly, so
    its variance counts ``CLEAN`` times."""
    spread = x.var(axis=0) * np.where(two, CLEAN, 1.0)
    if not len(spread) or not spread.max() > 0.0:
        return None
    j = int(spread.argmax())
    value = x[:, j]
    cut = least[j] if two[j] else np.median(value)
    if not (value > cut).any():
        cut = value[value < cut].max(initial=-np.inf)
    left = value <= cut
    share = min(int(left.sum()), int(len(left) - left.sum()))
    return None if share * LEAST < len(left) else (j, float(cut), left)


class Cells:
    """A tree over a sample of the training rows; its leaves are numbered so that neighbours in number lie
    together. Cells decide which rows share a file, never a result."""

    def __init__(self, x: np.ndarray):
        two, least = _two_valued(x)
        most = max(ROWS_PER_LIST, -(-len(x) // LISTS))
        self.nodes: list[tuple] = []  # (coordinate, cut, left node, right node) or (cell,)
        self.size = 0

        def grow(some: np.ndarray) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            found = _halves(x[some], two, least) if len(some) > most else None
            if found:
                j, cut, left = found
                one = grow(some[left])
                self.nodes[at] = (j, cut, one, grow(some[~left]))
            else:
                self.nodes[at] = (self.size,)
                self.size += 1
            return at
        grow(np.arange(len(x)))

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, some = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[some] = node[0]
            elif len(some):
                left = x[some, node[0]] <= node[1]
                todo += [(node[2], some[left]), (node[3], some[~left])]
        return out


def _sample(train: DataFrame) -> np.ndarray:
    return _matrix(train.orderBy(F.xxhash64("id"), "id").select("x").limit(SAMPLE_ROWS).toArrow()["x"])


def _assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` (last column: the vector) with the number of their cell."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = cells.of(_matrix(batch.column(len(names) - 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*names, "cell"])
    return rows.mapInArrow(run, rows.withColumn("cell", F.lit(0)).schema)


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, least, largest coordinates) of the rows of each file and cell in a batch of (file, cell, x)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, names = _matrix(batch.column(2)), batch.column(0).to_pylist()
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(names, batch.column(1).to_pylist())):
            groups.setdefault(key, []).append(i)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name for name, _ in groups]), pa.array([x[g].min(axis=0).tolist() for g in groups.values()], pa.list_(pa.float64())),
             pa.array([x[g].max(axis=0).tolist() for g in groups.values()], pa.list_(pa.float64()))], names=["file", "low", "high"])


def _box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray, coordinates=None) -> np.ndarray:
    """Per query and box the squared distance to it (in some coordinates), rounded by (dims + 2) units at most."""
    out = np.zeros((len(queries), len(low)))
    for j in range(queries.shape[1]) if coordinates is None else coordinates:
        away = np.maximum(low[:, j] - queries[:, j, None], queries[:, j, None] - high[:, j])
        np.maximum(away, 0.0, out=away)
        away *= away
        out += away
    return out


def _file_bounds(queries: np.ndarray, boxes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per query no row of a file is nearer than this (squared)."""
    near = [_box_bounds(queries[at:at + BOUND_ROWS], *boxes).min(axis=1) for at in range(0, len(queries), BOUND_ROWS)]
    return np.concatenate(near) * (1 - 8 * (queries.shape[1] + 4) * _EPS)


def _together(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``most`` rows that lie together."""
    two, least = _two_valued(x)
    done, todo = [], [np.arange(len(x))]
    while todo:
        some = todo.pop()
        if len(some) <= most:
            done.append(some)
            continue
        found = _halves(x[some], two, least)
        if found:
            todo += [some[~found[2]], some[found[2]]]
        else:  # equal rows, or many rare levels: neighbouring levels stay together
            some = some[np.argsort(x[some] @ np.arange(x.shape[1]), kind="stable")]
            todo += [some[len(some) // 2:], some[:len(some) // 2]]
    return done


class Parts:
    """The rows of a file in parts that lie together, and what bounds their distances: a part's box (its
    ``WIDE`` coordinates that vary most, and those in which all its rows are equal) and its ball."""

    def __init__(self, x: np.ndarray, most: int):
        groups = _together(x, most)
        self.order = np.concatenate(groups)
        self.starts = np.cumsum([0, *map(len, groups)])
        x = x[self.order]
        at, sizes = self.starts[:-1], np.diff(self.starts)
        self.low, self.high = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
        many = np.flatnonzero(~_two_valued(x)[0])
        self.wide = many[np.argsort(-x[:, many].var(axis=0), kind="stable")[:WIDE]]
        self.middle = x.mean(axis=0)
        self.same = (self.low == self.high).astype(float)
        self.same[:, self.wide] = 0.0
        self.equal = (self.low - self.middle) * self.same
        self.balls = np.add.reduceat(x, at) / sizes[:, None] - self.middle
        away = (x - self.middle) - np.repeat(self.balls, sizes, axis=0)
        self.radius = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", away, away), at))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and part: no row of the part is nearer than this (squared)."""
        unit = 32 * (queries.shape[1] + 4) * _EPS
        moved = queries - self.middle
        squares = np.einsum("ij,ij->i", moved, moved)[:, None]
        held, ball = (self.equal * self.equal).sum(axis=1), (self.balls * self.balls).sum(axis=1)
        box = (moved * moved) @ self.same.T - 2.0 * (moved @ self.equal.T) + held - unit * (squares + held)
        np.maximum(box, 0.0, out=box)
        box += _box_bounds(queries, self.low, self.high, self.wide)
        apart = squares - 2.0 * (moved @ self.balls.T) + ball
        apart = np.sqrt(np.maximum(apart - unit * (squares + ball), 0.0))
        apart -= self.radius + unit * (apart + self.radius + np.sqrt(squares))
        np.maximum(apart, 0.0, out=apart)
        return np.maximum(box, apart * apart) * (1 - unit)


def knn_scores(train: DataFrame, query: DataFrame, k: int = 25, features: str = "x",
               label: str = "y", train_id: str = "tid", query_id: str = "qid",
               exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each query row: ``prob`` (share of label 1 among the k nearest training rows),
    ``pred`` (prob > 0.5), ``neighbours`` (ids of the k nearest, nearest first), ``n_positive`` and
    ``measured`` (training rows that the query was compared with).

    ``features`` is an array<double> column in both frames; ``exclude_self`` drops the
    training row whose id equals the query id (leave-one-out on one table).
    """
    spark = train.sparkSession
    scratch = Scratch(spark, "knn")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kept = train.select(F.col(train_id).alias("id"), F.col(label).cast("double").alias("y"),
                        F.col(features).cast("array<double>").alias("x")).where("x is not null")
    cells = Cells(_sample(kept))
    placed = scratch.table(_assigned(kept, cells), "placed")
    path = scratch.path("train")
    # rows of a cell are told apart by the id's hash, so that they need not lie in one range
    order = ["cell", F.xxhash64("id")]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", block_rows).parquet(path)
    scratch.drop(placed)
    directory = scratch.path("directory")
    spark.read.schema(placed.schema).parquet(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "cell", "x") \
        .mapInArrow(_boxes, "file string, low array<double>, high array<double>").write.parquet(directory)
    shared, listed = (p if ":" in p.split("/")[0] else "file://" + p for p in (path, directory))
    kind = query.select(query_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(shared)
        where = fs.FileSystem.from_uri(listed)[1]
        entries: dict[str, list] = {}
        for f in store.get_file_info(fs.FileSelector(where)):
            if f.path.endswith(".parquet"):
                for r in pq.read_table(f.path, filesystem=store).to_pylist():  # a few for each file and cell
                    entries.setdefault(r["file"], []).append((r["low"], r["high"]))
        files = {name: tuple(np.array(side, dtype=float) for side in zip(*rows)) for name, rows in sorted(entries.items())}

        def read(name: str) -> tuple:
            block = pq.read_table(f"{root}/{name}", filesystem=store)
            x = _matrix(block["x"])
            parts = Parts(x, PART_ROWS)
            return parts, *(v[parts.order] for v in (x, np.array(block["id"].to_pylist()), block["y"].to_numpy()))

        def search(ids: pa.Array, queries: np.ndarray) -> pa.RecordBatch:
            nearest = Nearest(queries, np.array(ids.to_pylist()), k, exclude_self)
            names = list(files)
            near = np.array([_file_bounds(queries, files[n]) for n in names]).reshape(len(names), len(queries))
            every = Tile(queries, np.arange(len(queries)))
            # the rows about each small group of queries first, so that most files and parts are far
            groups: dict[int, list[np.ndarray]] = {}
            for mine in _together(queries, GROUP_ROWS) if names else []:
                groups.setdefault(int(near[:, mine].mean(axis=1).argmin()), []).append(mine)
            met: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for f, some in groups.items():
                parts, *block = read(names[f])
                for mine in some:
                    first = parts.bounds(queries[mine]).mean(axis=0).argsort(kind="stable")
                    first = first[:1 + int(np.searchsorted(np.cumsum(np.diff(parts.starts)[first]), FIRST_ROWS))]
                    for p in first:
                        nearest.offer(every, mine, *block, parts.starts[p], parts.starts[p + 1])
                    met.setdefault(f, []).append((mine, first))
                nearest.settle(*block)
            for f in near.mean(axis=1).argsort(kind="stable"):
                which = np.flatnonzero(~(near[f] > nearest.cut))
                if not len(which):
                    continue
                parts, *block = read(names[f])
                bounds = np.concatenate([parts.bounds(queries[which[at:at + BOUND_ROWS]]).T
                                         for at in range(0, len(which), BOUND_ROWS)], axis=1)
                place = np.full(len(queries), -1)
                place[which] = np.arange(len(which))
                for mine, first in met.get(f, []):
                    bounds[first[:, None], place[mine][place[mine] >= 0]] = np.inf  # compared before
                for p in bounds.mean(axis=1).argsort(kind="stable"):
                    needed = which[~(bounds[p] > nearest.cut[which]) & (bounds[p] != np.inf)]
                    for at in range(0, len(needed), QUERY_TILE):
                        nearest.offer(every, needed[at:at + QUERY_TILE], *block, parts.starts[p], parts.starts[p + 1])
                nearest.settle(*block)
            best = nearest.best
            positive = np.array([v.sum() for _, _, v in best])
            found = np.maximum(np.array([len(v) for _, _, v in best]), 1)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(positive / found), pa.array((positive / found > 0.5).astype(np.int32)),
                 pa.array([known.tolist() for _, known, _ in best], pa.list_(ids.type)),
                 pa.array(positive.astype(np.int32)), pa.array(nearest.measured)],
                names=[query_id, "prob", "pred", "neighbours", "n_positive", "measured"])

        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).select([0, 1]).combine_chunks()
            held.clear()
            for at in range(0, table.num_rows, QUERY_ROWS):
                some = table.slice(at, QUERY_ROWS).combine_chunks()
                yield search(some.column(0).chunk(0), _matrix(some.column(1)))
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= QUERY_ROWS:
                yield from flush()
        if held:
            yield from flush()
    rows = query.select(F.col(query_id), F.col(features).cast("array<double>").alias("x")).where("x is not null")
    if cells.size > 1:
        rows = _assigned(rows, cells).repartitionByRange(parts, "cell", F.xxhash64(query_id)).sortWithinPartitions("cell")
    return rows.select(query_id, "x").mapInArrow(
        run, f"{query_id} {kind}, prob double, pred int, neighbours array<{kind}>, n_positive int, measured long")

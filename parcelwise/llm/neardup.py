"""MinHash near-dedup by a chosen-path set similarity join.

Words are runs of non-white-space, A-Z lower-cased; a document's set holds its distinct
shingles of ``width`` words (with fewer words, the whole sequence). Two documents are linked
if intersection / union of the full sets is at least ``percent`` / 100. Rows with equal sets
form a class, whatever their ids; a class is one vertex of the join.

Forest: in each of ``TREES`` independent trees a document goes from the root to the node of
one chosen minwise token (the least shingle under the tree's own hash). A pair of similarity
s shares a tree's node with probability s, so a pair at the threshold 0.85 is missed by all
eight trees with probability 3e-7, at 0.8 with 3e-6. Nodes of at most ``LEAF`` documents are
compared exhaustively, on the minwise signature first and then on the full sets. Larger
nodes are cut in this order:

* all documents are in one component already: nothing is left to find;
* at most ``CHUNK`` documents are outside the node's largest component: these are compared
  with the node's other documents, chunk by chunk;
* chunks of the node are compared in themselves and with a few hubs, which joins large groups
  of near copies in one component at linear cost;
* otherwise the node branches into ``BRANCHES`` children per document, by further tokens; with
  no token left, its chunks are compared with each other.

Only pairs from different components are compared, and a comparison emits the edges of a
spanning forest, not all links: results are components, which lose no link between texts.

Defined cases: null or blank text has an empty set and is linked with nothing. A row without
an id takes part like any other: its component_id is the smallest doc_id reachable, or null where
no row has one, and it is not kept. Rows that repeat a doc_id are linked with each other, whatever
their texts. ``keep_one`` goes by texts alone: of each group of linked texts the row of the smallest
doc_id stays (of each text, if that id has several), and every row without an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import wordhash as wh
from parcelwise.llm.common import columns_of, frees_memory
from parcelwise.llm.components import components
from parcelwise.sources.scratch import Scratch

POSITIONS, TREES, FIRST_TREES = 32, 8, 2
LEAF, CHUNK, BRANCHES, HUBS = 8000, 2000, 3, 8
BIT_BYTES, ID_BITS, HASH_BYTES = 100_000_000, 27, 6
_RNG = np.random.Generator(np.random.PCG64(7919))
_FACTOR = _RNG.integers(0, 2**64, POSITIONS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _RNG.integers(0, 2**64, POSITIONS, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat, bounds): the sorted distinct shingle hashes of each text of a slice."""
    start, end, first = wh.word_bounds(raw, offsets)
    words = wh.word_hashes(raw, start, end, lower=True)
    runs, sets = wh.windows(words, width), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(runs[a:b - width + 1]))
        else:
            sets.append(wh.windows(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each set under each of the hash functions (0 for an empty set)."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, POSITIONS), dtype=np.uint64)
    if len(full):
        for k in range(POSITIONS):
            values = (flat ^ _SHIFT[k]) * _FACTOR[k]
            out[full, k] = np.minimum.reduceat(values ^ (values >> np.uint64(31)), bounds[full])
    return out


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = wh.text_buffers(batch.column(1))
    for a, b in wh.slices(offsets):
        off = offsets[a:b + 1]
        yield a, b, *shingle_sets(raw[off[0]:off[-1]], off - off[0], width)


def _long_lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))


def _keys(flat: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """The size and two hashes of each whole set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(wh.mix(flat ^ s), dtype=np.uint64)]) for s in _SHIFT[:2]]
    return [pa.array(np.diff(bounds)), *[pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums]]


KEYS = ["n_shingles", "key1", "key2"]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and its minwise signature."""
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, bounds in _slices(batch, width):
                sig = signatures(flat, bounds)
                steps = np.arange(b - a + 1) * POSITIONS
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *_keys(flat, bounds), _long_lists(sig.reshape(-1), steps)],
                    names=["doc_id", *KEYS, "sig"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, key1 long, key2 long, sig array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """The keys of each text's set, and ``set``: its sorted 48-bit shingle hashes, ``HASH_BYTES`` each."""
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, bounds in _slices(batch, width):
                high = np.ascontiguousarray(flat.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()
                sets = [high[HASH_BYTES * x:HASH_BYTES * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*_keys(flat, bounds), pa.array(sets, pa.binary())], names=[*KEYS, "set"])
    return docs.select("doc_id", "text").mapInArrow(run, "n_shingles long, key1 long, key2 long, set binary")


def with_keys(rows: DataFrame, text: str, width: int) -> DataFrame:
    """``rows`` and the keys of the set of their column ``text``."""
    names = rows.columns

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, bounds in _slices(batch, width):
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns[2:]], *_keys(flat, bounds)],
                                                 names=[*names, *KEYS])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"{k} long" for k in KEYS])
    return rows.select(F.lit(0).alias("first"), F.col(text).alias("second"), *names).mapInArrow(run, schema)


def unpack_sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, bounds) of packed sets."""
    cells = column.to_pylist()
    raw = np.frombuffer(b"".join(cells), dtype=np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 8 - HASH_BYTES:] = raw
    sizes = np.array([len(c) // HASH_BYTES for c in cells], dtype=np.int64)
    return wide.view(">u8").reshape(-1).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def in_groups(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on the rows of each ``task`` (its first column), streamed from sorted partitions.
    Groups are bounded by the caller; a partition is never held whole."""
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b == a:
                    continue
                if held and held[-1].column(0)[0].as_py() != keys[a]:
                    out = work(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None:
                yield out
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, schema)


def _plausible(cutoff: int) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Documents of a group with a partner of another component at ``cutoff`` equal positions."""
    def work(group: pa.Table) -> pa.RecordBatch | None:
        comp = group.column("comp").to_numpy()
        if (comp == comp[0]).all():
            return None
        lists = group.column("sig").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sig = lists.flatten().to_numpy().reshape(-1, POSITIONS)
        n = len(sig)
        keep = np.zeros(n, dtype=bool)
        for i in range(n - 1):
            same = (sig[i + 1:] == sig[i]).sum(axis=1) >= cutoff
            same &= comp[i + 1:] != comp[i]
            if same.any():
                keep[i] = True
                keep[i + 1:] |= same
        if not keep.any():
            return None
        rows = group.select(["task", "doc", "comp"]).filter(pa.array(keep)).combine_chunks()
        return rows.to_batches()[0]
    return work


def _overlaps(flat: np.ndarray, bounds: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function (i, others) -> sizes of the intersections of set i with other sets.

    Only shingles of two sets or more can be shared; they are numbered, and a set becomes a
    bit row of them. Sets of long texts with few neighbours stay sorted lists instead, so that
    the rows never take more than ``BIT_BYTES``.
    """
    size = np.diff(bounds)
    codes, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    width = int(shared.sum() + 63) // 64
    if width * 8 * len(size) <= BIT_BYTES:
        bits = np.zeros((len(size), max(width, 1)), dtype=np.uint64)
        row, code = np.repeat(np.arange(len(size)), size)[shared[which]], number[which[shared[which]]]
        np.bitwise_or.at(bits, (row, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
        return lambda i, others: np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)

    def by_search(i: int, others: np.ndarray) -> np.ndarray:
        mine, out = flat[bounds[i]:bounds[i + 1]], np.zeros(len(others), dtype=np.int64)
        for k, j in enumerate(others.tolist()):
            theirs = flat[bounds[j]:bounds[j + 1]]
            found = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            out[k] = (mine[found] == theirs).sum()
        return out
    return by_search


def _linked(percent: int) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Edges of a spanning forest of the links between components of a group, by full sets."""
    def work(group: pa.Table) -> pa.RecordBatch | None:
        comp = group.column("comp").to_numpy().copy()
        flat, bounds = unpack_sets(group.column("set"))
        size = np.diff(bounds)
        overlap = _overlaps(flat, bounds)
        edges: list[tuple[int, int]] = []
        for i in range(len(comp) - 1):
            others = np.flatnonzero(comp[i + 1:] != comp[i]) + i + 1
            low, high = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
            others = others[(100 * low >= percent * high) & (low > 0)]
            if not len(others):
                continue
            shared = overlap(i, others)
            for j in others[100 * shared >= percent * (size[i] + size[others] - shared)].tolist():
                if comp[j] != comp[i]:
                    edges.append((comp[i], comp[j]))
                    comp[comp == comp[j]] = comp[i]
        if not edges:
            return None
        a, b = zip(*edges, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return work


class IdBits:
    """A set of ids as hashed bits: at most ``2 ** (ID_BITS - 6)`` words of 64, at any corpus size.

    It may take other ids for its own, never its own for others. It only keeps texts that cannot
    matter out of a shuffle; exact joins follow. Should it fill up, more texts pass."""

    def __init__(self, ids: DataFrame, column: str, scratch: Scratch):
        word, bit = self._place(F.col(column))
        one = F.expr("shiftleft(1L, bit)")
        words = ids.where(F.col(column).isNotNull()).select(word.alias("word"), bit.alias("bit"))
        self.words = scratch.table(words.groupBy("word").agg(F.bit_or(one).alias("bits")), "id_bits")

    @staticmethod
    def _place(column: Column) -> tuple[Column, Column]:
        place = F.shiftrightunsigned(F.xxhash64(column.cast("long")), 64 - ID_BITS)
        return F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")

    def mark(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with a column ``name``: whether ``column`` may be one of the ids (null: no)."""
        word, bit = self._place(F.col(column))
        known = self.words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
        joined = rows.withColumn("__bit", bit).join(F.broadcast(known), word == F.col("__word"), "left")
        hit = F.expr("shiftrightunsigned(__bits, __bit) & 1 = 1")
        return joined.withColumn(name, F.coalesce(F.col(column).isNotNull() & hit, F.lit(False))).drop("__word", "__bits", "__bit")


class Forest:
    """The join's state: signatures, the edges found so far, and components."""

    def __init__(self, docs: DataFrame, classes: DataFrame, sigs: DataFrame, repeated: IdBits, width: int,
                 percent: int, scratch: Scratch):
        self.docs = repeated.mark(docs, "doc_id", "again")  # rows that may be one of several of their class
        self.classes = classes  # doc (the vertex), rep (an id of the class, or null) and the keys
        self.sigs, self.width, self.percent, self.scratch = sigs, width, percent, scratch
        share = percent / 100
        self.cutoff = max(1, int(POSITIONS * (share - 5 * (share * (1 - share) / POSITIONS) ** 0.5)))
        self.comps: DataFrame | None = None
        self.sets: list[DataFrame] = []
        self.asked: list[DataFrame] = []

    def with_comp(self, rows: DataFrame) -> DataFrame:
        if self.comps is None:
            return rows.withColumn("comp", F.col("doc"))
        comps = self.comps.withColumnRenamed("vertex", "doc")
        return rows.join(comps, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")

    def compare(self, tasks: DataFrame) -> None:
        """Compare the documents of each task (task, doc) and bring the components up to date."""
        scratch = self.scratch
        rows = self.with_comp(tasks.select("task", "doc"))
        signed = rows.join(self.sigs, "doc").select("task", "doc", "comp", "sig")
        pairs = scratch.table(in_groups(signed, _plausible(self.cutoff), "task long, doc long, comp long"), "plausible")
        wanted = pairs.select("doc").distinct()
        for known in self.asked:
            wanted = wanted.join(known, "doc", "left_anti")
        wanted = scratch.table(wanted.join(self.classes, "doc").select("doc", "rep"), "wanted")
        texts = IdBits(wanted, "rep", scratch).mark(self.docs, "doc_id", "asked")
        texts = texts.where(F.col("asked") | F.col("doc_id").isNull())
        # sets that were not asked for find no partner in the join below
        several = F.col("again") | F.col("doc_id").isNull()
        once, again = full_sets(texts.where(~several), self.width), full_sets(texts.where(several), self.width)
        self.sets.append(scratch.table(once.union(again.dropDuplicates(KEYS)), "sets"))
        self.asked.append(wanted.select("doc"))
        sets = self.sets[0]
        for more in self.sets[1:]:
            sets = sets.union(more)
        held = pairs.join(self.classes.select("doc", *KEYS), "doc").join(sets, KEYS).select("task", "doc", "comp", "set")
        edges = in_groups(held, _linked(self.percent), "a long, b long")
        if self.comps is not None:
            edges = edges.union(self.comps.select("vertex", "component"))
        edges = scratch.table(edges, "links")
        old, self.comps = self.comps, scratch.table(components(edges, scratch), "components")
        scratch.drop(old, pairs, edges)

    def nodes(self, rows: DataFrame, name: str) -> DataFrame:
        """(node, doc, n, level) of the nodes with two documents or more."""
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return self.scratch.table(rows.join(sizes, "node"), name)

    def grow(self, trees: range) -> None:
        """Branch, compare and contract until no node of these trees is left to cut."""
        places = F.array(*[F.struct(F.lit(t).alias("t"), F.col("sig")[t].alias("v")) for t in trees])
        roots = self.sigs.select("doc", F.explode(places).alias("p")).select(
            F.xxhash64("p.t", "p.v").alias("node"), "doc", F.lit(1).alias("level"), F.lit(False).alias("starred"))
        found = self.nodes(roots, "nodes")
        self.compare(found.where(F.col("n") <= LEAF).select(F.col("node").alias("task"), "doc"))
        big = self.scratch.table(found.where(F.col("n") > LEAF), "large")
        self.scratch.drop(found)
        while not big.isEmpty():
            big = self.cut(big)

    def cut(self, big: DataFrame) -> DataFrame:
        """One round on the large nodes; returns those that are still large."""
        scratch = self.scratch
        rows = scratch.table(self.with_comp(big.select("node", "doc", "n", "level", "starred")), "large")
        by_comp = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c"))
        main = by_comp.groupBy("node").agg(F.max(F.struct("c", "comp")).alias("main"))
        rows = rows.join(main, "node").withColumn("outside", F.col("n") - F.col("main.c")) \
            .withColumn("chunks", F.ceil(F.col("n") / CHUNK)).where("outside > 0")
        rows = scratch.table(rows, "large")
        chunk = F.pmod(F.xxhash64("doc"), F.col("chunks"))
        task = lambda *parts: F.xxhash64("node", *parts).alias("task")
        few = rows.where(F.col("outside") <= CHUNK)
        inner = few.where(F.col("comp") == F.col("main.comp")).select(task(chunk), "doc")
        outer = few.where(F.col("comp") != F.col("main.comp")).withColumn(
            "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(task("chunk"), "doc")
        many = rows.where(F.col("outside") > CHUNK)
        unstarred = many.where(~F.col("starred"))
        hubs = unstarred.groupBy("node", "chunks").agg(F.min_by("doc", F.xxhash64("doc", "node", F.lit(1))).alias("h0"), *[
            F.min_by("doc", F.xxhash64("doc", "node", F.lit(h + 1))).alias(f"h{h}") for h in range(1, HUBS)])
        hubs = hubs.select("node", "chunks", F.explode(F.array_distinct(F.array(*[f"h{h}" for h in range(HUBS)]))).alias("doc"))
        hubs = hubs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        stars = unstarred.select(task(chunk), "doc").union(hubs.select(task("chunk"), "doc")).distinct()
        last = many.where(F.col("starred") & (F.col("level") >= POSITIONS - TREES))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        blocks = last.withColumn("other", other).select(
            task(F.least(chunk, "other"), F.greatest(chunk, "other")), "doc")
        deeper = many.where(F.col("starred") & (F.col("level") < POSITIONS - TREES))
        spot = [TREES + F.pmod(F.xxhash64("node", F.lit(b)), F.lit(POSITIONS - TREES)) for b in range(BRANCHES)]
        picks = F.array_distinct(F.array(*spot))
        signed = deeper.select("node", "doc", "level", F.explode(picks).alias("at")).join(self.sigs, "doc")
        children = signed.select(
            F.xxhash64("node", "at", F.element_at("sig", (F.col("at") + 1).cast("int"))).alias("node"), "doc",
            (F.col("level") + 1).alias("level"), F.lit(False).alias("starred"))
        grown = self.nodes(children, "nodes")
        small = grown.where(F.col("n") <= LEAF).select(F.col("node").alias("task"), "doc")
        self.compare(scratch.table(inner.union(outer).union(stars).union(blocks).union(small), "tasks"))
        columns = ["node", "doc", "n", "level", "starred"]
        again = unstarred.withColumn("starred", F.lit(True)).select(*columns)
        left = scratch.table(again.union(grown.where(F.col("n") > LEAF).select(*columns)), "large")
        scratch.drop(big, rows, grown)
        return left


def _classes(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id and keys of every row; classes: keys, doc, rep and comp, the least vertex of
    the texts linked with it)."""
    rows = columns_of(docs, "doc_id", "text")
    sketched = scratch.table(sketches(rows, width), "sketches")
    # rows of equal keys have equal signatures
    grouped = sketched.where("n_shingles > 0").groupBy(*KEYS).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    grouped = scratch.table(grouped.withColumn("doc", F.monotonically_increasing_id()), "classes")
    classes, sigs = grouped.select("doc", "rep", *KEYS), grouped.select("doc", "sig")
    members = scratch.table(sketched.select("doc_id", *KEYS), "members")
    scratch.drop(sketched)  # the signatures that are needed are in a table of their own
    repeated = members.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    forest = Forest(rows, classes, sigs, IdBits(repeated, "doc_id", scratch), width, percent, scratch)
    forest.grow(range(FIRST_TREES))
    forest.grow(range(FIRST_TREES, TREES))
    return members, scratch.table(forest.with_comp(classes), "solved")


def _labels(classes: DataFrame) -> DataFrame:
    """Per component the smallest doc_id of its rows."""
    return classes.groupBy("comp").agg(F.min("rep").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    scratch = Scratch(docs.sparkSession, "neardup")
    members, classes = _classes(docs, width, percent, scratch)
    held = members.join(classes.select(*KEYS, "comp"), KEYS)
    apart = held.where("doc_id is not null").groupBy("doc_id").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    apart = scratch.table(apart.where("least <> most").select("doc_id", "least"), "apart")
    if not apart.isEmpty():  # ids whose rows hold different texts link these texts
        edges = held.join(apart, "doc_id").select(F.col("comp").alias("a"), F.col("least").alias("b"))
        joined = scratch.table(components(edges, scratch), "joined").withColumnRenamed("vertex", "comp")
        classes = classes.join(joined, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
    solved = classes.join(_labels(classes), "comp").select(*KEYS, "label")
    component = F.coalesce("label", F.when(F.col("n_shingles") == 0, F.col("doc_id")))
    return members.join(solved, KEYS, "left").select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs`` (all columns), one row of each group of linked texts. A row without
    an id cannot be told from its copies by name and stays; empty texts stay, once per id."""
    scratch = Scratch(docs.sparkSession, "neardup")
    members, classes = _classes(docs, width, percent, scratch)
    solved = classes.join(_labels(classes), "comp").select(*KEYS, "label")
    kept = F.coalesce(F.col("doc_id") == F.col("label"), F.col("n_shingles") == 0)
    found = scratch.table(members.where("doc_id is not null").join(solved, KEYS, "left")
                          .select("doc_id", *KEYS, kept.alias("kept")), "components")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    # most rows are kept and single; only texts of dropped or repeated ids are shuffled
    doubtful = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept"))
    rows = IdBits(doubtful.where("n > 1 or not kept"), "doc_id", scratch).mark(docs.toDF(*names), at, "doubtful")
    clear = rows.where(~F.col("doubtful")).select(*names)
    others = with_keys(rows.where("doubtful").select(*names), text, width)
    wanted = found.where("kept").select(F.col("doc_id").alias(at), *KEYS).distinct()
    others = others.join(wanted, [at, *KEYS], "left_semi").dropDuplicates([at, *KEYS]).select(*names)
    return clear.union(others).toDF(*docs.columns)

"""Ranked lexical search: sharded inverted index with block maxima, Block-Max MaxScore.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters; only A-Z are
lower-cased. They are kept as 64-bit hashes. Documents are dealt to shards of bounded text size.
A shard orders its documents by length and holds, per term, blocks of postings (delta-coded
places and counts, as variable-length bytes) with each block's bounds: its places, the largest
count and, as lengths ascend, the length of its first document. These bound the score of every
posting in the block for any corpus statistics, so the index is built in one pass.

Search, per shard and query: lists are added by falling upper bound until the lists left cannot
lift a new document into the result (the essential part); for the others, the maxima of the blocks
in which a candidate would stand reject it before any of their bytes are decoded. A file has a few
shards only; search tasks get the files' names and read a shard at a time, so neither writer, reader
nor task holds more, however large the index is. A task carries its best rows from shard to shard;
the tasks' rows are merged by a window, and their number depends on the cores, not on the index. Scores are integers and
exact; documents whose bound equals the threshold are kept, so ties come out by ascending doc_id.

Queries go through the driver in blocks of bounded size, each block against all shards. Nulls: a
null text has no terms, neither found nor asked. A null doc_id ranks behind other equal scores;
each row of either table counts for itself, repeated ids or not. Empty tables give no rows. A very
long text is scanned in pieces cut between terms. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm import wordhash as wh
from parcelwise.llm.common import columns_of, frees_memory
from parcelwise.sources.scratch import Scratch

SHARD_BYTES = 8_000_000
#: Shards of an index file at most (Parquet's writer looks at its memory every hundred rows only, and
#: Spark's reader decodes up to thousands of a file's rows together), and search tasks a core.
SHARDS_A_FILE, TASKS_A_CORE = 4, 4
BLOCK = 64
TOP = 50
#: Terms of the queries that are held at a time; a block has at least one query.
QUERY_TERMS = 100_000

_NO_TERM = np.ones(256, dtype=bool)
_NO_TERM[0x30:0x3A] = _NO_TERM[0x41:0x5B] = _NO_TERM[0x61:0x7B] = _NO_TERM[0x80:] = False
INDEX = ("shard long, n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<long>, "
         "df array<int>, first_block array<int>, block_first array<int>, block_last array<int>, "
         "block_tf array<int>, block_at array<int>, data binary")


# ---- variable-length bytes ------------------------------------------------------------------

def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low bits first, the high bit on all but the last; and each value's start."""
    size = np.ones(len(values), dtype=np.int64)
    for shift in range(7, 63, 7):
        more = values >= (1 << shift)
        if not more.any():
            break
        size += more
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = ((values[at] >> (7 * k)) & 0x7F) | np.where(size[at] > k + 1, 0x80, 0)
    return out, start


def decode(raw: np.ndarray) -> np.ndarray:
    last = (raw & 0x80) == 0
    start = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * place), start)


# ---- building -------------------------------------------------------------------------------

def summed(term: np.ndarray, doc: np.ndarray, count: np.ndarray):
    """Rows ordered by (term, doc), the counts of equal pairs added."""
    order = np.lexsort((doc, term))
    term, doc, count = term[order], doc[order], count[order]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return term[first], doc[first], np.add.reduceat(count, first) if len(first) else count


def scan_terms(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(term, text number, count) of the texts, piece by piece."""
    for a, b in wh.pieces(raw, offsets, _NO_TERM):
        inner = offsets[np.searchsorted(offsets, a, side="right"):np.searchsorted(offsets, b)]
        cuts = np.concatenate([[a], inner, [b]]) - a
        part = raw[a:b]
        start, end, _ = wh.word_bounds(part, cuts, _NO_TERM)
        if len(start):
            doc = np.searchsorted(offsets, start + a, side="right") - 1
            hashes = wh.word_hashes(part, start, end, lower=True)
            yield summed(hashes, doc, np.ones(len(doc), dtype=np.int64))


class _Shard:
    """Postings of the documents gathered so far."""

    def __init__(self):
        self.bytes, self.ids, self.parts, self.docs = 0, [], [], 0

    def add(self, ids: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> None:
        for term, doc, count in scan_terms(raw, offsets):
            self.parts.append((term, (doc + self.docs).astype(np.int32), count.astype(np.int32)))
        self.ids.append(ids)
        self.docs += len(ids)
        self.bytes += len(raw) + 16 * len(ids)

    def batch(self, number: int) -> pa.RecordBatch:
        term, doc, count = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        length = np.zeros(self.docs, dtype=np.int64)
        np.add.at(length, doc, count)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        place = np.zeros(self.docs, dtype=np.int32)
        place[order] = np.arange(len(order))
        term, at, tf = summed(term, place[doc], count)
        at, tf = at.astype(np.int64), tf.astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(heads, len(term)))
        inside = np.arange(len(term)) - np.repeat(heads, df)
        block = np.flatnonzero(inside % BLOCK == 0)
        block_end = np.append(block[1:], len(term)) - 1
        delta = np.diff(at, prepend=0)
        delta[block] = at[block]
        pairs = np.empty(2 * len(term), dtype=np.int64)
        pairs[0::2], pairs[1::2] = delta, tf - 1
        data, starts = encode(pairs)
        lists = {
            "doc_ids": pa.concat_arrays(self.ids).take(pa.array(order)),
            "lengths": pa.array(length[order]), "terms": pa.array(term[heads].view(np.int64)),
            "df": pa.array(df.astype(np.int32)),
            "first_block": pa.array(np.searchsorted(block, heads).astype(np.int32)),
            "block_first": pa.array(at[block].astype(np.int32)), "block_last": pa.array(at[block_end].astype(np.int32)),
            "block_tf": pa.array(np.maximum.reduceat(tf, block).astype(np.int32)),
            "block_at": pa.array(starts[2 * block].astype(np.int32)),
        }
        columns = [pa.array([number]), pa.array([len(order)]), pa.array([int(length.sum())])]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values()]
        columns.append(pa.array([data.tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["shard", "n_docs", "n_terms", *lists, "data"])


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: documents, lengths, terms, block bounds and the blocks' bytes."""
    @frees_memory
    def run(batches):
        # the shard's name is its task's partition and its place there: the same after a rerun
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            raw, offsets = wh.text_buffers(batch.column(1))
            for a, b in wh.slices(offsets, shard_bytes):
                shard.add(batch.column(0)[a:b], raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                if shard.parts and shard.bytes >= shard_bytes:
                    yield shard.batch(number)
                    number, shard = number + 1, _Shard()
        if shard.parts:  # texts without a term are in no shard
            yield shard.batch(number)
    return columns_of(docs, "doc_id", "text").mapInArrow(run, INDEX)


# ---- searching ------------------------------------------------------------------------------

def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that depends on the document; it rises with tf, falls with length."""
    if 50 * int(length.max(initial=0)) * n_docs < 2**63:
        share = 50 * length * n_docs // n_terms
    else:
        share = np.array([50 * int(x) * n_docs // n_terms for x in length], dtype=np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + share))


class _Lists:
    """The posting lists of one shard that a block of queries asks for."""

    def __init__(self, row: dict, asked: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.row, self.stats = row, (n_docs, n_terms)
        self.data = np.frombuffer(row["data"], dtype=np.uint8)
        self.at = np.append(row["block_at"], len(self.data))
        first = np.append(row["first_block"], len(row["block_at"]))
        terms = row["terms"].view(np.uint64)
        found = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        self.here = terms[found] == asked
        self.lo, self.hi, self.df = (np.where(self.here, x, 0) for x in (first[found], first[found + 1], row["df"][found]))
        self.weights = weights
        top = _impact(row["block_tf"].astype(np.int64), row["lengths"][row["block_first"]], *self.stats)
        self.top = top
        self.bound = np.zeros(len(asked), dtype=np.int64)
        for i in np.flatnonzero(self.here):
            self.bound[i] = weights[i] * int(top[self.lo[i]:self.hi[i]].max())
        self._whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _decoded(self, i: int, blocks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the given blocks of list ``i``, or of all."""
        lo, hi = int(self.lo[i]), int(self.hi[i])
        if blocks is None:
            blocks, raw = np.arange(lo, hi), self.data[self.at[lo]:self.at[hi]]
        else:
            raw = np.concatenate([self.data[self.at[b]:self.at[b + 1]] for b in blocks])
        count = np.full(len(blocks), BLOCK)
        count[blocks == hi - 1] = self.df[i] - (hi - 1 - lo) * BLOCK
        values = decode(raw)
        delta, tf = values[0::2], values[1::2] + 1
        head = np.cumsum(count) - count
        run = np.cumsum(delta)
        place = run - np.repeat(run[head] - delta[head], count)
        return place, self.weights[i] * _impact(tf, self.row["lengths"][place], *self.stats)

    def whole(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self._whole:
            self._whole[i] = self._decoded(i, None)
        return self._whole[i]

    def block_of(self, i: int, places: np.ndarray) -> np.ndarray:
        """The block of list ``i`` in which each place would stand; -1 where none covers it."""
        lo, hi = int(self.lo[i]), int(self.hi[i])
        block = lo + np.searchsorted(self.row["block_last"][lo:hi], places)
        inside = np.minimum(block, hi - 1)
        return np.where((block < hi) & (self.row["block_first"][inside] <= places), inside, -1)

    def scores(self, i: int, places: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Scores in list ``i`` of the places, of which each has its block (-1: none)."""
        out = np.zeros(len(places), dtype=np.int64)
        needed = np.unique(blocks[blocks >= 0])
        if not len(needed):
            return out
        if i in self._whole or 2 * len(needed) >= self.hi[i] - self.lo[i]:
            at, score = self.whole(i)
        else:
            at, score = self._decoded(i, needed)
        found = np.minimum(np.searchsorted(at, places), len(at) - 1)
        hit = at[found] == places
        out[hit] = score[found[hit]]
        return out


def best_in_shard(lists: _Lists, wanted: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the shard's documents that may be among the ``top`` best, given
    that results below the score ``least`` are of no use."""
    present = wanted[lists.here[wanted] & (lists.bound[wanted] > 0)]
    order = present[np.argsort(-lists.bound[present], kind="stable")]
    rest = lists.bound[order].sum() - np.cumsum(lists.bound[order])  # of the lists after each
    score = np.zeros(len(lists.row["lengths"]), dtype=np.int64)
    touched = np.zeros(len(score), dtype=bool)
    left = lists.bound[order].sum()
    used = 0
    while used < len(order) and left >= max(least, 1):
        place, add = lists.whole(int(order[used]))
        score[place] += add
        touched[place] = True
        left = int(rest[used])
        used += 1
        seen = score[touched]
        if len(seen) >= top:
            least = max(least, int(np.partition(seen, len(seen) - top)[len(seen) - top]))
    places = np.flatnonzero(touched)
    places = places[score[places] + left >= max(least, 1)]
    sums = score[places]
    others = [int(i) for i in order[used:]]
    blocks = [lists.block_of(i, places) for i in others]
    most = [np.where(b >= 0, lists.weights[i] * lists.top[b], 0) for i, b in zip(others, blocks)]
    open_bound = np.sum(most, axis=0) if others else np.zeros(len(places), dtype=np.int64)
    for k, i in enumerate(others):
        keep = sums + open_bound >= max(least, 1)
        if not keep.all():  # rejected by block maxima: nothing is decoded for these
            places, sums, open_bound = places[keep], sums[keep], open_bound[keep]
            blocks, most = [b[keep] for b in blocks], [m[keep] for m in most]
        sums = sums + lists.scores(i, places, blocks[k])
        open_bound = open_bound - most[k]
        if len(sums) >= top:
            least = max(least, int(np.partition(sums, len(sums) - top)[len(sums) - top]))
    keep = sums >= max(least, 1)
    return places[keep], sums[keep]


class _Best:
    """The best rows of one query so far: highest score first, then ascending id, null last."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        null = np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score))[:self.top]
        self.score, self.id, self.null = score[order], ids[order], null[order]
        if len(order) == self.top:
            self.least = max(1, int(self.score[-1]))


def _shard_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            value = batch.column(batch.schema.get_field_index(name))[i]
            if name == "data":
                row[name] = value.as_buffer()
            elif name == "doc_ids":
                row["null"] = value.values.is_null().to_numpy(zero_copy_only=False)
                row[name] = value.values.fill_null(0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(value.type):
                row[name] = value.values.to_numpy(zero_copy_only=False)
        yield row


def _files(index: DataFrame) -> DataFrame:
    """The names of the index's files, dealt to the search tasks."""
    spark = index.sparkSession
    files = sorted(index.inputFiles())
    tasks = max(1, min(len(files), TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)


def _shards(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The index rows of the named files, one at a time."""
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as file:
                yield from pq.ParquetFile(file).iter_batches(1, columns=columns, use_threads=False)


def _search_block(files: DataFrame, block: list, stats: tuple[int, int], top: int) -> DataFrame:
    """item_no, doc_id, score: at least the ``top`` best rows of every query of the block."""
    asked = np.unique(np.concatenate([terms for _, terms in block])).astype(np.uint64)

    @frees_memory
    def count(batches):
        total = np.zeros(len(asked), dtype=np.int64)
        for batch in _shards(batches, ["terms", "df"]):
            ends = batch.column(0).offsets.to_numpy()
            for i in range(batch.num_rows):
                terms = batch.column(0).values[ends[i]:ends[i + 1]].to_numpy(zero_copy_only=False).view(np.uint64)
                if len(terms):
                    found = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
                    hit = terms[found] == asked
                    counts = batch.column(1).values[ends[i]:ends[i + 1]].to_numpy(zero_copy_only=False)
                    total[hit] += counts[found[hit]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term_no", "df"])
    df = np.zeros(len(asked), dtype=np.int64)
    for r in files.mapInArrow(count, "term_no long, df long").groupBy("term_no").agg(
            F.sum("df").alias("df")).collect():  # at most one row per asked term of the block
        df[r["term_no"]] = r["df"]
    weights = np.array([_weight(stats[0], int(x)) if x else 0 for x in df], dtype=np.int64)
    queries = [(no, np.searchsorted(asked, terms)) for no, terms in block]

    @frees_memory
    def search(batches):
        best = [_Best(top) for _ in queries]
        for batch in _shards(batches, columns):
            for row in _shard_rows(batch):
                lists = _Lists(row, asked, weights, *stats)
                for (_, wanted), found in zip(queries, best):
                    places, score = best_in_shard(lists, wanted, found.least, top)
                    if len(places):
                        found.add(score, row["doc_ids"][places], row["null"][places])
        for (no, _), found in zip(queries, best):
            if len(found.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found.score), no)), pa.array(found.id, mask=found.null),
                     pa.array(found.score)], names=["item_no", "doc_id", "score"])
    columns = ["doc_ids", "lengths", "terms", "df", "first_block", "block_first", "block_last", "block_tf",
               "block_at", "data"]
    return files.mapInArrow(search, "item_no long, doc_id long, score long")


def _query_terms(queries: DataFrame) -> DataFrame:
    """item_id and its distinct term hashes; texts without a term are left out."""
    @frees_memory
    def run(batches):
        for batch in batches:
            raw, offsets = wh.text_buffers(batch.column(1))
            parts = list(scan_terms(raw, offsets))
            if parts:
                term, doc, _ = (np.concatenate(x) for x in zip(*parts))
                doc, term = _pairs(doc, term)
                rows, first = np.unique(doc, return_index=True)
                ends = pa.array(np.append(first, len(doc)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(term.view(np.int64)))],
                    names=["item_id", "terms"])
    return columns_of(queries, "item_id", "text").mapInArrow(run, "item_id long, terms array<long>")


def _pairs(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, term), ordered."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


def search(index: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``top`` best documents of every query.

    ``index``: a written table of ``build_index``. Queries are read in blocks of at most
    ``QUERY_TERMS`` terms (or one query); each block is searched in all shards.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "lexical")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    files, found = _files(index), []

    def run(block):
        numbers = spark.createDataFrame([(no, item) for no, item, _ in block], "item_no long, item_id long")
        rows = _search_block(files, [(no, terms) for no, _, terms in block], (n_docs, n_terms), top)
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found.append(scratch.table(rows.join(F.broadcast(numbers), "item_no").select(
            "item_id", "rank", "doc_id", "score"), "found"))
    block, size = [], 0
    if n_terms:
        for no, row in enumerate(scratch.table(_query_terms(queries), "queries").toLocalIterator()):
            if block and size + len(row["terms"]) > QUERY_TERMS:
                run(block)
                block, size = [], 0
            block.append((no, row["item_id"], np.array(row["terms"], dtype=np.int64).view(np.uint64)))
            size += len(row["terms"])
    if block:
        run(block)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """Index ``docs`` in the shared folder and search it."""
    scratch = Scratch(docs.sparkSession, "lexical_index")
    return search(scratch.blocks(build_index(docs), "index", SHARDS_A_FILE), queries, top)

"""Lines of whole texts: normalised line hashes, and how many documents of a host hold each.

A line is a piece of the text between line feeds that holds a word. Its normal form is its
words, A-Z lower-cased, joined by one space; lines are equal if their normal forms are.
Documents with equal texts (in one host) are counted once: copies are not boilerplate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import wordhash as wh
from parcelwise.llm.common import frees_memory

_Q = np.uint64(0xD6E8FEB86659FD93)
_Q_INVERSE = np.uint64(pow(int(_Q), -1, 1 << 64))


def host_key(source: Column) -> Column:
    """A non-null key of a host; null is a host of its own."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run values[first:last]; equal runs have equal hashes."""
    n = len(values)
    up, down = np.full(n + 1, _Q), np.full(n + 1, _Q_INVERSE)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return wh.mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


class Scan:
    """Words and lines of a slice of texts. Lines without a word are left out."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        self.start, self.end, self.first = wh.word_bounds(raw, offsets)
        breaks = np.flatnonzero(raw == 10) + 1
        opens = np.concatenate([offsets[:-1], breaks])
        doc = np.concatenate([np.arange(len(offsets) - 1),
                              np.searchsorted(offsets, breaks - 1, side="right") - 1])
        order = np.lexsort((doc, opens))
        opens, doc = opens[order], doc[order]
        closes = np.append(opens[1:], len(raw))
        first = np.searchsorted(self.start, opens)
        last = np.searchsorted(self.start, closes)
        full = last > first
        self.line_doc, self.line_first, self.line_last = doc[full], first[full], last[full]
        self.line_open, closes = opens[full], closes[full]
        ended = (closes > 0) & (closes <= len(raw)) & (closes > self.line_open)
        ended &= raw[np.maximum(closes - 1, 0)] == 10
        self.line_close = closes - ended

    def normal_hashes(self) -> np.ndarray:
        return run_hashes(wh.word_hashes(self.raw, self.start, self.end, lower=True),
                          self.line_first, self.line_last)

    def raw_hashes(self) -> np.ndarray:
        return wh.word_hashes(self.raw, self.line_open, self.line_close)


def in_document(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A key that is equal for equal hashes in one document only."""
    return wh.mix(hashes + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _distinct_lines(batch: pa.RecordBatch):
    """doc_id, host, text (hash), lines (distinct normal hashes) of a batch."""
    raw, offsets = wh.text_buffers(batch.column(2))
    for a, b in wh.slices(offsets):
        off = offsets[a:b + 1]
        scan = Scan(raw[off[0]:off[-1]], off - off[0])
        normal = scan.normal_hashes()
        _, once = np.unique(in_document(scan.line_doc, normal), return_index=True)
        once.sort()
        per_doc = np.bincount(scan.line_doc[once], minlength=b - a)
        ends = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
        lines = pa.ListArray.from_arrays(pa.array(ends), pa.array(normal[once].view(np.int64)))
        rel = off - off[0]
        text = wh.word_hashes(scan.raw, rel[:-1], rel[1:])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(text.view(np.int64)), lines],
            names=["doc_id", "host", "text", "lines"])


def frequent_lines(rows: DataFrame, share: float, min_docs: int, scratch, limit: int | None = None) -> DataFrame:
    """Per host an array of (line, first_doc): lines in more than ``min_docs`` documents and
    more than ``share`` of the host's documents or, if there is one, more than ``limit``
    documents. ``rows``: doc_id, host, text."""
    @frees_memory
    def run(batches):
        for batch in batches:
            yield from _distinct_lines(batch)
    seen = rows.select("doc_id", "host", "text").mapInArrow(
        run, "doc_id long, host string, text long, lines array<long>")
    seen = scratch.table(seen, "lines")
    hosts = seen.select("host", "text").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    each = seen.select("host", "text", "doc_id", F.explode("lines").alias("line"))
    each = each.groupBy("host", "line", "text").agg(F.min("doc_id").alias("doc_id"))
    counted = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
    most = F.col("host_docs") * F.lit(float(share))
    if limit is not None:
        most = F.least(most, F.lit(float(limit)))
    over = counted.where(F.col("docs") > min_docs).join(hosts, "host").where(F.col("docs") > most)
    flagged = over.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("line", "first_doc"))).alias("flagged"))
    out = scratch.table(flagged, "frequent_lines")
    scratch.drop(seen)
    return out


def flagged_mask(scan: Scan, normal: np.ndarray, flagged: pa.Array, doc_ids: pa.Array,
                 keep_first: bool) -> np.ndarray:
    """Which lines of the slice are flagged for their document's host."""
    mask = np.zeros(len(normal), dtype=bool)
    if not len(normal):
        return mask
    last_key, table = None, None
    bounds = np.searchsorted(scan.line_doc, np.arange(len(doc_ids) + 1))
    starts = flagged.offsets.to_numpy() if len(flagged) else np.zeros(1, int)
    lines = flagged.values.field("line").to_numpy(zero_copy_only=False)
    firsts = flagged.values.field("first_doc")
    firsts = firsts.fill_null(-2**63).to_numpy(zero_copy_only=False) if len(firsts) else np.zeros(0, int)
    valid = flagged.is_valid().to_numpy(zero_copy_only=False)
    ids = doc_ids.fill_null(-2**63).to_numpy(zero_copy_only=False)
    real = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    signed = normal.view(np.int64)
    for i in range(len(doc_ids)):
        a, b = bounds[i], bounds[i + 1]
        if a == b or not valid[i]:
            continue
        lo, hi = starts[i], starts[i + 1]
        table = lines[lo:hi]
        at = np.minimum(np.searchsorted(table, signed[a:b]), hi - lo - 1)
        hit = table[at] == signed[a:b]
        if keep_first and real[i]:
            hit &= firsts[lo:hi][at] != ids[i]
        mask[a:b] = hit
    return mask


def without_lines(scan: Scan, drop: np.ndarray, doc: int) -> str:
    """The text of document ``doc`` of the slice without its dropped lines."""
    text = scan.raw[scan.offsets[doc]:scan.offsets[doc + 1]].tobytes().decode("utf-8")
    a, b = np.searchsorted(scan.line_doc, [doc, doc + 1])
    gone = {int(x) for x in scan.line_open[a:b][drop[a:b]] - scan.offsets[doc]}
    if not gone:
        return text
    kept, at = [], 0
    for line in text.split("\n"):
        if at not in gone:
            kept.append(line)
        at += len(line.encode("utf-8")) + 1
    return "\n".join(kept)

"""Quality rules with cross-document line frequency.

Lines are hashed in normal form and counted per host (``source``) over distinct documents.
A line in more than ``min_docs`` documents and more than ``share`` of its host's documents or more
than ``limit`` of them (a hot host's lines are judged by this number) is removed from all but the host's first document (smallest doc_id) with it. A document is
rejected if it fails the base rules (under 20 words, or over 30 % of its words in 8-word
windows found twice or more), or if it is depleted: under ``left`` of its words remain after
the removal.

Defined cases: null text is a text without words (rejected by the base rules); a null host
is a host of its own; a document with a null doc_id is never a line's first; rows that
repeat a doc_id are documents of their own, equal texts of a host count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import wordhash as wh
from parcelwise.llm.common import columns_of, frees_memory
from parcelwise.llm.lines import Scan, flagged_mask, frequent_lines, host_key, in_document, without_lines
from parcelwise.sources.scratch import Scratch

SHARE, MIN_DOCS, LIMIT, LEFT = 0.05, 2, 1000, 0.3
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(scan: Scan) -> np.ndarray:
    """Words per document inside a window of 8 words that the document has twice or more."""
    words = wh.word_hashes(scan.raw, scan.start, scan.end)
    n, docs = len(words), len(scan.offsets) - 1
    runs = wh.windows(words, WINDOW)
    doc = np.repeat(np.arange(docs), np.diff(scan.first))
    inside = np.flatnonzero(doc[:len(runs)] == doc[WINDOW - 1:]) if len(runs) else np.zeros(0, int)
    keys = in_document(doc[inside], runs[inside])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, inside[twice], 1)
    np.add.at(step, inside[twice] + WINDOW, -1)
    return _sums(np.cumsum(step[:n]) > 0, scan.first)


def _judge(batch: pa.RecordBatch, left: float, with_text: bool):
    """Input doc_id, text, flagged; output the counts and the verdict of each document."""
    raw, offsets = wh.text_buffers(batch.column(1))
    for a, b in wh.slices(offsets):
        off = offsets[a:b + 1]
        scan = Scan(raw[off[0]:off[-1]], off - off[0])
        docs = b - a
        n_words = np.diff(scan.first)
        inside = np.zeros(len(scan.raw) + 1, dtype=np.int64)
        np.add.at(inside, scan.start, 1)
        np.add.at(inside, scan.end, -1)
        chars = (np.cumsum(inside[:-1]) > 0) & ((scan.raw & 0xC0) != 0x80)
        lines = np.bincount(scan.line_doc, minlength=docs)
        keys = in_document(scan.line_doc, scan.raw_hashes())
        _, once = np.unique(keys, return_index=True)
        distinct = np.bincount(scan.line_doc[once], minlength=docs)
        repeat = repeated_words(scan)
        ids = batch.column(0)[a:b]
        drop = flagged_mask(scan, scan.normal_hashes(), batch.column(2)[a:b], ids, True)
        removed = np.bincount(scan.line_doc, minlength=docs,
                              weights=(scan.line_last - scan.line_first) * drop).astype(np.int64)
        failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
        kept = ~failed & ~((removed > 0) & (n_words - removed < left * n_words))
        columns = [ids, pa.array(n_words), pa.array(_sums(chars, scan.offsets)),
                   pa.array(_sums(_SYMBOL[scan.raw], scan.offsets)), pa.array(lines - distinct),
                   pa.array(repeat), pa.array(failed), pa.array(kept), pa.array(removed)]
        if with_text:
            columns.append(pa.array([without_lines(scan, drop, i) for i in range(docs)], pa.string()))
            columns.extend(batch.column(i)[a:b] for i in range(3, batch.num_columns))
        yield columns


COUNTS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, removed_words long")


def _flagged(docs: DataFrame, share: float, min_docs: int, limit: int | None, extra: list[str]) -> DataFrame:
    """doc_id, text, flagged lines of the host, and further columns."""
    scratch = Scratch(docs.sparkSession, "line_quality")
    rows = columns_of(docs, "doc_id", "source", "text", *extra)
    keyed = rows.withColumn("host", host_key(F.col("source")))
    flagged = frequent_lines(keyed.select("doc_id", "host", "text"), share, min_docs, scratch, limit)
    return keyed.join(flagged, "host", "left").select("doc_id", "text", "flagged", "source", *extra)


def quality(docs: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS, left: float = LEFT,
            limit: int | None = LIMIT) -> DataFrame:
    """Counts and verdict of every document."""
    names = [part.split()[0] for part in COUNTS.split(", ")]

    @frees_memory
    def run(batches):
        for batch in batches:
            for columns in _judge(batch, left, False):
                yield pa.RecordBatch.from_arrays(columns, names=names)
    rows = _flagged(docs, share, min_docs, limit, []).select("doc_id", "text", "flagged")
    return rows.mapInArrow(run, COUNTS)


def keep_good(docs: DataFrame, share: float = SHARE, min_docs: int = MIN_DOCS, left: float = LEFT,
              limit: int | None = LIMIT) -> DataFrame:
    """The kept documents, their frequent lines removed (columns of ``documents``)."""
    names = ["doc_id", "text", "source", "lang"]

    @frees_memory
    def run(batches):
        for batch in batches:
            for columns in _judge(batch, left, True):
                kept = columns[7]
                yield pa.RecordBatch.from_arrays(
                    [x.filter(kept) for x in (columns[0], columns[9], columns[10], columns[11])], names=names)
    rows = _flagged(docs, share, min_docs, limit, ["lang"])
    out = rows.mapInArrow(run, "doc_id long, text string, source string, lang string")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))

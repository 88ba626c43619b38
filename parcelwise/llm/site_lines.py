"""Line dedup by site-relative frequency.

Documents are grouped by host (``source``). The documents that hold a line are divided by the
host's documents; a line above ``ratio`` (and in more than ``min_docs`` documents, as one shared
line is above any ratio on a host of two) is dropped from every document
of the host but the first with it, so that its text survives once.

Lines are compared in normal form (see ``lines``); equal texts of a host count as one
document in both numbers. Defined cases: null text is empty and stays null; a null host is a
host of its own; a document with a null doc_id is never a line's first; other columns,
whatever their names, are kept; lines without a word are never dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import wordhash as wh
from parcelwise.llm.common import frees_memory
from parcelwise.llm.lines import Scan, flagged_mask, frequent_lines, host_key, without_lines
from parcelwise.sources.scratch import Scratch

RATIO, MIN_DOCS = 0.02, 2


def _clean(batch: pa.RecordBatch):
    """Input doc_id, text, flagged; yields (a, b, new text, lines, dropped lines)."""
    import numpy as np
    raw, offsets = wh.text_buffers(batch.column(1))
    for a, b in wh.slices(offsets):
        off = offsets[a:b + 1]
        scan = Scan(raw[off[0]:off[-1]], off - off[0])
        texts, ids = batch.column(1)[a:b], batch.column(0)[a:b]
        drop = flagged_mask(scan, scan.normal_hashes(), batch.column(2)[a:b], ids, True)
        lines = np.bincount(scan.line_doc, minlength=b - a)
        dropped = np.bincount(scan.line_doc, minlength=b - a, weights=drop).astype(np.int64)
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        new = pa.array([without_lines(scan, drop, i) if dropped[i] else (texts[i].as_py() if valid[i] else None)
                        for i in range(b - a)], pa.string())
        yield a, b, new, pa.array(lines), pa.array(dropped)


def drop_site_lines(docs: DataFrame, ratio: float = RATIO, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the host's boilerplate lines dropped from ``text``, plus ``n_lines`` and
    ``n_dropped_lines`` as its last two columns."""
    scratch = Scratch(docs.sparkSession, "site_lines")
    at = {c: docs.columns.index(c) for c in ("doc_id", "text", "source")}
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).select(
        F.col(f"c{at['doc_id']}").alias("doc_id"), F.col(f"c{at['text']}").alias("text"),
        host_key(F.col(f"c{at['source']}")).alias("host"), *[n for i, n in enumerate(names) if i != at["text"]])
    flagged = frequent_lines(rows.select("doc_id", "host", "text"), ratio, min_docs, scratch)
    rest = [n for i, n in enumerate(names) if i != at["text"]]
    joined = rows.join(flagged, "host", "left").select("doc_id", "text", "flagged", *rest)
    kinds = {n: f.dataType.simpleString() for n, f in zip(names, docs.schema.fields, strict=True)}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in rest), "new_text string", "n_lines long", "n_dropped long"])

    @frees_memory
    def run(batches):
        for batch in batches:
            for a, b, text, lines, dropped in _clean(batch):
                kept = [batch.column(i)[a:b] for i in range(3, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, text, lines, dropped],
                                                 names=[*rest, "new_text", "n_lines", "n_dropped"])
    out = joined.mapInArrow(run, schema)
    order = [F.col("new_text") if i == at["text"] else F.col(n) for i, n in enumerate(names)]
    return out.select(*order, "n_lines", "n_dropped").toDF(*docs.columns, "n_lines", "n_dropped_lines")

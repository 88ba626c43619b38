"""Document fingerprints by spot signatures.

Words (A-Z lower-cased, ASCII marks at both ends removed) that are most common over all documents are
anchors. Each anchor in a text, chained with the next ``CHAIN`` content words (no anchors),
is one signature, hashed to 32 bits; the sorted distinct signatures, eight hex digits each,
are the fingerprint. A text without a whole chain has one signature of all its words.

Fingerprints are compared by Jaccard. Sets are partitioned by length: with a threshold t, a
set of length n can only match lengths from t n to n / t, so a partition is compared with
itself and the next; inside, pairs that share no signature among their first
n - ceil(t n) + 1 are pruned, and the rest is intersected exactly (``matches``).

Anchors come from counts of all words of all documents, kept in 65,536 hash buckets so that
the statistic has a fixed size; a rare word in a common word's bucket is an anchor too.

Defined cases: null text is empty; an empty fingerprint equals another empty one (likeness 1)
and differs from all others (0); the order is by doc_id, null first, then by text; one
document is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from parcelwise.llm import wordhash as wh
from parcelwise.llm.common import columns_of
from parcelwise.sources.scratch import Scratch

BUCKETS, ANCHORS, CHAIN = 1 << 16, 48, 2
_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
FIRST = -2**63


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = wh.word_bounds(raw, offsets)
    if len(start):  # a word of marks alone stays as it is
        place = np.arange(len(raw))
        mark = _MARK[raw]
        last = np.maximum.accumulate(np.where(mark, -1, place))[end - 1] + 1
        begin = np.minimum.accumulate(np.where(mark, len(raw), place)[::-1])[::-1][start]
        solid = last > start
        start, end = np.where(solid, begin, start), np.where(solid, last, end)
    return wh.word_hashes(raw, start, end, lower=True), first


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


def common_words(docs: DataFrame, anchors: int = ANCHORS) -> np.ndarray:
    """The anchors as a mask over the buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            raw, offsets = wh.text_buffers(batch.column(0))
            for a, b in wh.slices(offsets):
                off = offsets[a:b + 1]
                words, _ = _words(raw[off[0]:off[-1]], off - off[0])
                counts += np.bincount(_bucket(words), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])
    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    mask = np.zeros(BUCKETS, dtype=bool)
    for row in counted.orderBy(F.desc("n"), "bucket").limit(anchors).collect():
        mask[row["bucket"]] = True
    return mask


def signature_sets(texts: pa.Array, anchor: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text."""
    raw, offsets = wh.text_buffers(texts)
    out: list[np.ndarray] = []
    for a, b in wh.slices(offsets):
        off = offsets[a:b + 1]
        words, first = _words(raw[off[0]:off[-1]], off - off[0])
        spot = anchor[_bucket(words)]
        at, content = np.flatnonzero(spot), np.flatnonzero(~spot)
        nth = np.searchsorted(content, at)
        value, last = words[at], at
        fits = nth + CHAIN <= len(content)
        at, nth, value = at[fits], nth[fits], value[fits]
        for k in range(CHAIN):
            last = content[nth + k]
            value = value * np.uint64(0xD1342543DE82EF95) + words[last]
        doc = np.searchsorted(first, at, side="right") - 1
        whole = last < first[doc + 1] if len(at) else np.zeros(0, dtype=bool)
        value, doc = (wh.mix(value[whole]) >> np.uint64(32)).astype(np.uint32), doc[whole]
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            if bounds[i + 1] > bounds[i]:
                out.append(np.unique(value[bounds[i]:bounds[i + 1]]))
            else:
                mine = words[first[i]:first[i + 1]]
                out.append((wh.windows(mine, len(mine)) >> np.uint64(32)).astype(np.uint32) if len(mine)
                           else np.zeros(0, np.uint32))
    return out


def fingerprint(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    found = np.minimum(np.searchsorted(a, b), len(a) - 1)
    shared = int((a[found] == b).sum())
    return shared / (len(a) + len(b) - shared)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """(run, extra, place, tie, doc_id, text): the documents cut into runs of the order, each
    run followed by the first row of the next (``extra`` 1), the last by the first of all.

    Runs are cut at approximate quantiles of the ids; what the driver and the tasks hold is
    one bound and one first id per run.
    """
    spark = docs.sparkSession
    rows = columns_of(docs, "doc_id", "text").select(
        F.coalesce("doc_id", F.lit(FIRST)).alias("place"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("place", [i / runs for i in range(1, runs)], 20 * runs)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    @pandas_udf("int")
    def run_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(), side="right").astype(np.int32))
    firsts = rows.select("place", run_of("place").alias("run")).groupBy("run").agg(F.min("place").alias("first"))
    begins = sorted((r["first"], r["run"]) for r in firsts.collect())  # one row per run
    before = {first: begins[i - 1][1] for i, (first, _) in enumerate(begins)}

    @pandas_udf("array<int>")
    def targets(place: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, place.to_numpy(), side="right") * 2
        return pd.Series([[int(o), before[p] * 2 + 1] if p in before else [int(o)]
                          for o, p in zip(own, place.tolist(), strict=True)])
    dealt = rows.withColumn("target", F.explode(targets("place")))
    return dealt.select(F.shiftright("target", 1).alias("run"), (F.col("target") % 2).alias("extra"), "place",
                        F.xxhash64("text").alias("tie"), "doc_id", "text")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_signatures long")


def fingerprints(docs: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """Every text's fingerprint, that of its edited text (its last half replaced by the
    beginning of the next document), and the likenesses."""
    spark = docs.sparkSession
    rows = columns_of(docs, "doc_id", "text")
    mask = common_words(rows, anchors)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_order(rows).repartition(parts, "run").sortWithinPartitions("run", "extra", "place", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next one has not come yet
        for batch in batches:
            runs, extra, ids = (batch.column(i).to_pylist() for i in (0, 1, 4))
            texts, sets = batch.column(5).to_pylist(), signature_sets(batch.column(5), mask)
            rows = ([held] if held else []) + list(zip(runs, extra, ids, texts, sets, strict=True))
            held = rows[-1] if rows else None
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
            for at in range(0, len(pairs), 500):
                yield result(pairs[at:at + 500])

    def result(pairs: list[tuple]) -> pa.RecordBatch:
        edited = [_edited(a[3], b[3]) for a, b in pairs]
        changed = signature_sets(pa.array(edited, pa.string()), mask)
        columns = (
            [a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs],
            [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
            [fingerprint(a[4]) for a, _ in pairs], [fingerprint(s) for s in changed],
            [likeness(a[4], s) for (a, _), s in zip(pairs, changed, strict=True)],
            [likeness(a[4], b[4]) for a, b in pairs], [len(a[4]) for a, _ in pairs])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=[p.split()[0] for p in RESULT.split(", ")])
    return dealt.mapInArrow(run, RESULT)


def matches(probes: DataFrame, prints: DataFrame, percent: int = 50) -> DataFrame:
    """(probe_id, doc_id, likeness) of all pairs of a probe and a document (both doc_id and
    fingerprint) with a likeness of at least ``percent`` / 100. Empty fingerprints match none."""
    share = percent / 100
    step = -float(np.log(share)) if share < 1 else 1.0

    def indexed(df: DataFrame, name: str) -> DataFrame:
        marks = F.expr("transform(sequence(0, length(fingerprint) - 8, 8), i -> substring(fingerprint, i + 1, 8))")
        sets = df.where("length(fingerprint) > 0").select(F.col("doc_id").alias(name), marks.alias(f"{name}_set"))
        n = F.size(f"{name}_set")
        sets = sets.withColumn("part", F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int"))
        return sets.withColumn("mark", F.explode(F.slice(f"{name}_set", F.lit(1), n - F.ceil(n * share - 1e-9) + 1)))
    left = indexed(probes, "probe_id").withColumn(
        "part", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)))
    found = left.join(indexed(prints, "doc_id"), ["part", "mark"])
    small, large = (f(F.size("probe_id_set"), F.size("doc_id_set")) for f in (F.least, F.greatest))
    found = found.where(small >= large * share - 1e-9).dropDuplicates(["probe_id", "doc_id"])
    shared = F.size(F.array_intersect("probe_id_set", "doc_id_set"))
    union = F.size("probe_id_set") + F.size("doc_id_set") - shared
    return found.select("probe_id", "doc_id", (shared / union).alias("likeness")).where(
        F.col("likeness") >= share - 1e-9)

"""Quality classifier as a sparse rule ensemble.

Statistics of whole texts (shares of capitals, symbols, repeated words and the like) are the only
inputs. Shallow trees of a random forest are fitted on labelled rows; every path from a root to a
node is a conjunctive rule over the statistics; a lasso logistic regression on the rules' 0/1 values
leaves few of them with a weight. The model is these rules and weights, compiled into one Spark
column expression.

Fitting uses at most ``FIT_ROWS`` labelled rows, drawn by a hash of the doc_id; scoring covers all
documents. Labels are learnt only from rows whose crc32 of the decimal doc_id is not divisible by 5.

Nulls and edge cases: a null or empty text has statistics of 0 and a score like any other; a null
doc_id is neither held out nor labelled; labels that are null or name no document are ignored;
repeated ids are scored row by row and learnt once per matching pair. Without labels of both
classes the score is the smoothed share of 1 among the labelled rows (0.5 without any). An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import wordhash as wh
from parcelwise.llm.common import columns_of
from parcelwise.llm.lexical import summed
from parcelwise.llm.lines import in_document
from parcelwise.sources.scratch import Scratch

FIT_ROWS = 8_000
THRESHOLD = 0.3
TREES, DEPTH, SEED, LASSO = 24, 3, 11, 0.002

_BYTES = np.arange(256)
_IS = {
    "lead": (_BYTES & 0xC0) != 0x80,
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "wide": _BYTES >= 0xC3,
    "symbol": np.isin(_BYTES, list(b"#*$%&|<>@^~=+_\\/{}[]")),
    "mark": np.isin(_BYTES, list(b".,;:!?")),
    "bang": np.isin(_BYTES, list(b"!?")),
    "stop": np.isin(_BYTES, list(b".!?")),
}
_ENDS_PLAIN = _IS["lower"] | _IS["upper"] | _IS["digit"] | (_BYTES >= 0x80) | np.isin(_BYTES, list(b".,;:?)\"'"))
#: The statistics; all but the first are shares, so they do not grow with a text.
STATISTICS = [
    "words", "chars_per_word", "upper_share", "digit_share", "symbol_share", "mark_share", "bang_share",
    "wide_share", "capital_words", "odd_ends", "letterless_words", "distinct_words", "top_word", "same_as_before",
    "distinct_pairs", "lines_per_word", "stops_per_word", "short_words", "long_words",
]


def _per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


class _Counts:
    """Additive counts of the texts of a slice, and their words with repeats."""

    def __init__(self, n: int):
        self.n, self.words, self.pairs = n, [], []
        self.sums = {name: np.zeros(n) for name in (
            *_IS, "latin_upper", "breaks", "words", "capital", "odd", "letterless", "same", "short", "long")}
        self.before = (-1, np.uint64(0))

    def add(self, raw: np.ndarray, cuts: np.ndarray, docs: np.ndarray) -> None:
        """A piece of bytes; ``cuts`` are the bounds of the parts of the texts ``docs`` in it."""
        n, sums = self.n, self.sums
        owner = np.repeat(docs, np.diff(cuts))
        for name, table in _IS.items():
            sums[name] += np.bincount(owner[table[raw]], minlength=n)
        # capitals of Latin-1 are C3 80..9E without the multiplication sign
        two = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        sums["latin_upper"] += np.bincount(owner[:-1][two], minlength=n)
        sums["breaks"] += np.bincount(owner[raw == 10], minlength=n)
        start, end, _ = wh.word_bounds(raw, cuts)
        if not len(start):
            return
        doc = owner[start]

        def inside(flags: np.ndarray) -> np.ndarray:
            run = np.zeros(len(raw) + 1, dtype=np.int32)
            np.cumsum(flags, out=run[1:])
            return run[end] - run[start]
        size = inside(_IS["lead"][raw])
        lower, letters = inside(_IS["lower"][raw]), inside((_IS["lower"] | _IS["upper"] | _IS["wide"])[raw])
        sums["words"] += np.bincount(doc, minlength=n)
        sums["capital"] += _per_text((letters >= 2) & (lower == 0), doc, n)
        sums["odd"] += _per_text(~_ENDS_PLAIN[raw[end - 1]], doc, n)
        sums["letterless"] += _per_text(letters == 0, doc, n)
        sums["short"] += _per_text(size <= 2, doc, n)
        sums["long"] += _per_text(size >= 12, doc, n)
        word = wh.word_hashes(raw, start, end, lower=True)
        before = np.concatenate([[self.before[1]], word[:-1]])
        follows = np.concatenate([[doc[0] == self.before[0]], doc[1:] == doc[:-1]])
        sums["same"] += _per_text(follows & (word == before), doc, n)
        self.before = (doc[-1], word[-1])
        pair = wh.mix(before * np.uint64(0xD1342543DE82EF95) + word)[follows]
        for rows, hashes, owners in ((self.words, word, doc), (self.pairs, pair, doc[follows])):
            rows.append(summed(in_document(owners, hashes), owners, np.ones(len(owners), dtype=np.int64)))

    def _distinct(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of distinct values and the largest count of one."""
        most = np.zeros(self.n)
        if not rows:
            return most, most
        _, doc, count = summed(*[np.concatenate(x) for x in zip(*rows)])
        np.maximum.at(most, doc, count)
        return np.bincount(doc, minlength=self.n), most

    def statistics(self) -> list[np.ndarray]:
        s = self.sums
        words, chars = np.maximum(s["words"], 1), np.maximum(s["lead"], 1)
        distinct, top = self._distinct(self.words)
        pairs, _ = self._distinct(self.pairs)
        return [s["words"], s["lead"] / words, (s["upper"] + s["latin_upper"]) / chars, s["digit"] / chars,
                s["symbol"] / chars, s["mark"] / chars, s["bang"] / chars, s["wide"] / chars, s["capital"] / words,
                s["odd"] / words, s["letterless"] / words, distinct / words, top / words, s["same"] / words,
                pairs / np.maximum(words - 1, 1), s["breaks"] / words, s["stop"] / words, s["short"] / words,
                s["long"] / words]


def _text_statistics(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The statistics of a slice of texts; a text longer than a piece is alone in its slice."""
    counts = _Counts(len(offsets) - 1)
    limit = len(raw) if len(offsets) > 2 else wh.SLICE_BYTES
    for a, b in wh.pieces(raw, offsets, limit=max(limit, 1)):
        first, last = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b)
        cuts = np.clip(offsets[first:last + 1], a, b) - a
        counts.add(raw[a:b], cuts, np.arange(first, last))
    return counts.statistics()


def with_statistics(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but ``text``, and the statistics of the whole text."""
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches):
        for batch in batches:
            raw, offsets = wh.text_buffers(batch.column(0))
            for a, b in wh.slices(offsets):
                found = _text_statistics(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i)[a:b] for i in range(1, batch.num_columns)] + [pa.array(x) for x in found],
                    names=[f.name for f in kept] + STATISTICS)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{s} double" for s in STATISTICS])
    return rows.select("text", *[f.name for f in kept]).mapInArrow(run, schema)


# ---- rules ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it at most?, bound)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        each = [F.col(s) <= F.lit(v) if low else F.col(s) > F.lit(v) for s, low, v in self.parts]
        return reduce(lambda a, b: a & b, each)

    def __str__(self) -> str:
        return " and ".join(f"{s} {'<=' if low else '>'} {v:.6g}" for s, low, v in self.parts)


def _conjunction(path: list[tuple[str, bool, float]]) -> Rule:
    """A path as a rule: per statistic and side only the tightest bound, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, low, value in path:
        known = tight.get((name, low), value)
        tight[name, low] = min(known, value) if low else max(known, value)
    return Rule(tuple(sorted((name, low, value) for (name, low), value in tight.items())))


def tree_rules(forest) -> list[Rule]:
    """All distinct rules of a fitted forest: one per node below a root."""
    found: dict[Rule, None] = {}

    def walk(node, path):
        if path:
            found[_conjunction(path)] = None
        if node.subtreeDepth() > 0:
            split = node.split()
            name, value = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), path + [(name, True, value)])
            walk(node.rightChild(), path + [(name, False, value)])
    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), [])
    return list(found)


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; the score is the logistic of the intercept and the weights of those that hold."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch, bound: int = FIT_ROWS) -> DataFrame:
    """label and statistics of at most ``bound`` labelled rows that are not held out."""
    pairs = columns_of(labels, "doc_id", "quality").where(
        F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    draw = F.md5(F.concat(F.lit(f"{SEED}|"), F.col("doc_id").cast("string")))
    pairs = pairs.withColumn("draw", draw).withColumn("u", F.conv(F.substring("draw", 1, 8), 16, 10).cast("double"))
    total = pairs.count()
    if total > bound:  # a share that leaves a little over the bound, then the bound itself
        pairs = pairs.where(F.col("u") < F.lit(2.0 ** 32 * min(1.0, 1.1 * bound / total + 0.001)))
    drawn = scratch.table(pairs.orderBy("draw", "quality").limit(bound).select("doc_id", "quality"), "drawn")
    rows = columns_of(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most ``bound`` rows
    rows = with_statistics(rows.select("doc_id", F.col("quality").cast("double").alias("label"), "text"))
    ordered = rows.orderBy("doc_id", "label", *STATISTICS).limit(bound)
    return scratch.table(ordered.select("label", *STATISTICS), "fit").coalesce(1)


def fit_rules(rows: DataFrame) -> RuleModel:
    """Trees, their rules and lasso weights. ``rows`` is bounded, in one partition, in fixed order."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = (counts.get(1.0, 0) + 1) / (sum(counts.values()) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features")).persist()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, minInstancesPerNode=5,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.8).fit(vectors)
    vectors.unpersist()
    rules = tree_rules(forest)
    if not rules:
        share = (counts[1.0] + 1) / (sum(counts.values()) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    held = F.array(*[r.column().cast("double") for r in rules])
    binary = rows.select("label", array_to_vector(held).alias("features")).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=100, standardization=False).fit(binary)
    binary.unpersist()
    weights = lasso.coefficients.toArray()
    chosen = tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6)
    return RuleModel(float(lasso.intercept), chosen)


def fit_model(docs: DataFrame, labels: DataFrame) -> RuleModel:
    scratch = Scratch(docs.sparkSession, "rules")
    return fit_rules(fit_rows(docs, labels, scratch))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_model(docs, labels)
    rows = with_statistics(columns_of(docs, "doc_id", "text"))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    out = rows.select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= F.lit(threshold), 1).otherwise(0))

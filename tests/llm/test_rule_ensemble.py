"""The rule ensemble: statistics against a plain version, rules, held-out quality, edge rows."""

import math
import re
import zlib

import numpy as np
import pytest

from parcelwise.llm import rule_ensemble as ensemble
from parcelwise.llm.common import documents as read_documents
from parcelwise.llm.common import table
from tests.llm.data import WORD, documents, edge_documents, prose, with_clashes

SF = "/root/testdata/sf0.1"


def _plain(text):
    text = text or ""
    words = WORD.findall(text)
    n, chars = max(len(words), 1), max(len(text), 1)
    lower = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
    pairs = list(zip(lower, lower[1:]))
    count = lambda chosen: sum(c in chosen for c in text)
    upper = sum("A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") for c in text)
    wide = sum(ord(c) >= 0xC0 for c in text)
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) >= 0xC0
    plain_end = lambda c: c.isascii() and c.isalnum() or ord(c) >= 0x80 or c in ".,;:?)\"'"
    return [len(words), len(text) / n, upper / chars, count("0123456789") / chars,
            count("#*$%&|<>@^~=+_\\/{}[]") / chars, count(".,;:!?") / chars, count("!?") / chars, wide / chars,
            sum(sum(map(letter, w)) >= 2 and not re.search("[a-z]", w) for w in words) / n,
            sum(not plain_end(w[-1]) for w in words) / n, sum(not any(map(letter, w)) for w in words) / n,
            len(set(lower)) / n, max((lower.count(w) for w in set(lower)), default=0) / n,
            sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(n - 1, 1), text.count("\n") / n,
            count(".!?") / n, sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 12 for w in words) / n]


@pytest.mark.parametrize("limit", [2_000_000, 500])
def test_statistics(spark, monkeypatch, limit):
    """Whole texts, also when a text is scanned in many pieces."""
    texts = [None, "", "One", "É×ÀB ab. !!", " \n\t ", "a a a b\nb", "x\x0by 12#", prose(5, 400), "W### " * 300 + "é ÑO",
             "z" * 1500 + " end", "### !! | 12"]
    monkeypatch.setattr(ensemble.wh, "SLICE_BYTES", limit)
    data = [(t or "").encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    for a, b in ensemble.wh.slices(offsets, limit):
        found = ensemble._text_statistics(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        for i, text in enumerate(texts[a:b]):
            assert [x[i] for x in found] == pytest.approx(_plain(text)), text


def test_rules_are_tight_conjunctions():
    rule = ensemble._conjunction([("words", True, 9.0), ("words", True, 4.0), ("top_word", False, 0.5)])
    assert str(rule) == "top_word > 0.5 and words <= 4"


def test_compiled_score_equals_the_weights(spark):
    rules = ((ensemble.Rule((("words", True, 3.0),)), 1.5), (ensemble.Rule((("words", False, 1.0), ("top_word", True, 0.6))), -0.7))
    model = ensemble.RuleModel(0.2, rules)
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 0.5), (9.0, 0.1)], "words double, top_word double")
    got = [r[0] for r in rows.select(model.score()).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-x)) for x in (0.2 + 1.5, 0.2 + 1.5 - 0.7, 0.2 - 0.7)])


def test_held_out_quality(spark):
    rows = ensemble.quality_scores(read_documents(spark, SF), table(spark, SF, "labels")).collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert len(rows) == len({r["doc_id"] for r in rows}) == 10_000
    held = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in labels:
            held.append((r["score"], r["predicted"], labels[r["doc_id"]]))
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.99 and np.mean([p == y for _, p, y in held]) > 0.98


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs = [(i, prose(i, 40) if i % 2 else "W### " * 30, "en", "s", 1) for i in range(300)]
    labels = [(i, i % 2) for i in range(300)]
    lies = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    frame = documents(spark, docs)
    one, other = (ensemble.fit_model(frame, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, lies))
    assert one == other and one.rules


def test_edge_rows(spark):
    frame = with_clashes(documents(spark))
    schema = "doc_id long, quality int, toxic int"
    labels = [(1, 1, 0), (None, 0, 0), (2, None, 0), (77, 0, 0), (3, 5, 0)]
    rows = ensemble.quality_scores(frame, with_clashes(spark.createDataFrame(labels, schema))).collect()
    assert len(rows) == len(edge_documents()) and {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    learnt = zlib.crc32(b"1") % 5 != 0
    assert {round(r["score"], 9) for r in rows} == {round(2 / 3 if learnt else 0.5, 9)}
    none = ensemble.quality_scores(frame, spark.createDataFrame([], schema)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert ensemble.quality_scores(documents(spark, []), spark.createDataFrame(labels, schema)).count() == 0
    both = [(1, 1, 0), (2, 0, 0), (6, 1, 0), (7, 0, 0), (8, 0, 0), (9, 1, 0)]
    rows = ensemble.quality_scores(frame, spark.createDataFrame(both, schema)).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)

"""Near-dedup where rows repeat an id with other texts, or have none; recall on the given documents."""

import random

from parcelwise.llm import neardup
from parcelwise.llm.common import columns_of
from parcelwise.llm.common import documents as read_documents
from tests.llm.data import documents, prose, with_clashes
from tests.llm.test_brute_force import _links

SF = "/root/testdata/sf0.01"


def _near(text, seed):
    words = text.split(" ")
    words[random.Random(seed).randrange(len(words))] = "changed"
    return " ".join(words)


A, B, C = prose(1, 80), prose(2, 80), prose(3, 80)


def _found(spark, rows):
    frame = with_clashes(documents(spark, [(i, t, "en", "s", 1) for i, t in rows]))
    found = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame, 3, 85).collect()]
    kept = [(r["doc_id"], r["text"]) for r in columns_of(neardup.keep_one(frame, 3, 85), "doc_id", "text").collect()]
    return sorted(found, key=str), sorted(kept, key=str)


def test_an_id_with_two_texts(spark):
    rows = [(1, A), (1, B), (2, _near(A, 1)), (3, _near(B, 2)), (4, C)]
    found, kept = _found(spark, rows)
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert kept == sorted([(1, A), (1, B), (4, C)], key=str)  # no text without a copy is lost


def test_a_text_under_a_dropped_id_stays(spark):
    """Id 5 repeats: one of its texts has a copy under id 1, the other has none."""
    rows = [(1, A), (5, _near(A, 3)), (5, C), (5, C), (6, _near(C, 4))]
    found, kept = _found(spark, rows)
    assert [f[1] for f in found] == [1] * 5
    assert kept == sorted([(1, A), (5, C)], key=str)


def test_rows_without_an_id(spark):
    rows = [(10, A), (None, _near(A, 5)), (None, B), (None, B), (None, _near(B, 6)), (None, None), (7, "")]
    found, kept = _found(spark, rows)
    assert found == sorted([(10, 10, True), (None, 10, False), (None, None, False), (None, None, False),
                            (None, None, False), (None, None, False), (7, 7, True)], key=str)
    assert [k[0] for k in kept].count(None) == 5 and (10, A) in kept


def test_no_link_of_the_given_documents_is_missed(spark):
    docs = read_documents(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for width, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
               for r in neardup.near_duplicates(docs, width, percent).collect()}
        assert got == _links(texts, width, percent)

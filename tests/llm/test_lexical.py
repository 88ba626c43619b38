"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from parcelwise.llm import lexical
from tests.llm.data import documents, edge_documents, prose, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _plain(docs, items, top):
    counts = [(d[0], Counter(_terms(d[1]))) for d in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counts:
            score, n = 0, sum(c.values())
            for t in set(_terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, k + 1, doc, -s) for k, (s, _, doc) in enumerate(found[:top])]
    return sorted(out, key=str)


def _items(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "item_id long, text string"))


def _mine(spark, docs, items, top, shard_bytes=lexical.SHARD_BYTES):
    built = lexical.build_index(with_clashes(documents(spark, docs)).repartition(3), shard_bytes)
    index = lexical.Scratch(spark, "test").table(built, "index")
    return sorted((tuple(r) for r in lexical.search(index, _items(spark, items), top).collect()), key=str)


def test_variable_length_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**55, 5], dtype=np.int64)
    raw, start = lexical.encode(values)
    assert (lexical.decode(raw) == values).all() and start[3] == 3
    assert len(lexical.decode(np.zeros(0, np.uint8))) == 0


def test_edge_rows(spark):
    docs = edge_documents()
    items = [(1, "the W1, w2 x é… ONE"), (2, None), (3, ""), (None, "one"), (4, "absent-term"), (1, "one"), (5, docs[8][1])]
    assert _mine(spark, docs, items, 5) == _plain(docs, items, 5)
    assert _mine(spark, [], items, 5) == []
    assert _mine(spark, docs, [], 5) == []
    assert _mine(spark, [(1, None, None, None, None)], items, 5) == []


def test_pruned_search_equals_scoring_all(spark, monkeypatch):
    """Many shards and blocks, very frequent terms, ties; queries in several blocks."""
    rng = random.Random(4)
    docs = [(i, prose(i % 170, rng.choice([5, 30, 200])) + " of the" * rng.randrange(4), "en", "s", 1) for i in range(700)]
    docs += [(1000 + i, "alpha beta the", "en", "s", 1) for i in range(120)]  # equal scores
    items = [(i, prose(i, 25) + " the of and") for i in range(25)] + [(100, "alpha the"), (101, "the")]
    expected = _plain(docs, items, 10)
    for shard_bytes in (2_000, 60_000, lexical.SHARD_BYTES):
        assert _mine(spark, docs, items, 10, shard_bytes) == expected
    monkeypatch.setattr(lexical, "QUERY_TERMS", 40)
    assert _mine(spark, docs, items, 10, 60_000) == expected


def test_block_maxima_keep_blocks_closed():
    """A frequent term's blocks are decoded only where a candidate stands."""
    shard = lexical._Shard()
    import pyarrow as pa
    texts = ["common rare"] * 3 + ["common filler"] * 5000
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    shard.add(pa.array(range(len(texts))), raw, offsets)
    row = next(lexical._shard_rows(shard.batch(0)))
    asked = np.unique(np.concatenate([t for t, _, _ in lexical.scan_terms(
        np.frombuffer(b"common rare", dtype=np.uint8), np.array([0, 11]))]))
    df = [int(row["df"][np.searchsorted(row["terms"].view(np.uint64), t)]) for t in asked]
    lists = lexical._Lists(row, asked, np.array([lexical._weight(5003, x) for x in df]), 5003, 2 * 5003)
    opened = []
    decoded = lists._decoded
    lists._decoded = lambda i, blocks: opened.append((df[i], None if blocks is None else len(blocks))) or decoded(i, blocks)
    places, scores = lexical.best_in_shard(lists, np.arange(2), 1, 3)
    assert len(places) >= 3 and sorted(row["doc_ids"][places[np.argsort(-scores)[:3]]]) == [0, 1, 2]
    assert all(blocks is not None and blocks <= 2 for size, blocks in opened if size == 5003)


def test_a_text_longer_than_a_piece(spark, monkeypatch):
    text = prose(3, 3000) + "x" * 5000 + " tail"
    monkeypatch.setattr(lexical.wh, "SLICE_BYTES", 1000)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    parts = list(lexical.wh.pieces(raw, np.array([0, len(raw)]), lexical._NO_TERM, 1000))
    assert len(parts) > 10 and parts[0][0] == 0 and parts[-1][1] == len(raw)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    terms = [t for a, b in parts for t in _terms(text.encode()[a:b].decode())]
    assert Counter(terms) == Counter(_terms(text))


def test_index_files_have_few_shards(spark, monkeypatch):
    """One task of the build makes many shards: a file has a few of them only."""
    import pyarrow.dataset as ds
    monkeypatch.setattr(lexical.build_index, "__defaults__", (2_000,))
    made = {}

    class Kept(lexical.Scratch):
        def blocks(self, df, name, file_rows):
            made[name] = super().blocks(df, name, file_rows)
            return made[name]
    monkeypatch.setattr(lexical, "Scratch", Kept)
    docs = [(i, f"common w{i % 7} " + prose(i, 60), "en", "s", 1) for i in range(150)]
    items = [(1, "common w3"), (2, "w5 w6")]
    table = documents(spark, docs).coalesce(1)
    got = sorted((tuple(r) for r in lexical.ranked_search(table, _items(spark, items), 5).collect()), key=str)
    assert got == _plain(docs, items, 5)
    rows = [f.count_rows() for f in ds.dataset(made["index"].scratch_path, format="parquet").get_fragments()]
    assert sum(rows) > 8 and max(rows) <= 4

"""The Merkle manifest against a plain recursive version."""

import hashlib
import zlib

from parcelwise.llm import merkle
from tests.llm.data import documents, edge_documents, prose, with_clashes


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return _h(*map(_field, (doc_id, source, lang, n_chars, text)))


def _tree(hashes):
    """(root, per leaf the list of (left, right) siblings)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // 8 * 8
            paths[i].append(("".join(level[run:place]), "".join(level[place + 1:run + 8])))
            at[i] = place // 8
        level = [_h(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def _plain(rows):
    groups, out = {}, []
    for row in rows:
        text = row[1]
        shown = text
        if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
            shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(row[2], []).append((row[0], _leaf(row, text), _leaf(row, shown)))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[lang] = _tree([x[1] for x in groups[lang]])
    root, upper = _tree([trees[lang][0] for lang in order])
    for lang, above in zip(order, upper):
        for (doc_id, leaf, folded), path in zip(groups[lang], trees[lang][1]):
            path = path + above
            for left, right in path:
                folded = _h(left, folded, right)
            out.append((doc_id, leaf, trees[lang][0], root, _h(*[a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=str)


def _mine(spark, rows):
    return sorted((tuple(r) for r in merkle.manifest(with_clashes(documents(spark, rows))).collect()), key=str)


def test_edge_rows(spark):
    assert _mine(spark, edge_documents()) == _plain(edge_documents())
    assert _mine(spark, []) == []
    one = [(7, "Only ONE", "en", None, None)]
    assert _mine(spark, one) == _plain(one)
    assert _mine(spark, one)[0][1] == _mine(spark, one)[0][3]  # a lone leaf is the root


def test_three_levels_and_many_languages(spark):
    rows = [(i, prose(i, 5).title(), f"l{i % 11 if i % 2 else 3}", "s", i) for i in range(640)]
    rows += [(None, "A", "l3", "s", 1)] * 9 + [(5, "A", "l3", "s", 1)] * 3
    mine = _mine(spark, rows)
    assert mine == _plain(rows)
    assert any(not r[-1] for r in mine) and any(r[-1] for r in mine)
    for r in mine:
        assert r[-1] == (r[5] == r[3])


def test_sizes_at_the_borders_of_levels(spark):
    rows = [(i, "T", str(size), "s", 1) for size in (1, 2, 7, 8, 9, 63, 64, 65) for i in range(size)]
    assert _mine(spark, rows) == _plain(rows)

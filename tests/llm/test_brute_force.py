"""Operators that SQL cannot express (and the general ones) against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelwise.llm import html_cut, mixing, neardup, packing, spotsigs, token_scan, tokens, warc
from parcelwise.llm.common import columns_of
from tests.llm.data import WORD, documents, edge_documents, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_tokenizer())


def test_token_ids_equal_the_library(library):
    import pyarrow as pa
    texts = ["", None, "  ", "a", "A..b, c.,", "…. x…, é. ×. ÷.", "<|endoftext|> Hi. <|ENDOFTEXT|>", "don't I'll 's ,",
             "a\x0bb\x1cc d e. İstanbul. ΣΑΣ. é. ́x", "12,5. 1.", "日本語。 テ,", "\x00 \x00. .", "ß, ǅ. ŉ. ÀÞ×÷ÿ",
             "THE!! of%%% l'été ---- ''' x'y'. " + "z" * 50 + "."] + [prose(i, 300) for i in range(5)]
    encoder = tokens.Encoder(tokens.default_tokenizer())
    out = [ids[b[i]:b[i + 1]].tolist() for a, z, ids, b in encoder.encode(pa.array(texts), 1) for i in range(z - a)]
    assert out == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@pytest.mark.parametrize("rows", [None, edge_documents()])
def test_packing(spark, docs, library, rows):
    table = docs if rows is None else documents(spark, rows)
    want, total = Counter(), 0
    for r in table.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for no, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at:at + 4096]
            want[r["doc_id"], no, at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())] += 1
    placed = packing.pack_documents(table).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == want
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= 1.03 * total / 4096 + 2


def test_plan_holds_each_piece_once():
    rng = np.random.default_rng(5)
    for capacity, grid in ((64, 4), (4096, 32)):
        for n in (0, 1, 7, 3000):
            lengths = np.minimum(rng.geometric(6 / capacity, size=n), capacity)
            histogram = np.bincount(lengths, minlength=capacity + 1)
            slots, sequences = packing.plan(histogram, capacity, grid)
            rank = np.concatenate([np.arange(c) for c in histogram]).astype(int)
            length = np.repeat(np.arange(capacity + 1), histogram)
            if n:
                sequence, offset = packing.place(slots, length, rank)
                used = np.bincount(sequence, weights=length)
                assert used.max() <= capacity and len(used) == sequences and used.min() > 0
                assert sequences <= 1.05 * np.ceil(lengths.sum() / capacity) + 1
                for s in range(min(sequences, 40)):
                    mine = np.argsort(offset[sequence == s])
                    size = length[sequence == s][mine]
                    assert (offset[sequence == s][mine] == np.cumsum(size) - size).all()


def test_non_negative_least_squares_beats_projections():
    rng = np.random.default_rng(6)
    a, b = rng.random((12, 20)), rng.random(12) * 3
    x = packing.non_negative_least_squares(a, b)
    best = np.linalg.norm(a @ x - b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-6).all() and (np.abs(slope[x > 0]) <= 1e-6).all()  # optimal
    assert all(best <= np.linalg.norm(a @ np.abs(x + 0.01 * rng.normal(size=20)) - b) for _ in range(50))


def test_separator_scan_over_block_borders(spark, tmp_path):
    rng = random.Random(8)
    want = {}
    for name, count in (("tokens-a.u16", 200), ("tokens-b.u16", 0), ("tokens-c.u16", 3)):
        ids, sizes = [], []
        for _ in range(count):
            n = rng.choice([0, 0, 1, 3, 7, 40])
            ids += [rng.randrange(100) for _ in range(n)] + [9999]
            sizes.append(n)
        tail = 5 if name == "tokens-c.u16" else 0
        (tmp_path / name).write_bytes(np.array(ids + [1] * tail, dtype="<u2").tobytes())
        want[name] = [(i, n, True) for i, n in enumerate(sizes)] + ([(count, tail, False)] if tail else [])
    files = token_scan.token_files(spark, str(tmp_path))
    for block in (1, 3, 7, 1000):
        got = defaultdict(list)
        for r in token_scan.scan_tokens(files, str(tmp_path), 9999, block).collect():
            got[r["file"]].append((r["ordinal"], r["n_tokens"], r["ended"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_token_counts(docs, library):
    got = {r["doc_id"]: r["n_tokens"] for r in token_scan.document_token_counts(docs).collect()}
    plain = library
    plain.encode_special_tokens = True
    assert got == {r["doc_id"]: len(plain.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    plain.encode_special_tokens = False


def test_mixing_targets_and_draws(spark, docs):
    weights = [3, 1, 2]
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        budget = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = budget / max(1, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    plan = mixing.mix_plan(docs, weights).collect()
    for r in plan:
        target = 2 * sizes[r["source"]] if r["source"] in full else level * weight[r["source"]]
        assert abs(r["target"] - target) < 1e-6 * max(1, target)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1 and r["copies"] <= 2
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(docs, weights).collect()))  # reruns agree
    taken = Counter(r["doc_id"] for r in mixing.mix(docs, weights).collect())
    assert taken == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    explained = mixing.mix(docs, weights)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in explained and "Arrow" not in explained


def _links(texts, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        sets[k] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in texts}


@pytest.mark.parametrize("leaf", [1000, 30])
def test_near_duplicates(spark, monkeypatch, leaf):
    """Small leaves make every group large: stars, minorities, branching and block pairs all run."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "CHUNK", leaf)
    rng = random.Random(3)
    base = [prose(50 + g, 60).split() for g in range(4)]
    texts = {}
    for i in range(120):
        words = list(base[i % 4])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words) if i % 9 else " ".join(base[0][:30]) + " " + prose(300 + i, 40)
    texts[500], texts[501], texts[502] = "", "one TWO", "One two"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == _links(texts, 3, 85)


def test_spot_signatures(spark, docs):
    ordered = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    rows = {r["doc_id"]: r for r in spotsigs.fingerprints(docs).collect()}
    mask = spotsigs.common_words(columns_of(docs, "doc_id", "text"))
    sets = {k: {rows[k]["fingerprint"][i:i + 8] for i in range(0, len(rows[k]["fingerprint"]), 8)} for k in rows}

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0
    import pyarrow as pa
    for i, (k, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[1][:half]
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(rows[k]["near_next"] - jaccard(sets[k], sets[following[0]])) < 1e-12
        print_ = spotsigs.fingerprint(spotsigs.signature_sets(pa.array([edited]), mask)[0])
        assert print_ == rows[k]["edited_fingerprint"]
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.2
    prints = spark.createDataFrame([(k, r["fingerprint"]) for k, r in rows.items()], "doc_id long, fingerprint string")
    probes = prints.where("doc_id % 20 = 0")
    found = {(r["probe_id"], r["doc_id"]) for r in spotsigs.matches(probes, prints, 50).collect()}
    want = {(p, k) for p in sets if p % 20 == 0 for k in sets if sets[p] and sets[k] and jaccard(sets[p], sets[k]) >= 0.5}
    assert found == want


def test_signature_chains():
    import pyarrow as pa
    mask = np.zeros(spotsigs.BUCKETS, dtype=bool)
    words, _ = spotsigs._words(np.frombuffer(b"the of", np.uint8), np.array([0, 6]))
    mask[spotsigs._bucket(words)] = True
    a, b, c = spotsigs.signature_sets(pa.array(["The cat, of sat!! on", "x the CAT sat y", "the of the"]), mask)
    assert len(a) == 2 and len(b) == 1 and b[0] in a  # chains skip anchors, marks and case
    assert len(c) == 1 and c[0] not in a  # no content words: all words make one signature


def test_html_on_pages_and_hand_made_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    from html import unescape
    for r in html_cut.extract(pages).join(pages.drop("url"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        plain = unescape(re.sub("<[^>]+>", "", re.sub("<(/?p|br|/?h1)>", " ", article)))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])
    page = """<body class="no-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies to improve
    your visit, please accept them all now.</div><div id="main"><div class="breadcrumb">Home &gt; News</div><h1>A headline</h1>
    <p>A long first paragraph of the text, with many&nbsp;words in it &amp; a <a href=x>link</a>.</p><p>Short.</p>
    <div class="ad">Buy this thing now for little money, it is really good.</div><p>Another long paragraph follows, one
    with<br>more than a few words.</p><form><label>Name</label><button>Send</button></form><section id="comments">
    <p>I think that this is a very nice article and I liked it a lot.</p></section></div><aside><p>A sidebar paragraph
    which has got a number of words as well.</p></aside><script>var a = "<p>no</p>";</script><footer>&copy; Site</footer>"""
    assert html_cut.main_text(page) == (
        "A headline A long first paragraph of the text, with many words in it & a link. Short. "
        "Another long paragraph follows, one with more than a few words.")


def test_minimum_cut_is_minimal():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randrange(1, 9)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randrange(12))]

        def cost(side):
            return sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, side)) + \
                sum(w for a, b, w in edges if side[a] != side[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_cut.minimum_cut(scores, edges)) - best) < 1e-9


def test_warc_round_trip_and_look_up(spark, tmp_path):
    pages = [(i, f"http://h{i % 5}.example.com/p{i % 7}", f"<p>payload {i % 11}</p>") for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    captures = warc.write_archives(df, str(tmp_path / "warc"))
    directory = warc.write_index(captures, str(tmp_path / "index"), block_lines=9)
    assert directory.count() > 10
    keys = spark.createDataFrame([(warc.surt("http://h2.example.com/p3"),), ("com,example,none)/",)], "key string")
    got = {r["page_id"] for r in warc.look_up(keys, directory, str(tmp_path / "warc"), str(tmp_path / "index")).collect()}
    assert got == {i for i, u, _ in pages if u == "http://h2.example.com/p3"}
    first = {}
    for i, _, h in pages:
        first.setdefault(h, i)
    for r in warc.write_and_read(df, block_lines=9).collect():
        data = pages[r["page_id"]][2].encode()
        assert (r["url"], r["payload_bytes"]) == (pages[r["page_id"]][1], len(data))
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        origin = first[data.decode()]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if origin == r["page_id"] else ("revisit", origin))
    small = warc.write_and_read(df, min_bytes=100)
    assert small.where("record_type = 'response'").count() == 120
    assert warc.surt("https://User@WWW.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"

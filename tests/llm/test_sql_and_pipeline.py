"""Queries against their SQL, chat round trip, and the pipeline against a plain version."""

from collections import Counter, defaultdict

import corpus_pipeline
import oracle_check
from parcelwise.llm import chat, line_quality, packing, queries, site_lines
from parcelwise.llm.oracle import ORACLE
from tests.llm.data import WORD, documents, prose
from tests.llm.test_brute_force import _links

SF = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    con = oracle_check.duck(SF)
    for name, sql in ORACLE.items():
        frame = queries.QUERIES[name](spark, SF)
        result = con.execute(sql)
        names, rows = [d[0] for d in result.description], result.fetchall()
        mine = [tuple(r) for r in frame.collect()]
        assert oracle_check.digest(frame.columns, mine)[0] == oracle_check.digest(names, rows)[0], name


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\l\\b\\\\[TURN]<s>"), (1, 2, "assistant", ""),
             (1, 3, "as[si<st\\ant", "x"), (1, 4, "assistant", "é…\n"), (2, 5, "user", "\\"), (2, 4, "user", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    for r in made.select("conv_id", "formatted", "loss", chat.read_turns(made["formatted"]).alias("turns"),
                         chat.loss_text(made["formatted"], made["loss"]).alias("under")).collect():
        mine = [(role, text) for c, t, role, text in sorted(turns) if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == mine
        assert r["under"] == "".join(text for role, text in mine if role == "assistant")
        merged = 1 + sum(a[0] != b[0] for a, b in zip(mine, mine[1:]))
        assert r["formatted"].count("<s>[INST]") == merged == r["formatted"].count("</s>")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _corpus():
    """A host with a licence line in a fifth of its documents, near copies, junk, depleted ones."""
    rows, licence = [], "This work is under some licence."
    for i in range(150):
        text = prose(i, 50) + "\n" + prose(1000 + i, 30)
        if i % 5 == 0:
            text += "\n" + licence
        rows.append((i, text, "en", "a" if i < 120 else "b", len(text)))
    copy = rows[7][1].split(" ")
    copy[10] = "changed"
    rows.append((200, " ".join(copy), "en", "b", 1))
    rows.append((201, rows[8][1], "en", "a", 1))
    rows.append((202, "too short", "en", "a", 9))
    rows.append((203, " ".join(["again and again and"] * 30), "en", "b", 1))
    rows.append((204, None, "en", "b", 0))
    return rows


def _flagged(rows, share, least, limit=float("inf")):
    texts, hosts, first = defaultdict(set), defaultdict(set), {}
    for doc, text, _, host, _ in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            norm = " ".join(WORD.findall(line)).lower()
            if norm:
                texts[host, norm].add(text)
                first[host, norm] = min(first.get((host, norm), doc), doc)
    return {k: first[k] for k, t in texts.items() if len(t) > least and len(t) > min(share * len(hosts[k[0]]), limit)}


def _without(row, flagged):
    doc, text, lang, host, _ = row
    kept = [x for x in (text or "").split("\n")
            if flagged.get((host, " ".join(WORD.findall(x)).lower()), doc) == doc]
    return doc, "\n".join(kept), lang, host, len("\n".join(kept))


def _plain_quality(rows, limit=line_quality.LIMIT):
    flagged, out = _flagged(rows, line_quality.SHARE, line_quality.MIN_DOCS, limit), []
    for row in rows:
        words = WORD.findall(row[1] or "")
        runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        twice = Counter(runs)
        inside = {i + k for i, r in enumerate(runs) if twice[r] > 1 for k in range(8)}
        new = _without(row, flagged)
        left = len(WORD.findall(new[1]))
        gone = len(words) - left
        if len(words) >= 20 and 100 * len(inside) <= 30 * len(words) and not (gone and left < line_quality.LEFT * len(words)):
            out.append(new)
    return out


def test_line_limits_and_depleted_documents(spark):
    """Small hosts are judged by the ratio, a hot host by the number of documents."""
    shared = "\n".join(prose(5000 + i, 12) for i in range(4))
    rows = [(i, prose(i, 40) + "\n" + shared.split("\n")[i % 4], "en", "small", 1) for i in range(12)]
    rows += [(100 + i, prose(100 + i, 40) + ("\n" + shared.split("\n")[0] if i < 30 else ""), "en", "hot", 1) for i in range(900)]
    rows += [(50, shared + "\n" + prose(50, 10), "en", "small", 1), (51, shared + "\nsome more words", "en", "small", 1)]
    frame = documents(spark, rows)
    for limit, hot_removed in ((1000, 0), (20, 29)):
        found = {r["doc_id"]: r for r in line_quality.quality(frame, limit=limit).collect()}
        assert sorted(r[0] for r in _plain_quality(rows, limit)) == sorted(k for k, r in found.items() if r["kept"])
        assert not found[50]["base_failed"] and not found[50]["kept"] and not found[51]["kept"]
        assert sum(r["removed_words"] > 0 for k, r in found.items() if k >= 100) == hot_removed
        assert sum(r["removed_words"] > 0 for k, r in found.items() if k < 12) == 8
    dropped = {r["doc_id"]: r["n_dropped_lines"] for r in site_lines.drop_site_lines(frame).collect()}
    assert sum(dropped[i] for i in range(12)) == 8 and dropped[50] == dropped[51] == 4


def test_pipeline_stages_equal_a_plain_version(spark):
    assert [s[0] for s in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near dedup", "source mix", "pattern packing"]
    rows = _corpus()
    stage = dict(corpus_pipeline.STAGES)
    back = lambda df: sorted(tuple(r) for r in df.collect())
    quality = back(stage["quality rules"](spark, documents(spark, rows), ""))
    assert quality == sorted(_plain_quality(rows)) and 204 not in [r[0] for r in quality]
    assert sum("licence" in r[1] for r in quality) < sum("licence" in (r[1] or "") for r in rows)
    flagged = _flagged(quality, site_lines.RATIO, site_lines.MIN_DOCS)
    lines = back(stage["line dedup"](spark, documents(spark, quality), ""))
    assert lines == sorted(_without(r, flagged) for r in quality)
    links = _links({r[0]: r[1] for r in lines}, 5, 80)
    near = back(stage["near dedup"](spark, documents(spark, lines), ""))
    assert near == [r for r in lines if links[r[0]][2]] and len(near) < len(lines)
    mixed = back(stage["source mix"](spark, documents(spark, near), ""))
    assert set(mixed) <= set(near) and len(mixed) > len(near)
    packed = stage["pattern packing"](spark, documents(spark, mixed), "").collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in mixed)
    assert max(r["offset"] + r["length"] for r in packed) <= packing.CAPACITY


def test_pipeline_runs_end_to_end(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)

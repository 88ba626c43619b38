"""Every operator on nulls, empty and long texts, ties, repeats, clashing columns, and no rows."""

import pytest

import corpus_pipeline
from parcelwise.llm import chat, html_cut, line_quality, mixing, neardup, packing, site_lines, spotsigs, token_scan, warc
from tests.llm.data import documents, edge_documents, with_clashes

ON_DOCUMENTS = {
    "packing": packing.pack_documents, "sequences": packing.sequences, "quality": line_quality.quality,
    "keep_good": line_quality.keep_good, "tokens": token_scan.document_token_counts,
    "mix_plan": lambda d: mixing.mix_plan(d, [3, 1, 2]), "mix": lambda d: mixing.mix(d, [3, 1, 2]),
    "near": lambda d: neardup.near_duplicates(d, 3, 85), "keep_one": neardup.keep_one,
    "site_lines": site_lines.drop_site_lines, "spotsigs": spotsigs.fingerprints,
}
PAGES = [(1, "http://A.example.com/x?q=1", "<p>Hello, world &amp; all.</p>"), (2, None, None), (3, "", ""),
         (None, "http://b.example/", "<p>Hello, world &amp; all.</p>"), (4, "no host", "<p>" + "long text. " * 50_000),
         (4, "no host", "<p>again</p>"), (5, "http://a.example.com/x?q=1", ""), (6, "http://[bad", "<b"),
         (7, "http://a.example.com/\r\nX: y", "<!-- <p>x")]
PAGE_SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_edge_documents(spark, name):
    once_per_row = {"quality", "tokens", "mix_plan", "near", "site_lines", "spotsigs"}
    run = ON_DOCUMENTS[name]
    rows = run(with_clashes(documents(spark))).collect()
    if name in once_per_row:
        assert len(rows) == len(edge_documents())
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in edge_documents())
    assert run(documents(spark, [])).count() == 0


def test_edge_pages(spark):
    pages = with_clashes(spark.createDataFrame(PAGES, PAGE_SCHEMA))
    empty = spark.createDataFrame([], PAGE_SCHEMA)
    assert html_cut.extract(pages).count() == len(PAGES)
    assert html_cut.extract(empty).count() == 0
    rows = warc.write_and_read(pages, block_lines=2).collect()
    assert sorted((str(r["page_id"]), str(r["url"])) for r in rows) == sorted((str(p), str(u)) for p, u, _ in PAGES)
    copies = {r["url"]: (r["record_type"], r["refers_to"]) for r in rows}
    assert copies["http://b.example/"] == ("revisit", 1)  # an equal payload without an id
    assert copies["http://a.example.com/x?q=1"] == ("revisit", 2)  # empty payloads are equal too
    assert warc.write_and_read(empty).count() == 0


def test_edge_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, None, None), (None, None, "user", "b"), (2, 3, "x[", "\\")]
    rows = {r["conv_id"]: r["n_turns"]
            for r in chat.digest(chat.format_conversations(with_clashes(spark.createDataFrame(turns, schema)))).collect()}
    assert rows == {1: 2, None: 2, 2: 1}
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_edge_stages(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (with_clashes(documents(spark)), documents(spark, [])):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.format("noop").mode("overwrite").save()

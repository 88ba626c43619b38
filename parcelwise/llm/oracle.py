"""DuckDB SQL of the training-data queries that SQL can express.

Packing (1), the separator scan (3), HTML extraction (6) and spot signatures (9) need a
tokenizer, a file scan, a parser or hashes that SQL does not have; tests/llm holds them
against brute force.
"""

from __future__ import annotations

from parcelwise.llm import line_quality, mixing, site_lines

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HOST = "CASE WHEN source IS NULL THEN '0' ELSE '1' || source END"

#: Lines with a word (d: doc_id, host, t), how many texts of the host hold each, and the host's.
LINES = f"""
d AS (SELECT doc_id, {HOST} AS host, coalesce(text, '') AS t, text IS NULL AS gone FROM documents),
every_line AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line,
               generate_subscripts(string_split(t, chr(10)), 1) AS no FROM d),
l AS (SELECT *, len({WORDS.format('line')}) AS n_words,
      {ASCII_LOWER.format("array_to_string(" + WORDS.format('line') + ", ' ')")} AS norm FROM every_line),
full_line AS (SELECT * FROM l WHERE n_words > 0),
hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host),
counted AS (SELECT host, norm, count(DISTINCT t) AS docs, min(doc_id) AS first_doc FROM full_line GROUP BY host, norm),
flagged AS (SELECT c.host, c.norm, c.first_doc FROM counted c JOIN hosts h ON c.host = h.host
            WHERE c.docs > {{min_docs}} AND c.docs > least(h.host_docs * {{share}}::DOUBLE, {{limit}}::DOUBLE))"""

QUALITY = f"""
WITH {LINES.format(min_docs=line_quality.MIN_DOCS, share=line_quality.SHARE, limit=line_quality.LIMIT)},
w AS (SELECT doc_id, t, {WORDS.format('t')} AS words FROM d),
runs AS (SELECT doc_id, no, array_to_string(words[no:no + 7], ' ') AS run
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS no FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, run FROM runs GROUP BY doc_id, run HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
            SELECT r.doc_id, unnest(range(r.no, r.no + 8)) AS place FROM runs r JOIN twice USING (doc_id, run))
            GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_line GROUP BY doc_id),
gone AS (SELECT x.doc_id, sum(x.n_words) AS n FROM full_line x JOIN flagged f ON x.host = f.host AND x.norm = f.norm
         WHERE x.doc_id IS DISTINCT FROM f.first_doc GROUP BY x.doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
      coalesce(gone.n, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > {line_quality.REPEAT_PERCENT} * n_words
      AS base_failed FROM c)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND n_words - removed_words < {line_quality.LEFT}::DOUBLE * n_words)
AS kept FROM b"""

SITE_LINES = f"""
WITH {LINES.format(min_docs=site_lines.MIN_DOCS, share=site_lines.RATIO, limit="'infinity'")},
marked AS (SELECT l.*, n_words > 0 AND f.norm IS NOT NULL AND l.doc_id IS DISTINCT FROM f.first_doc AS dropped
           FROM l LEFT JOIN flagged f ON l.host = f.host AND l.norm = f.norm)
SELECT doc_id, count(*) FILTER (n_words > 0) AS n_lines, count(*) FILTER (dropped) AS n_dropped_lines,
       length(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT dropped), ''))::BIGINT AS kept_chars,
       md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT dropped), '')) AS kept_md5
FROM marked GROUP BY doc_id"""

MIX = f"""
WITH s AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size,
      row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
x AS (SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT] AS weight FROM z),
o AS (SELECT *, source_size * 2.0::DOUBLE AS most, sum(weight) OVER () AS every_weight,
      1.5::DOUBLE * sum(source_size) OVER () AS budget,
      coalesce(sum(source_size * 2.0::DOUBLE) OVER up, 0) AS full_before, coalesce(sum(weight) OVER up, 0) AS weight_before
      FROM x WINDOW up AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT (budget - full_before) / (every_weight - weight_before) AS level FROM o
        WHERE (budget - full_before) / (every_weight - weight_before) * weight <= most
        ORDER BY source_size / weight, place LIMIT 1),
t AS (SELECT source, source_size, least(weight * (SELECT level FROM lev), most) AS target FROM o),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target,
      CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('{mixing.SEED}|' || coalesce(s.doc_id::VARCHAR, 'none')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(ASCII_LOWER.format("coalesce(text, '')"))} AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3
      THEN list_transform(range(1, len(words) - 1), lambda i: hash(words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
      WHEN len(words) > 0 THEN [hash(array_to_string(words, ' '))] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * both_n >= 85 * (na.n + nb.n - both_n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id"""

_ESC = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '[', chr(92) || 'b')"
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same,
      length({_ESC.format('role')}) AS role_n, length({_ESC.format('text')}) AS text_n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_n + CASE WHEN same THEN length('[TURN]') ELSE role_n + length('<s>[INST][/INST]</s>') END)::BIGINT
       AS formatted_chars
FROM m GROUP BY conv_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(d, (j // 4) * 5 + 1, 5))::INT >> (15 - 5 * (j % 4)))::INT & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f"""

def _tree_sql(name: str, height: int) -> str:
    """CTEs of ``height`` tree levels over ``{name}_0`` (grp, pos, n, hash) and of each leaf's
    ``{name}_path`` (folded, proof) over ``{name}_leaf`` (grp, pos, n, shown, ...)."""
    out = []
    for k in range(1, height + 1):
        out.append(f"""{name}_kids_{k} AS MATERIALIZED (SELECT grp, pos // 8 AS pos, any_value(n) AS n, list(hash ORDER BY pos) AS kids
            FROM {name}_{k - 1} GROUP BY grp, pos // 8),
{name}_{k} AS MATERIALIZED (SELECT grp, pos, (n + 7) // 8 AS n,
            CASE WHEN n = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS hash FROM {name}_kids_{k})""")
    out.append(f"{name}_fold_0 AS (SELECT *, pos AS place, shown AS folded, '' AS proof FROM {name}_leaf)")
    for k in range(1, height + 1):
        left, right = "array_to_string(k.kids[1:f.place % 8], '')", "array_to_string(k.kids[f.place % 8 + 2:], '')"
        out.append(f"""{name}_fold_{k} AS MATERIALIZED (SELECT f.* EXCLUDE (place, folded, proof), f.place // 8 AS place,
            CASE WHEN k.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded,
            CASE WHEN k.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof
            FROM {name}_fold_{k - 1} f JOIN {name}_kids_{k} k ON f.grp = k.grp AND f.place // 8 = k.pos)""")
    return ",\n".join(out)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32, bit by bit, of the ASCII text of an integer.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split({0}::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                               lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
#: Trees of up to 8^8 documents of one language and 8^3 languages.
MANIFEST = f"""
WITH d AS (SELECT *, {_CRC32.format("doc_id")} % 3 = 0 AS hit FROM documents),
h AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, {_leaf_sql("text")} AS leaf,
      CASE WHEN hit THEN {_leaf_sql(ASCII_LOWER.format("text"))} ELSE {_leaf_sql("text")} END AS shown FROM d),
doc_leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS pos,
             count(*) OVER (PARTITION BY grp) AS n FROM h),
doc_0 AS (SELECT grp, pos, n, leaf AS hash FROM doc_leaf),
{_tree_sql("doc", 8)},
lang_leaf AS MATERIALIZED (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, hash AS shown,
              grp AS lang_key FROM doc_8),
lang_0 AS (SELECT grp, pos, n, shown AS hash FROM lang_leaf),
{_tree_sql("lang", 3)},
folded AS (SELECT d.doc_id, d.leaf, u.shown AS subroot, (SELECT hash FROM lang_3) AS root, d.proof || u.proof AS proof,
           d.folded, u.pos, u.n FROM doc_fold_8 d JOIN lang_fold_3 u ON d.grp = u.lang_key),
lang_step AS (SELECT f.*, f.pos AS at_0, f.folded AS up_0 FROM folded f),
up_1 AS (SELECT f.*, CASE WHEN k.n = 1 THEN up_0 ELSE sha256(array_to_string(k.kids[1:at_0 % 8], '') || up_0
         || array_to_string(k.kids[at_0 % 8 + 2:], '')) END AS up_1 FROM lang_step f JOIN lang_kids_1 k ON f.at_0 // 8 = k.pos),
up_2 AS (SELECT f.*, CASE WHEN k.n = 1 THEN up_1 ELSE sha256(array_to_string(k.kids[1:at_0 // 8 % 8], '') || up_1
         || array_to_string(k.kids[at_0 // 8 % 8 + 2:], '')) END AS up_2 FROM up_1 f JOIN lang_kids_2 k ON f.at_0 // 64 = k.pos),
up_3 AS (SELECT f.*, CASE WHEN k.n = 1 THEN up_2 ELSE sha256(array_to_string(k.kids[1:at_0 // 64 % 8], '') || up_2
         || array_to_string(k.kids[at_0 // 64 % 8 + 2:], '')) END AS up_3 FROM up_2 f JOIN lang_kids_3 k ON f.at_0 // 512 = k.pos)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, up_3 AS folded_root, up_3 = root AS verified FROM up_3"""

_TERMS = (r"regexp_extract_all(" + ASCII_LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SEARCH = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
      FROM p CROSS JOIN c GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, p.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT
      AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.doc_id = p.doc_id CROSS JOIN c
      GROUP BY item_id, p.doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""

ORACLE: dict[str, str] = {
    "op2_line_quality": QUALITY, "op4_source_mix": MIX, "op5_chosen_path": NEAR, "op7_site_lines": SITE_LINES,
    "op8_chat_format": CHAT, "op10_capture_index": WARC,
    "op12_block_max_search": SEARCH, "op13_interval_manifest": MANIFEST,
}

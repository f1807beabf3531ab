"""SQL of the queries over derived tables. Patterns and lists are written out here, apart from the code that they check."""

from __future__ import annotations

from .oracle import BODY, IMPORTANCE, LINES, NORMS, SENT, TFIDF, TOP, normal, tokens

HEADINGS = "['References', 'BIBLIOGRAPHY ', 'Works  cited', 'literature' || chr(9) || 'cited', 'Reference list', 'Appendix', 'Supplementary Material', 'supplementary information', 'Methods', 'Reference']"
REFERENCE = "('references', 'bibliography', 'works cited', 'literature cited', 'reference list')"
AFTER = "('appendix', 'supplementary material', 'supplementary information')"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _entry(x: str) -> str:
    year = _has(x, r"\b(?:18|19|20)[0-9]{2}[a-z]?\b")
    locator = _has(x, r"(?i)(?:\bdoi\s*:|\bhttps?://|\bwww\.)")
    marker = _has(x, r"^(?:\[[0-9]+\]|[0-9]+[.)])\s+")
    citation = _has(x, r"(?i)\b(?:et al\.?|vol\.?|no\.?|pp\.?|pages?|journal|proceedings|conference|press|publisher|edition|retrieved|accessed|available at)\b")
    author = _has(x, r"^(?:(?:\[[0-9]+\]|[0-9]+[.)])\s+)?[A-Z][A-Za-z''’\-]+,\s*(?:[A-Z]\.?(?:[- ]?[A-Z]\.?)?\s*,?\s*){1,4}")
    named = _has(x, r"^[A-Z][A-Za-z''’\-]+(?:,|\s+and\s+|\s*&\s+).{0,120}\((?:18|19|20)[0-9]{2}[a-z]?\)")
    source = f"({year} OR {locator} OR {citation})"
    return f"(length({x}) >= 8 AND (({author} AND {source}) OR ({marker} AND ({source} OR {author})) OR ({locator} AND ({year} OR {citation} OR len(string_split({x}, ' ')) <= 12)) OR {named} OR ({year} AND {citation})))"


def sql() -> dict[str, str]:
    clean = normal(r"regexp_replace(regexp_replace(['12. [Method-2] ', ' 3.[goal]', '[9] ', '7.5 ', ''][turn % 5 + 1] || text, '^\s*[0-9]+\.\s*', ''), '^\s*\[[A-Za-z][A-Za-z0-9-]*\]\s*', '')")
    ask = "'Summarise the text above in ' || {n} || ' sentences. Use whole sentences, one to a line, and nothing else.'"
    labels = r"'Labels:' || chr(10) || '[goal]: What is wanted' || chr(10) || '[result]: What was found' || chr(10) || chr(10) || 'Start each sentence with the label that fits it best.'"
    sectioned = f"{SENT},\nt AS (SELECT *, ['Abstract', 'Methods', 'References', '', 'results'][sentence_no % 5 + 1] AS section, sentence_no % 7 = 6 AS front FROM sent)"
    # The greedy selection by sections: a pick costs the others of its section 0.06 each time.
    three = [f"""WITH {NORMS},
{IMPORTANCE.removeprefix(BODY + ",").strip()},
u AS MATERIALIZED (SELECT v.doc_id, v.sentence_no, term, value / norm AS value FROM v JOIN norms USING (doc_id, sentence_no) WHERE norm > 0),
b1 AS MATERIALIZED (SELECT doc_id, sentence_no, importance, 0.0::DOUBLE AS worst, 0 AS used FROM imp)"""]
    for i in (1, 2, 3):
        three.append(f"r{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(0.65 * importance - 0.35 * worst - 0.06 * used, 9) DESC, sentence_no) AS r FROM b{i})")
        if i < 3:
            three.append(f"c{i} AS MATERIALIZED (SELECT u.doc_id, u.sentence_no, sum(u.value * x.value) AS cos FROM u JOIN (SELECT u.* FROM u JOIN r{i} USING (doc_id, sentence_no) WHERE r = 1) x ON u.doc_id = x.doc_id AND u.term = x.term GROUP BY ALL)")
            three.append(f"b{i + 1} AS MATERIALIZED (SELECT a.doc_id, a.sentence_no, a.importance, greatest(a.worst, coalesce(cos, 0)) AS worst, a.used + CASE WHEN a.sentence_no % 3 = p.sentence_no % 3 THEN 1 ELSE 0 END AS used FROM r{i} a JOIN r{i} p ON p.doc_id = a.doc_id AND p.r = 1 LEFT JOIN c{i} c ON c.doc_id = a.doc_id AND c.sentence_no = a.sentence_no WHERE a.r > 1)")
    sections = ",\n".join(three) + "\n" + " UNION ALL ".join(f"SELECT doc_id, sentence_no, {i} AS pick FROM r{i} WHERE r = 1" for i in (1, 2, 3))
    # Coverage: the first pick lowers its best column by a tenth of the deviation of all entries.
    coverage = f"""WITH {NORMS},
{IMPORTANCE.removeprefix(BODY + ",").strip()},
m AS MATERIALIZED (SELECT doc_id, sentence_no, importance, unnest(range(0, 3)) AS col, ((sentence_no * 37 + unnest(range(0, 3)) * 53 + doc_id) % 101) / 101.0::DOUBLE AS s FROM imp),
g AS (SELECT doc_id, stddev_pop(s) * 0.1 AS lower FROM m GROUP BY doc_id),
v1 AS (SELECT doc_id, sentence_no, round(0.65 * any_value(importance) + 0.65 * max(s), 9) AS value FROM m GROUP BY doc_id, sentence_no),
p1 AS MATERIALIZED (SELECT doc_id, sentence_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, sentence_no) AS r FROM v1) WHERE r = 1),
j AS (SELECT doc_id, col FROM (SELECT m.doc_id, col, row_number() OVER (PARTITION BY m.doc_id ORDER BY s DESC, col) AS r FROM m JOIN p1 USING (doc_id, sentence_no)) WHERE r = 1),
c AS (SELECT v.doc_id, v.sentence_no, sum(v.value * x.value) / any_value(a.norm * b.norm) AS cos FROM v JOIN (SELECT v.* FROM v JOIN p1 USING (doc_id, sentence_no)) x ON v.doc_id = x.doc_id AND v.term = x.term
  JOIN norms a ON a.doc_id = v.doc_id AND a.sentence_no = v.sentence_no JOIN norms b ON b.doc_id = x.doc_id AND b.sentence_no = x.sentence_no GROUP BY v.doc_id, v.sentence_no),
v2 AS (SELECT m.doc_id, m.sentence_no, round(0.65 * any_value(m.importance) + 0.65 * max(CASE WHEN m.col = j.col THEN greatest(0, m.s - g.lower) ELSE m.s END) - 0.35 * coalesce(any_value(c.cos), 0) - 0.06, 9) AS value
  FROM m JOIN g USING (doc_id) JOIN j ON j.doc_id = m.doc_id LEFT JOIN c ON c.doc_id = m.doc_id AND c.sentence_no = m.sentence_no ANTI JOIN p1 ON p1.doc_id = m.doc_id AND p1.sentence_no = m.sentence_no GROUP BY m.doc_id, m.sentence_no)
SELECT doc_id, sentence_no, 1 AS pick FROM p1 UNION ALL SELECT doc_id, sentence_no, 2 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, sentence_no) AS r FROM v2) WHERE r = 1"""
    similar = f"""WITH {TFIDF},
nv AS (SELECT doc_id, sentence_no, sqrt(sum(value * value)) AS norm FROM v GROUP BY ALL),
st AS (SELECT doc_id, {tokens(normal("string_agg(text, ' ' ORDER BY sentence_no)"))} AS t FROM body WHERE sentence_no % 3 = 0 GROUP BY doc_id),
s1 AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '__' || t[i + 1]))) AS term FROM st),
s2 AS (SELECT doc_id, term, count(*) AS tf FROM s1 GROUP BY ALL),
s3 AS (SELECT s2.doc_id, s2.term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS value FROM s2 JOIN vocab USING (doc_id, term)),
ns AS (SELECT doc_id, sqrt(sum(value * value)) AS norm FROM s3 GROUP BY doc_id),
d AS (SELECT v.doc_id, v.sentence_no, sum(v.value * s3.value) AS dot FROM v JOIN s3 USING (doc_id, term) GROUP BY ALL)
SELECT body.doc_id, body.sentence_no, round(coalesce(dot / (nv.norm * ns.norm), 0), 6) AS similarity FROM body LEFT JOIN d ON d.doc_id = body.doc_id AND d.sentence_no = body.sentence_no LEFT JOIN nv ON nv.doc_id = body.doc_id AND nv.sentence_no = body.sentence_no LEFT JOIN ns ON ns.doc_id = body.doc_id"""
    arrays = f"""WITH l AS ({LINES}), a AS (SELECT doc_id, line_no, {normal('text')} AS s, 6.0::DOUBLE * length(text) AS w FROM l), b AS (SELECT doc_id, line_no, string_split(s, ' ') AS p, greatest(0.1, w) AS w, w AS raw FROM a WHERE s <> ''),
c AS (SELECT *, list_sum(list_transform(p, lambda x: greatest(1, length(x)))) + (len(p) - 1) * 0.55::DOUBLE AS u, unnest(range(0, len(p))) AS pos FROM b),
e AS (SELECT *, CASE WHEN len(p) = 1 THEN 36.0::DOUBLE ELSE 36 + w * (coalesce(list_sum(list_transform(p[1:pos], lambda x: greatest(1, length(x)))), 0) + pos * 0.55::DOUBLE) / u END AS x FROM c)
SELECT doc_id, CAST(line_no // 60 AS INTEGER) AS page_index, row_number() OVER (PARTITION BY doc_id, line_no // 60 ORDER BY line_no, pos) - 1 AS word_pos, p[pos + 1] AS text, round(x + 0.0000314159, 3) AS x1, 770.0::DOUBLE - line_no % 60 * 12 AS y1,
  round(CASE WHEN pos = len(p) - 1 THEN 36 + raw ELSE least(36 + raw, x + w * greatest(1, length(p[pos + 1])) / u) END + 0.0000314159, 3) AS x2, 780.0::DOUBLE - line_no % 60 * 12 AS y2, line_no % 60 * 12 + 12.0::DOUBLE AS top FROM e"""
    # In the monospace layout a line's words are its pieces between blanks, 6 points a letter.
    pieces = f"""l AS ({LINES}), p AS (SELECT doc_id, line_no, string_split(text, ' ') AS p, length(text) AS n, length(text) - length(ltrim(text, ' ')) AS lead, length(rtrim(text, ' ')) AS until FROM l),
w AS (SELECT doc_id, line_no, list_filter(p, lambda x: x <> '') AS w, 36.0::DOUBLE + 6 * lead AS x1, 36.0::DOUBLE + 6 * until AS x2 FROM p)"""
    step = r"CASE WHEN a = '' OR regexp_matches(b, '^[,.;:!?%)\]}]') OR regexp_matches(a, '[(\[{/$]$') THEN a || b ELSE a || ' ' || b END"
    # Greedy packing: a fold over segments, and for a segment beyond the limit over its words.
    count = lambda x: rf"CAST(coalesce(list_sum(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'), lambda u: CASE WHEN regexp_matches(u, '^[\p{{L}}\p{{N}}]') THEN ceil(length(u) / 3) ELSE 1 END)), 0) AS BIGINT)"
    none = "CAST([] AS VARCHAR[])"
    start = f"{{'done': {none}, 'held': '', 'n': CAST(0 AS BIGINT), 'big': {none}}}"
    pack = f"CASE WHEN len(q.big) > 0 THEN {{'done': list_concat(p.done, [p.held], q.big), 'held': '', 'n': CAST(0 AS BIGINT), 'big': {none}}} WHEN p.held <> '' AND p.n + q.n > 3584 THEN {{'done': list_append(p.done, p.held), 'held': q.held, 'n': q.n, 'big': {none}}} ELSE {{'done': p.done, 'held': p.held || q.held, 'n': p.n + q.n, 'big': {none}}} END"
    chunks = rf"""WITH a AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]*|.+$') AS s FROM documents)),
b AS (SELECT doc_id, i, x, {count('x')} AS n FROM a),
w AS (SELECT doc_id, i, list_reduce(list_concat([{start}], list_transform(regexp_extract_all(x, '\S+\s*'), lambda w: {{'done': {none}, 'held': w, 'n': {count('w')}, 'big': {none}}})), lambda p, q: {pack}) AS r FROM b WHERE n > 3584),
e AS (SELECT b.doc_id, b.i, {{'done': {none}, 'held': CASE WHEN w.r IS NULL THEN x ELSE '' END, 'n': b.n, 'big': CASE WHEN w.r IS NULL THEN {none} ELSE list_append(w.r.done, w.r.held) END}} AS e FROM b LEFT JOIN w ON w.doc_id = b.doc_id AND w.i = b.i),
c AS (SELECT doc_id, list_reduce(list_concat([{start}], list(e ORDER BY i)), lambda p, q: {pack}) AS r FROM e GROUP BY doc_id),
d AS (SELECT doc_id, list_filter(list_transform(list_append(r.done, r.held), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS c FROM c),
o AS (SELECT doc_id, unnest(range(0, len(c))) AS i, unnest(c) AS chunk FROM d)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, chunk, {count('chunk')} AS tokens FROM o"""
    return {
        "join_tokens": f"WITH l AS ({LINES}), a AS (SELECT doc_id, line_no, list_concat([''], regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) AS t FROM l) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, list_reduce(t, lambda a, b: {step}) AS joined FROM a",
        "clean_summary_sentence": f"SELECT conv_id, turn, {clean} AS sentence FROM conversations",
        "summary_prompt": f"SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), text, {ask.format(n=3)})) AS plain, md5(concat_ws(chr(10) || chr(10), text, {labels}, {ask.format(n=5)})) AS labelled FROM conversations",
        "format_bytes": "WITH a AS (SELECT doc_id, n_chars * n_chars * [1, 77, 7777][doc_id % 3 + 1] * 2 + 1 AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.0f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM a",
        "reference_headings": f"WITH l AS ({LINES}), a AS (SELECT doc_id, line_no, lower(trim(regexp_replace({HEADINGS}[length(text) % 10 + 1], '\\s+', ' ', 'g'))) AS h FROM l) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, h IN {REFERENCE} AS opens, h IN {AFTER} AS ends FROM a",
        "reference_pages": f"""WITH l AS ({LINES}), m AS (SELECT doc_id, line_no // 8 AS page, CASE WHEN length(text) % 3 = 0 THEN '[' || length(text) || '] Smith, J. A., Journal of Things ' || (1900 + length(text) % 100) WHEN length(text) % 11 = 0 THEN 'References' WHEN length(text) % 13 = 0 THEN ' ' ELSE text END AS text FROM l),
s AS (SELECT doc_id, page, {normal('text')} AS s FROM m), c AS (SELECT *, s <> '' AND lower(s) NOT IN {REFERENCE} AS content FROM s),
n AS (SELECT doc_id, page, count(*) FILTER (content) AS n, count(*) FILTER (content AND {_entry('s')}) AS hits, count(*) FILTER (content AND {_has('s', r"\b(?:18|19|20)[0-9]{2}[a-z]?\b")}) AS years FROM c GROUP BY ALL)
SELECT doc_id, CAST(page AS INTEGER) AS page_index, n >= 6 AND hits >= 4 AND (hits / n >= 0.28 OR years / n >= 0.45) AS is_reference FROM n""",
        "body_of_sections": f"WITH {sectioned}, b AS (SELECT doc_id, sentence_no FROM ({BODY_SELECT})) SELECT t.doc_id, t.sentence_no, section FROM t JOIN b USING (doc_id, sentence_no) WHERE NOT front AND section <> 'References'",
        "paper_text_of_sections": f"WITH {sectioned} SELECT doc_id, md5(substr({normal("string_agg(text, ' ' ORDER BY sentence_no)")}, 1, 128000)) AS text_md5 FROM t WHERE section <> 'Abstract' AND NOT front GROUP BY doc_id",
        "sparse_summary_similarity": similar,
        "mmr_sections_k3": sections,
        "mmr_coverage_k2": coverage,
        "pages_from_arrays": arrays,
        "layout_lines": f"WITH {pieces} SELECT doc_id, CAST(line_no // 60 AS INTEGER) AS page_index, CAST(row_number() OVER (PARTITION BY doc_id, line_no // 60 ORDER BY line_no) - 1 AS INTEGER) AS line, list_reduce(list_concat([''], w), lambda a, b: {step}) AS text, round(x1, 4) AS x_left, round(x2, 4) AS x_right FROM w WHERE len(w) > 0",
        "layout_rows": f"WITH {pieces} SELECT doc_id, CAST(line_no // 60 AS INTEGER) AS page_index, CAST(row_number() OVER (PARTITION BY doc_id, line_no // 60 ORDER BY line_no) - 1 AS INTEGER) AS row, x1, 770.0::DOUBLE - line_no % 60 * 12 AS y1, x2, 780.0::DOUBLE - line_no % 60 * 12 AS y2 FROM w WHERE len(w) > 0",
        "annotation_comments": f"WITH {TOP} SELECT doc_id, text, substr(md5(doc_id || '|' || sentence_no || '|' || text), 1, 8) AS key, 'highlight' AS type, CASE WHEN length(text) % 3 = 0 THEN CASE WHEN length(text) % 5 = 0 THEN '' ELSE 'Found' END || '. ' ELSE '' END || 'Section: ' || CASE WHEN length(text) % 2 = 0 THEN 'methods' ELSE 'unclassified' END || '. Score: ' || printf('%.3f', 0.001::DOUBLE * (length(text) % 997)) || '.' AS comment, 0 AS page_index, 36.0::DOUBLE + length(text) AS x2 FROM top",
        "chunk_by_tokens": chunks,
    }


#: What is kept of sentences where nothing but their text counts.
BODY_SELECT = f"WITH {BODY} SELECT doc_id, sentence_no FROM body"

"""The queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions import text as T
from ..functions.config import DEFAULT_LABELS, parse_labels

SPACE = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    """A pattern with RE2's ASCII word boundary for the look-around one."""
    for boundary in (P.B, P.START, P.STOP):
        pattern = pattern.replace(boundary, r"\b")
    return _q(pattern)


def _list(items) -> str:
    return "(" + ", ".join(map(_q, items)) + ")"


def normal(x: str) -> str:
    x = f"replace(coalesce({x}, ''), chr(173), '')"
    for sign, letters in T.LIGATURES.items():
        x = f"replace({x}, '{sign}', '{letters}')"
    x = rf"regexp_replace({x}, '([A-Za-z])-{SPACE}+([a-z])', '\1\2', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[‘’]', '''', 'g'), '[“”]', '\"', 'g')"
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'), ' ')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), {_q(T.TOKEN)}), lambda t: t NOT IN {_list(P.STOP_WORDS)} AND length(t) > 1)"


def _sentences(x: str) -> str:
    words = "|".join(a[:-1].replace(".", r"\.") for a in P.ABBREVIATIONS)
    x = rf"regexp_replace({x}, '(?i)({words})\.', '\1' || chr(30), 'g')"
    x = rf"""regexp_replace({x}, '([.!?])["'')\]}}]* +([A-Z0-9\[(])', '\1' || chr(31) || '\2', 'g')"""
    x = rf"""regexp_replace({x}, '([.!?])["'')\]}}]* *$', '\1')"""
    return f"list_filter(list_transform(string_split({x}, chr(31)), lambda s: replace(s, chr(30), '.')), lambda s: s <> '')"


N_WORDS = "len(list_filter(string_split(n, ' '), lambda w: w <> ''))"


def _entry(s: str) -> str:
    y, lo, m, c, a = (f"regexp_matches({s}, {_re(p)})" for p in (P.YEAR, P.LOCATOR, P.MARKER, P.CITATION, P.AUTHOR))
    return f"(length({s}) >= 8 AND (({a} AND ({y} OR {lo} OR {c})) OR ({m} AND ({y} OR {lo} OR {c} OR {a})) OR ({lo} AND ({y} OR {c} OR len(string_split({s}, ' ')) <= 12)) OR regexp_matches({s}, {_re(P.NAME_YEAR)}) OR ({y} AND {c})))"


def _noise(s: str) -> str:
    has = lambda p: f"regexp_matches({s}, {_re(p)})"
    n = f"len(list_filter(string_split({s}, ' '), lambda w: w <> ''))"
    tests = {
        "back_matter": has(P.BACK_MATTER), "reference": _entry(s), "word_count": f"{n} < 5 OR {n} > 90",
        "digits": f"length(regexp_replace({s}, '[^0-9]', '', 'g')) / greatest(1, length({s})) > 0.28", "caption": has(P.CAPTION),
        "numeric": f"len(regexp_extract_all({s}, {_re(P.NUMERIC)})) >= 5 AND NOT {has(P.PREDICATE)}", "numbered_year": has(P.NUMBERED_YEAR),
        "publisher": has(P.PUBLISHER), "email": has(P.EMAIL), "symbols": has(P.SYMBOLS), "name_list": f"{has(P.NAME_LIST)} AND {n} < 14",
    }
    return "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in tests.items()) + " END"


def _heading(x: str) -> str:
    """Needs a column s (normalised) and title."""
    known = _re(f"(?i)^(?:{'|'.join(P.SECTIONS)})$")
    alpha = "regexp_extract_all(title, '[A-Za-z][A-Za-z-]*')"
    content = f"list_filter({alpha}, lambda w: lower(w) NOT IN {_list(P.CONNECTORS)})"
    return f"""CASE WHEN s = '' OR length(s) > 90 THEN NULL WHEN regexp_matches(s, {known}) THEN lower(s)
      WHEN NOT regexp_matches(s, '{NUMBER}') OR title = '' OR len(string_split(title, ' ')) > 12 OR regexp_matches(title, '[:!?]$') THEN NULL
      WHEN regexp_matches(title, {known}) THEN lower(title)
      WHEN len({content}) > 0 AND len(list_filter({content}, lambda w: regexp_matches(w, '^[A-Z]'))) / len({content}) >= 0.65 THEN lower(title) END"""


NUMBER = r"^[0-9]+(?:\.[0-9]+)*[.)]?\s+(.+)$"
TITLE = f"regexp_replace({normal(f"regexp_extract(s, '{NUMBER}', 1)")}, '[.]$', '')"
LINES = "SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
SENT = f"""s0 AS (SELECT doc_id, {_sentences(normal('text'))} AS l FROM documents),
sent AS (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS sentence_no, unnest(l) AS text FROM s0)"""
BODY = f"{SENT},\nbody AS (SELECT * FROM (SELECT *, {normal('text')} AS n FROM sent) WHERE {_noise('n')} IS NULL)"
TF = f"""{BODY},
w AS (SELECT doc_id, sentence_no, {tokens('n')} AS t FROM body),
e0 AS (SELECT doc_id, sentence_no, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '__' || t[i + 1])) AS t FROM w),
e AS (SELECT doc_id, sentence_no, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM e0),
tf AS (SELECT doc_id, sentence_no, term, count(*) AS tf, min(pos) AS pos FROM e GROUP BY ALL)"""
DF = f"{TF},\ndf AS (SELECT doc_id, term, count(*) AS df, min((sentence_no, pos)) AS first FROM tf GROUP BY doc_id, term),\nn AS (SELECT doc_id, count(*) AS n FROM body GROUP BY doc_id)"
VOCAB = f"{DF},\nvocab AS (SELECT * FROM (SELECT doc_id, term, df, n, row_number() OVER (PARTITION BY doc_id ORDER BY df DESC, first) AS rank FROM df JOIN n USING (doc_id) WHERE df <= n * 0.96) WHERE rank <= 16000)"
TFIDF = f"{VOCAB},\nv AS (SELECT tf.doc_id, sentence_no, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS value FROM tf JOIN vocab USING (doc_id, term))"
NORMS = f"{TFIDF},\nnorms AS (SELECT doc_id, sentence_no, sqrt(sum(value * value)) AS norm FROM v GROUP BY ALL)"
LENGTH = "exp(-pow(len(string_split(text, ' ')) - 18, 2) / 288)"
IMPORTANCE = f"""{BODY},
ls AS (SELECT *, {LENGTH} AS l FROM body),
imp AS (SELECT *, 0.85 * 0.5 + 0.15 * CASE WHEN max(l) OVER w = min(l) OVER w THEN 0.5 ELSE (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w) END AS importance, count(*) OVER w AS cnt FROM ls WINDOW w AS (PARTITION BY doc_id))"""
K = "CAST(greatest(1, floor(cnt / 10 + 0.5)) AS INTEGER)"
TOP = f"{IMPORTANCE},\ntop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(importance, 9) DESC, sentence_no) AS rank FROM imp) WHERE rank <= {K})"
WORDS = """parts AS (SELECT doc_id, line_no, string_split(text, ' ') AS p FROM lines),
words AS (SELECT doc_id, line_no, i - 1 AS part, p[i] AS word, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0) AS off FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts) WHERE p[i] <> '')"""


def _page_words(per_page: int) -> str:
    return f"""lines AS ({LINES}), {WORDS},
pw AS (SELECT doc_id, line_no // {per_page} AS page_index, line_no, line_no * 4294967296 + part AS word_pos, word AS text, 36.0::DOUBLE + off * 6 AS x1, 780.0::DOUBLE - line_no % {per_page} * 12 - 10 AS y1, 36.0::DOUBLE + off * 6 + length(word) * 6 AS x2, 780.0::DOUBLE - line_no % {per_page} * 12 AS y2 FROM words)"""


def _cos(a: str, b: str) -> str:
    d = lambda x: f"list_transform({x}, lambda q: q::DOUBLE)"
    return f"(list_inner_product({d(a)}, {d(b)}) / (sqrt(list_inner_product({d(a)}, {d(a)})) * sqrt(list_inner_product({d(b)}, {d(b)}))))"


PROTOS = "protos AS (SELECT label AS pos, embedding AS p FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))"


def _mmr(k: int) -> str:
    """k rounds of greedy selection, each a few common tables."""
    out = [f"""WITH {NORMS},
{IMPORTANCE.removeprefix(BODY + ",").strip()},
u AS MATERIALIZED (SELECT v.doc_id, v.sentence_no, term, value / norm AS value FROM v JOIN norms USING (doc_id, sentence_no) WHERE norm > 0),
b1 AS MATERIALIZED (SELECT doc_id, sentence_no, importance, 0.0::DOUBLE AS worst, 0 AS used FROM imp)"""]
    for i in range(1, k + 1):
        out.append(f"r{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(0.65 * importance - 0.35 * worst - 0.06 * used, 9) DESC, sentence_no) AS r FROM b{i})")
        if i < k:
            out.append(f"c{i} AS MATERIALIZED (SELECT u.doc_id, u.sentence_no, sum(u.value * x.value) AS cos FROM u JOIN (SELECT u.* FROM u JOIN r{i} USING (doc_id, sentence_no) WHERE r = 1) x ON u.doc_id = x.doc_id AND u.term = x.term GROUP BY ALL)")
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT r{i}.doc_id, r{i}.sentence_no, importance, greatest(worst, coalesce(cos, 0)) AS worst, used + 1 AS used FROM r{i} LEFT JOIN c{i} USING (doc_id, sentence_no) WHERE r > 1)")
    picks = " UNION ALL ".join(f"SELECT doc_id, sentence_no, {i} AS pick FROM r{i} WHERE r = 1" for i in range(1, k + 1))
    return ",\n".join(out) + "\n" + picks


def sql() -> dict[str, str]:
    labels = {x["name"].strip("[]"): x["color"] for x in parse_labels(DEFAULT_LABELS)}
    profile = f"""WITH {_page_words(12)},
l AS (SELECT doc_id, line_no, list((text, x1, x2 - CASE WHEN length(text) % 4 = 0 THEN 20 ELSE 0 END) ORDER BY word_pos) AS w, string_agg(text, ' ' ORDER BY word_pos) AS t FROM pw GROUP BY doc_id, line_no),
m AS (SELECT *, list_filter(list_transform(w, lambda x: {normal('x[1]')}), lambda x: x <> '') AS tok, len(list_filter(range(2, len(w) + 1), lambda i: w[i][2] - w[i - 1][3] > 18)) + 1 AS cells FROM l),
p AS (SELECT doc_id, line_no, CAST(cells AS INTEGER) AS cell_count, len(list_filter(tok, lambda x: regexp_matches(x, '(?i)^(?:[<>~=+-]?[0-9][0-9.,:%()*/-]*|n/?a|nan|yes|no)$'))) / greatest(1, len(tok)) AS nr, len(list_filter(tok, lambda x: length(x) <= 5)) / greatest(1, len(tok)) AS sr,
  regexp_matches(t, '[.!?]["'')\\]}}]?$') AND regexp_matches(t, '(?i)\\b(?:is|are|was|were|has|have|shows?|indicates?|suggests?|we|this|the)\\b') AS sentence_like, CAST(len(tok) AS INTEGER) AS token_count FROM m)
SELECT doc_id, line_no, cell_count, round(nr, 6) AS numeric_ratio, round(sr, 6) AS short_ratio, sentence_like, token_count, NOT sentence_like AND (cell_count >= 4 OR (cell_count >= 3 AND (nr >= 0.10 OR sr >= 0.45)) OR (cell_count >= 2 AND nr >= 0.38 AND token_count >= 4)) AS table_like FROM p"""
    margin = f"""WITH {_page_words(12)},
q AS (SELECT doc_id, page_index, text, y2 - 638 > 142 * 0.92 OR y1 - 638 < 142 * 0.08 AS near_margin, regexp_replace(lower({normal('text')}), '[0-9]+', '#', 'g') AS s FROM pw),
z AS (SELECT *, CASE WHEN near_margin AND length(s) >= 4 THEN s END AS sig FROM q),
np AS (SELECT doc_id, count(DISTINCT page_index) AS n FROM pw GROUP BY doc_id),
h AS (SELECT doc_id, sig, count(*) AS hits FROM z WHERE sig IS NOT NULL GROUP BY ALL)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (near_margin) AS n_margin, count(*) FILTER (n >= 4 AND hits >= greatest(3, ceil(n * 0.35))) AS n_repeated FROM z JOIN np USING (doc_id) LEFT JOIN h USING (doc_id, sig) GROUP BY doc_id"""
    entries = rf"""WITH c AS (SELECT conv_id, turn, (turn + 1) || '. ' || ['[method]', '[result]', '[goal]', '[other]'][turn % 4 + 1] || ' ' || regexp_replace(text, '[\[\]]', '', 'g') AS a FROM conversations),
x AS (SELECT conv_id, turn, regexp_extract(a, '\[([a-z-]+)\]', 1) AS l, {normal(r"regexp_replace(regexp_extract(a, '(?s)\[[a-z-]+\]\s*(.*)$', 1), '^\s*[0-9]+\.\s*', '')")} AS s FROM c),
y AS (SELECT conv_id, turn, '[' || l || ']' AS label, s AS sentence, 0 AS k FROM x WHERE s <> '' AND l <> 'other' UNION ALL SELECT conv_id, turn, '[result]', 'Done.', 1 FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS INTEGER) AS pos, label, sentence FROM y"""
    color = "CASE WHEN length(text) % 2 = 0 THEN '#12ab9f' WHEN length(text) % 3 = 0 THEN '" + labels["result"] + "' ELSE '#aaaaaa' END"
    return {
        "normalize_text": f"SELECT doc_id, {normal('text')} AS normal FROM documents",
        "tokenize": f"SELECT doc_id, array_to_string({tokens(normal('text'))}, ' ') AS tokens FROM documents",
        "sentence_split": f"WITH {SENT} SELECT doc_id, sentence_no, text FROM sent",
        "detect_heading": f"WITH l AS ({LINES}), a AS (SELECT *, {normal('text')} AS s FROM l), b AS (SELECT *, {TITLE} AS title FROM a) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {_heading('s')} AS heading FROM b",
        "section_carry_forward": f"WITH l AS ({LINES}), a AS (SELECT doc_id, line_no, {normal("CASE WHEN length(text) % 7 = 0 THEN '2.1 Results And Table ' || length(text) ELSE text END")} AS s FROM l), b AS (SELECT *, {TITLE} AS title FROM a), c AS (SELECT doc_id, line_no, {_heading('s')} AS heading FROM b) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM c",
        "reference_entry": f"WITH {SENT}, a AS (SELECT *, {normal('text')} AS n FROM sent) SELECT doc_id, sentence_no, regexp_matches(n, {_re(P.YEAR)}) AS has_year, regexp_matches(n, {_re(P.LOCATOR)}) AS has_locator, regexp_matches(n, {_re(P.MARKER)}) AS has_marker, regexp_matches(n, {_re(P.CITATION)}) AS has_citation, {_entry('n')} AS is_entry FROM a",
        "noise_reason": f"WITH {SENT}, a AS (SELECT *, {normal('text')} AS n FROM sent) SELECT doc_id, sentence_no, {_noise('n')} AS reason FROM a",
        "front_back_matter_lines": f"WITH l AS ({LINES}), a AS (SELECT *, {normal('text')} AS s FROM l) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, s = '' OR (NOT regexp_matches(s, '(?i)^(?:abstract|introduction)\\b') AND (regexp_matches(s, {_re(P.FRONT_VOCABULARY)}) OR regexp_matches(s, {_re(P.EMAIL)}) OR regexp_matches(s, '(?i)^(?:article|research article|original article|algorithms?)$') OR regexp_matches(s, '^\\s*©|(?i:all rights reserved)'))) AS front, regexp_matches(s, {_re(P.BACK_MATTER)}) AS back, regexp_matches(s, {_re(P.TABLE_CAPTION)}) AS caption FROM a",
        "token_estimate": r"SELECT conv_id, turn, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'), lambda u: CASE WHEN regexp_matches(u, '^[\p{L}\p{N}]') THEN ceil(length(u) / 3) ELSE 1 END)), 0) AS BIGINT) AS tokens FROM conversations",
        "chunk_by_sentences": r"WITH a AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*|.+$') AS s FROM documents), b AS (SELECT doc_id, list_filter(list_transform(range(0, CAST(ceil(len(s) / 10) AS BIGINT)), lambda g: trim(array_to_string(s[g * 10 + 1:g * 10 + 10], ' '), ' ')), lambda c: c <> '') AS c FROM a) SELECT doc_id, CAST(unnest(range(0, len(c))) AS INTEGER) AS chunk_no, unnest(c) AS chunk FROM b",
        "map_budget_windows": "WITH a AS (SELECT doc_id, n_chars, greatest(128, least(512, n_chars // 2)) AS reserve FROM documents) SELECT doc_id, reserve, greatest(1, n_chars - reserve) AS input, greatest(32, least(400, reserve - 80)) AS output FROM a",
        "labeled_summary_parse": entries,
        "paper_text": f"WITH {BODY} SELECT doc_id, md5(substr({normal("string_agg(text, ' ' ORDER BY sentence_no)")}, 1, 128000)) AS text_md5 FROM body GROUP BY doc_id",
        "term_frequency": f"WITH {TF} SELECT doc_id, sentence_no, term, tf FROM tf",
        "document_frequency": f"WITH {DF} SELECT doc_id, term, df FROM df",
        "vocab_topk": f"WITH {VOCAB} SELECT doc_id, term, df, n, CAST(rank AS INTEGER) AS rank FROM vocab",
        "tfidf": f"WITH {TFIDF} SELECT doc_id, sentence_no, term, round(value, 6) AS value FROM v",
        "sparse_norms": f"WITH {NORMS} SELECT doc_id, sentence_no, round(norm, 6) AS norm FROM norms",
        "sparse_cosine_pairs": f"WITH {NORMS}, d AS (SELECT a.doc_id, a.sentence_no AS x, b.sentence_no AS y, sum(a.value * b.value) AS dot FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sentence_no < b.sentence_no GROUP BY ALL), c AS (SELECT d.doc_id, x, dot / (n1.norm * n2.norm) AS cosine FROM d JOIN norms n1 ON n1.doc_id = d.doc_id AND n1.sentence_no = x JOIN norms n2 ON n2.doc_id = d.doc_id AND n2.sentence_no = y) SELECT doc_id, x AS sentence_no, count(*) AS n_pairs, round(max(cosine), 6) AS most, round(sum(cosine), 4) AS total FROM c GROUP BY doc_id, x",
        "centroid": f"WITH {TFIDF} SELECT v.doc_id, term, round(sum(value) / any_value(n.n), 6) AS value FROM v JOIN n USING (doc_id) GROUP BY v.doc_id, term",
        "length_score": f"WITH {BODY} SELECT doc_id, sentence_no, round({LENGTH}, 6) AS score FROM body",
        "minmax_importance": f"WITH {IMPORTANCE} SELECT doc_id, sentence_no, round(importance, 6) AS importance FROM imp",
        "annotation_target": f"WITH {BODY}, c AS (SELECT doc_id, count(*) AS cnt FROM body GROUP BY doc_id), k AS (SELECT *, {K} AS k FROM c), s AS (SELECT *, CAST(greatest(3, floor(k * 1.5 + 0.5)) AS INTEGER) AS s FROM k) SELECT doc_id, cnt AS n, k, s AS summary_sentences, CAST(least(1000, greatest(120, s * 30)) AS INTEGER) AS output_tokens FROM s",
        "baseline_topk": f"WITH {TOP} SELECT doc_id, sentence_no, CAST(rank AS INTEGER) AS rank, round(round(importance, 9), 6) AS importance, text FROM top",
        "shortlist": f"WITH {IMPORTANCE} SELECT doc_id, sentence_no, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(importance, 9) DESC, sentence_no) AS rank FROM imp) WHERE rank <= least(cnt, greatest({K} * 4, 60), 160)",
        "mmr_k3": _mmr(3),
        "mmr_k2_joins": _mmr(2),
        "similarity_matrix_stats": f"WITH {PROTOS}, c AS (SELECT CAST(label AS BIGINT) AS doc_id, {_cos('embedding', 'p')} AS x FROM embeddings, protos) SELECT doc_id, round(stddev_pop(x), 6) AS deviation, round(stddev_pop(x) * 0.1, 6) AS penalty FROM c GROUP BY doc_id",
        "nearest_label": f"WITH {PROTOS}, c AS (SELECT vec_id AS id, pos AS label, {_cos('embedding', 'p')} AS score FROM embeddings, protos) SELECT id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM c) WHERE r = 1",
        "dense_summary_similarity": f"WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL), s AS (SELECT label, list(x ORDER BY i) AS p FROM m GROUP BY label) SELECT vec_id, round({_cos('embedding', 'p')}, 6) AS similarity FROM embeddings JOIN s USING (label)",
        "fragment_split": f"""WITH l AS ({LINES}), a AS (SELECT doc_id, line_no, {normal('text')} AS s, 6.0::DOUBLE * length(text) AS w FROM l), b AS (SELECT doc_id, line_no, string_split(s, ' ') AS p, greatest(0.1, w) AS w, w AS raw FROM a WHERE s <> ''),
c AS (SELECT *, list_sum(list_transform(p, lambda x: greatest(1, length(x)))) + (len(p) - 1) * 0.55::DOUBLE AS u, unnest(range(0, len(p))) AS pos FROM b),
d AS (SELECT *, CASE WHEN len(p) = 1 THEN 36.0::DOUBLE ELSE 36 + w * (coalesce(list_sum(list_transform(p[1:pos], lambda x: greatest(1, length(x)))), 0) + pos * 0.55::DOUBLE) / u END AS l FROM c)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(pos AS INTEGER) AS pos, p[pos + 1] AS word, round(l + 0.0000314159, 3) AS x_left, round(CASE WHEN pos = len(p) - 1 THEN 36 + raw ELSE least(36 + raw, l + w * greatest(1, length(p[pos + 1])) / u) END + 0.0000314159, 3) AS x_right FROM d""",
        "layout_words": f"WITH {_page_words(12)} SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, CAST(word_pos AS BIGINT) AS word_pos, text, x1, y1, x2, y2 FROM pw",
        "margin_signature_filter": margin,
        "reading_order_bands": f"""WITH l AS ({LINES}), a AS (SELECT doc_id, CAST(line_no // 40 AS INTEGER) AS page_index, CAST(line_no AS INTEGER) AS line, 780.0 - line_no % 40 * 12 AS cy, length(text) * 7 % 400 + 36 AS lf, length(text) * 7 % 400 + 36 + length(text) % 300 AS rt FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY cy DESC, lf, line) AS v, CAST(lf >= 612 * 0.48 AS INTEGER) AS side, CAST(lf < 612 * 0.42 AND rt > 612 * 0.58 AS INTEGER) AS span FROM a),
c AS (SELECT *, sum(1 - side) OVER p >= 2 AND sum(side) OVER p >= 2 AS two, sum(span) OVER (PARTITION BY doc_id, page_index ORDER BY v ROWS UNBOUNDED PRECEDING) AS band FROM b WINDOW p AS (PARTITION BY doc_id, page_index))
SELECT doc_id, page_index, line, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE WHEN two THEN band ELSE 0 END, CASE WHEN two THEN 1 - span ELSE 0 END, CASE WHEN two THEN side ELSE 0 END, v) - 1 AS INTEGER) AS place FROM c""",
        "table_line_profile": profile,
        "span_overlap_join": f"""WITH a AS (SELECT doc_id, {normal('text')} AS t FROM documents), w AS (SELECT doc_id, string_split(t, ' ') AS p FROM a), x AS (SELECT doc_id, unnest(range(0, len(p))) AS i, unnest(p) AS word FROM w),
e AS (SELECT doc_id, length(word) AS n, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS stop FROM x),
k AS (SELECT doc_id, unnest(range(0, length(t) // 200 + 1)) AS window_no FROM a)
SELECT k.doc_id, CAST(window_no AS INTEGER) AS window_no, count(*) AS n_words FROM k JOIN e ON k.doc_id = e.doc_id AND stop > window_no * 200 AND stop - n < window_no * 200 + 200 GROUP BY ALL""",
        "first_pdf_per_item": "WITH a AS (SELECT o_orderkey AS item_id, o_orderkey AS attachment_id FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem WHERE l_quantity > 20) JOIN orders ON o_orderkey = l_orderkey WHERE r = 1 AND o_orderkey % 5 <> 0) SELECT min(item_id) AS item_id, attachment_id FROM a GROUP BY attachment_id",
        "document_title": "SELECT doc_id AS attachment_id, coalesce(nullif(CASE WHEN item_id % 2 = 0 THEN substr(b.text, 1, 20) END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(CASE WHEN doc_id % 5 <> 0 THEN source END, ''), 'PDF') AS title FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40",
        "existing_annotation_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "delete_auto_annotations": "SELECT doc_id, 'x,mine' AS tags FROM labels WHERE quality <> 1 AND toxic <> 1",
        "sort_index": f"WITH {_page_words(60)} SELECT doc_id, CAST(word_pos AS BIGINT) AS word_pos, lpad(CAST(least(page_index, 99999) AS VARCHAR), 5, '0') || '|' || lpad(CAST(CAST(least(greatest(floor((792 - y2) * 100 + 0.5), 0), 999999) AS BIGINT) AS VARCHAR), 6, '0') || '|' || lpad(CAST(CAST(least(floor(x1 * 100 + 0.5), 99999) AS BIGINT) AS VARCHAR), 5, '0') AS sort_index FROM pw",
        "annotation_records": f"WITH {TOP} SELECT doc_id, text, {color} AS color, '1' AS page_label, '00000|008200|03600' AS sort_index, 'autoskim-key-sentence' || CASE WHEN length(text) % 3 = 0 THEN ',result' ELSE '' END AS tags FROM top",
    }

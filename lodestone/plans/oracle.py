"""SQL that says what the registered queries compute, for an independent engine."""

from __future__ import annotations

from ..functions.docstrings import CLASS_KINDS, DUNDERS, VERBS
from ..operators.features import STOP_WORDS
from .samples import NAMES

SQL: dict[str, str] = {}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else _text(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_WORDS = r"[w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']"
_LOWER = r"[w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> '']"

SQL["doc_word_counts"] = f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, len({_WORDS}) >= 40 AS kept FROM documents"

SQL["section_split"] = r"""
WITH th AS (
  SELECT conv_id, string_agg('## ' || role || ' ' || CAST(turn AS VARCHAR) || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id
), ln AS (
  SELECT conv_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT conv_id, string_split(text, chr(10)) AS l FROM th)
), hd AS (
  SELECT *, regexp_matches(line, '^\s*(##|###)\s+(.*\S)\s*$') AS is_head FROM ln
), nb AS (
  SELECT *, sum(CAST(is_head AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY i) AS s FROM hd
), se AS (
  SELECT conv_id, s, max(CASE WHEN is_head THEN regexp_extract(line, '^\s*(##|###)\s+(.*\S)\s*$', 2) END) AS title,
         regexp_replace(coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY i), ''), '^\n+|\n+$', '', 'g') AS text
  FROM nb WHERE s > 0 GROUP BY conv_id, s
), kept AS (
  SELECT * FROM se WHERE len([w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']) >= 10
)
SELECT row_number() OVER (ORDER BY conv_id, s) - 1 AS index, conv_id AS parent_index, CAST(s - 1 AS BIGINT) AS position, title, text FROM kept
"""

_clean = "x"
for _p, _to in ((r":\w+:`([^`]+)`", r"\1"), (r"`([^`<]+?)\s*<[^>`]+>`_", r"\1"), (r"`([^`]+?)`_", r"\1"), (r"``([^`]+)``", r"\1"), (r"\|[^|\s]+\|", ""), (r"\s+", " ")):
    _clean = f"regexp_replace({_clean}, {_text(_p)}, {_text(_to)}, 'g')"
SQL["inline_cleanup"] = f"""
WITH l AS (SELECT doc_id, [trim({_clean}) FOR x IN string_split(text, chr(10))] AS c FROM documents)
SELECT doc_id, regexp_replace(array_to_string([c[i] FOR i IN range(1, len(c) + 1) IF c[i] <> '' OR i = 1 OR c[i - 1] <> ''], chr(10)), '^\\s+|\\s+$', '', 'g') AS clean FROM l
"""

SQL["strip_orphans"] = r"SELECT doc_id, chr(10) || text || chr(10) || 'end' AS clean FROM documents"

SQL["title_sanitize"] = r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS title FROM documents"

SQL["code_tokenize_text"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')[1:512] AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, ' ') AS tokens FROM t
"""

SQL["summaries"] = r"""
SELECT doc_id, coalesce(substr([s FOR s IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(text, chr(10))] IF s <> ''][1], 1, 256), '') AS summary,
       md5(text) AS hash FROM documents
"""

SQL["display_string"] = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source <> '' THEN source WHEN doc_id % 3 = 1 AND lang <> '' THEN lang
  WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' WHEN text <> '' THEN text ELSE 'path' END AS display FROM documents
"""

_escape = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
SQL["viewer_search"] = f"SELECT doc_id, {_escape.format('text')} AS escaped FROM documents WHERE contains(lower(source || ' ' || text), 'than')"

SQL["html_cards"] = f"""
SELECT doc_id, '<article class="entry" id="entry-' || doc_id || '"><h2>' || {_escape.format("source")} || '</h2><pre>' || {_escape.format("text")}
  || '</pre><a href="#entry-' || (doc_id + 1) || '">next</a></article>' AS card FROM documents
"""

_unescape = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&')"
_inner = lambda tag: "regexp_replace(" + _unescape.format(f"regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1), '(?s)<[^>]*>', '', 'g')") + ", '^\\s+|\\s+$', '', 'g')"
SQL["html_title"] = f"SELECT page_id, coalesce(nullif({_inner('h1')}, ''), {_inner('title')}, '') AS title FROM pages"

SQL["html_links"] = r"""
WITH l AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
p AS (
  SELECT *, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) AS scheme,
         regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM l
), t AS (
  SELECT href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || href
    WHEN starts_with(href, '/') THEN origin || href
    WHEN starts_with(href, '../') THEN origin || CASE WHEN regexp_replace(folder, '[^/]+/$', '') = '' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END || regexp_replace(href, '^\.\./', '')
    ELSE origin || CASE WHEN folder = '' THEN '/' ELSE folder END || regexp_replace(href, '^\./', '') END AS target FROM p
)
SELECT target, count(*) AS n,
  count(*) FILTER (NOT contains(href, '#') AND starts_with(target, 'http') AND NOT (suffix(target, '.txt') OR suffix(target, '.rst') OR contains(target, '_sources') OR contains(target, '_images'))) AS n_admitted,
  count(*) FILTER (suffix(target, '.html') AND NOT suffix(target, 'index.html')) AS n_pages
FROM t GROUP BY target
"""

SQL["url_filter"] = r"""
WITH r AS (
  SELECT page_id, url, regexp_replace(regexp_replace(CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END, '\.html$', ''), '^/+|/+$', '', 'g') AS rel
  FROM pages WHERE NOT contains(lower(url), '/fr/') AND NOT contains(lower(url), 'blog.')
)
SELECT page_id, rel, replace(url, 'https://', '') AS file FROM r
WHERE (starts_with(rel, 'www.') OR starts_with(rel, 'th') OR starts_with(rel, 'm.')) AND NOT starts_with(rel, 'm.th')
"""

SQL["crawl_frontier"] = """
WITH RECURSIVE r(n, depth) AS (
  SELECT CAST(0 AS BIGINT), 0 UNION
  SELECT 2 * r.n + k.k, r.depth + 1 FROM r JOIN pages p ON p.page_id = r.n JOIN (VALUES (1), (2)) k(k) ON true
)
SELECT 'https://site.example/' || n || '.html' AS url, CAST(depth AS INTEGER) AS depth FROM r
"""

SQL["source_fetch"] = r"""
WITH d AS (SELECT doc_id, text AS t FROM documents),
raw AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN t ELSE ' short ' END AS t FROM d WHERE doc_id % 2 = 0),
j AS (
  SELECT p.page_id, raw.t AS rst, s.t AS other, length(regexp_replace(coalesce(raw.t, ''), '^\s+|\s+$', '', 'g')) < 10 AS poor,
         length(regexp_replace(coalesce(s.t, ''), '^\s+|\s+$', '', 'g')) > 0 AS there
  FROM pages p LEFT JOIN raw ON raw.doc_id = p.page_id LEFT JOIN d s ON s.doc_id = p.page_id AND s.doc_id % 3 = 0
)
SELECT page_id, CASE WHEN NOT poor THEN rst WHEN there THEN other ELSE coalesce(rst, '') END AS rst_text,
  CASE WHEN poor AND there THEN 'sources' ELSE 'raw' END AS source_used, CASE WHEN NOT poor THEN 'ok' WHEN there THEN 'ok_sources' ELSE 'missing' END AS status FROM j
"""

SQL["unique_urls"] = "SELECT DISTINCT url FROM pages"

SQL["answered_threads"] = """
WITH f AS (
  SELECT conv_id, min_by(text, turn) FILTER (role = 'assistant') AS answer, list(text ORDER BY turn)[1:20] AS c FROM conversations GROUP BY conv_id
), k AS (
  SELECT conv_id FROM f WHERE answer IS NOT NULL AND len([x FOR x IN c IF contains(lower(x), 'than') OR contains(lower(x), 'der ')]) > 0 ORDER BY conv_id DESC LIMIT 50
)
SELECT row_number() OVER (ORDER BY conv_id DESC) - 1 AS index, conv_id FROM k
"""

SQL["discussion_text"] = r"""
WITH f AS (
  SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS b, min_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id
)
SELECT conv_id AS index, 'thread ' || conv_id AS path, 'thread ' || conv_id AS title,
  regexp_replace('thread ' || conv_id || chr(10) || ' ' || coalesce(b, '') || ' ' || chr(10) || ' Answer: ' || coalesce(a, ''), '^\s+|\s+$', '', 'g') AS text FROM f
"""

SQL["corpus_union"] = r"""
SELECT CAST(0 AS INTEGER) AS dataset, doc_id AS index, 'docs' AS source_type, source AS path, CAST(NULL AS VARCHAR) AS title, md5(source || ' ' || text) AS text_md5 FROM documents
UNION ALL SELECT 1, page_id, 'docs', url, NULL, md5(url || ' ' || html) FROM pages
UNION ALL SELECT 2, conv_id * 1000 + turn, 'discussion', role, role,
  md5(regexp_replace(role || chr(10) || ' ' || text || ' ' || chr(10) || ' Answer: ', '^\s+|\s+$', '', 'g')) FROM conversations
"""

SQL["capped_corpus"] = """
WITH d AS (SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 1100), g AS (SELECT id FROM d WHERE id % 10 <> 3)
SELECT CAST(0 AS INTEGER) AS dataset, id FROM g
UNION ALL SELECT 1, page_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages) WHERE n <= 1100 - (SELECT count(*) FROM g)
"""

SQL["dataset_split"] = """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT CASE WHEN i < CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN i < CAST(floor(n * 0.9) AS BIGINT) THEN 'valid' ELSE 'test' END AS part,
  count(*) AS n, min(doc_id) AS first FROM o GROUP BY 1
"""

_readable = r"trim(lower(regexp_replace(replace({}, '_', ' '), '([a-z])([A-Z])', '\1 \2', 'g')))"
_case = " ".join(f"WHEN name = {_text(d)} THEN replace({_text(t)}, '{{class_name}}', coalesce(class_name, 'object'))" for d, t in DUNDERS.items())
SQL["verb_docstring"] = f"""
WITH n(name, entity_type, class_name, k) AS (VALUES {_values(NAMES)}),
v(o, p, verb) AS (VALUES {_values((i, p, verb) for i, (p, verb) in enumerate(VERBS))}),
h AS (SELECT n.name, n.entity_type, min_by(p, o) AS p, min_by(verb, o) AS verb FROM n JOIN v ON starts_with(n.name, v.p) OR contains(n.name, '_' || v.p) GROUP BY 1, 2),
r AS (SELECT n.*, h.p, h.verb, regexp_replace(replace(n.name, h.p, ''), '^_+|_+$', '', 'g') AS rest FROM n LEFT JOIN h ON h.name = n.name AND h.entity_type = n.entity_type)
SELECT name, CASE {_case}
  WHEN starts_with(name, '__') AND suffix(name, '__') THEN 'Special method ' || name || ' for ' || coalesce(class_name, 'object') || '.'
  WHEN entity_type = 'property' THEN 'Property that returns the ' || {_readable.format("name")} || '.'
  ELSE CASE WHEN p IS NULL THEN 'Performs ' || {_readable.format("name")} || ' operation.'
       ELSE verb || ' ' || CASE WHEN rest = '' THEN 'the operation' ELSE {_readable.format("rest")} END || '.' END
    || CASE WHEN k > 0 THEN ' Takes parameters: ' || array_to_string(['p' || i FOR i IN range(1, least(k, 3) + 1)], ', ') || CASE WHEN k > 3 THEN ', and ' || (k - 3) || ' more' ELSE '' END || '.' ELSE '' END
    || CASE WHEN class_name IS NOT NULL AND class_name <> '' THEN ' Method of ' || class_name || '.' ELSE '' END END AS doc
FROM r
"""

_kinds = " ".join(f"WHEN contains(name, {_text(p)}) THEN {_text(' ' + rest)}" for p, rest in CLASS_KINDS)
SQL["class_docstring"] = rf"""
WITH n AS (
  SELECT p_partkey, p_size, p_brand, replace(p_brand, '#', '') || {[p for p, _ in CLASS_KINDS] + ["Thing"]}[CAST(p_partkey % 9 + 1 AS INTEGER)] AS name FROM part
)
SELECT p_partkey, trim(regexp_replace(name, '([A-Z])', ' \1', 'g')) || CASE {_kinds} ELSE ' class.' END
  || CASE WHEN p_size > 25 THEN ' Inherits from: Base, ' || p_brand || '.' ELSE '' END AS doc FROM n
"""

SQL["structured_parse"] = r"""
WITH s AS (
  SELECT doc_id, source, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS doc, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'fn_' || doc_id END AS name FROM documents
), n AS (
  SELECT *, CASE WHEN name = '' THEN 'Language: python' ELSE name END AS fn FROM s
), b AS (
  SELECT *, substr(regexp_replace(string_split(doc, chr(10))[1], '^\s+|\s+$', '', 'g'), 1, 256) AS brief, substr('def f():' || chr(10) || '    pass # ' || lang, 1, 500) AS code FROM n
)
SELECT doc_id AS index, 'src\' || source || '.py' AS path, fn AS func_name, CASE WHEN doc <> '' THEN brief ELSE '' END AS docstring_summary,
  regexp_replace(fn || ' ' || fn || ' ' || brief || ' ' || doc || ' ' || code, '^\s+|\s+$', '', 'g') AS text, CAST(NULL AS VARCHAR) AS error FROM b
"""

SQL["rag_text"] = r"""
WITH t AS (
  SELECT p_partkey, '--- Metadata ---' || chr(10) || 'Repository: repo' || chr(10) || 'Path: src/' || p_partkey || chr(10) || 'Name: ' || p_name || chr(10) || 'Type: method'
    || CASE WHEN p_brand <> '' THEN chr(10) || 'Class: ' || p_brand || CASE WHEN p_type <> '' THEN chr(10) || 'Class Description: ' || substr(p_type, 1, 200) ELSE '' END ELSE '' END
    || CASE WHEN p_size > 25 THEN chr(10) || 'Inherits: ' || p_type || ', x' || chr(10) || 'Parameters: ' || p_name || ', x' ELSE '' END
    || chr(10) || chr(10) || '--- Documentation ---' || chr(10) || CASE WHEN p_size > 10 AND p_name <> '' THEN p_name ELSE 'No documentation available.' END
    || chr(10) || chr(10) || '--- Code ---' || chr(10) || p_type AS text FROM part
)
SELECT p_partkey, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS hash FROM t
"""

SQL["file_filter"] = """
WITH n AS (SELECT p_partkey, ['dist', 'build', 'distributed.py', 'builder.py', 'latest', 'tests', 'core'][CAST(p_partkey % 7 + 1 AS INTEGER)] AS s FROM part)
SELECT p_partkey, s IN ('dist', 'build', 'tests') AS out_segment, contains(s, 'dist') OR contains(s, 'build') OR contains(s, 'test') AS out_substring FROM n
"""

_TOKENS = f"tok AS (SELECT doc_id, unnest({_LOWER}) AS term FROM documents), len AS (SELECT doc_id, len({_LOWER}) AS dl FROM documents)"
_IDF = """tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM df, n),
idf AS (SELECT term, df, CASE WHEN idf_raw < 0 THEN 0.25 * (SELECT avg(idf_raw) FROM raw) ELSE idf_raw END AS idf FROM raw)"""
_BM25 = f"""
{_TOKENS}, {_IDF},
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_LOWER}) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT query_id, tf.doc_id, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score
  FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN len ON len.doc_id = tf.doc_id, n GROUP BY ALL
)"""

SQL["tf_df_stats"] = f"WITH {_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS most FROM tf GROUP BY term"
SQL["idf_floor"] = f"WITH {_TOKENS}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf"
SQL["bm25_topk"] = f"""
WITH {_BM25}, o AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 5
"""
SQL["bm25_normalized"] = f"""
WITH {_BM25}, m AS (SELECT query_id, doc_id, score, max(score) OVER (PARTITION BY query_id) AS most FROM s),
z AS (SELECT query_id, doc_id, CASE WHEN most > 0 THEN score / most ELSE score END AS score FROM m),
o AS (SELECT query_id, doc_id, round(score, 6) AS score FROM z WHERE score > 0.1)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 20
"""

_STOP = "[" + ", ".join(map(_text, STOP_WORDS)) + "]"
_GRAMS = r"""SELECT id, w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM (
  SELECT id, [x FOR x IN regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+') IF length(x) >= 2 AND NOT list_contains({stop}, x)] AS w FROM (SELECT {id} AS id, text FROM {table}))"""
_TFIDF = f"""
g AS ({_GRAMS.format(stop=_STOP, id="doc_id", table="documents")}),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(g) AS term FROM g) GROUP BY ALL),
top AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 768),
voc AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM top),
w AS (SELECT id, term, term_index, idf, tf * idf AS w FROM tf JOIN voc USING (term)),
vec AS (SELECT id, term, term_index, idf, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"""
SQL["tfidf_vectors"] = f"WITH {_TFIDF} SELECT id, term, term_index, round(weight, 6) AS weight FROM vec"
SQL["tfidf_topk"] = f"""
WITH {_TFIDF},
qg AS ({_GRAMS.format(stop=_STOP, id="item_id", table="benchmark")}),
qt AS (SELECT id AS query_id, term, count(*) AS tf FROM (SELECT id, unnest(g) AS term FROM qg) GROUP BY ALL),
qw AS (SELECT query_id, term, tf * idf AS w FROM qt JOIN voc USING (term)),
q AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM qw),
o AS (SELECT query_id, id AS doc_id, round(sum(weight * qw), 6) AS score FROM vec JOIN q USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 5
"""

_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
SQL["knn_l2"] = f"""
WITH {_VEC}, d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) FOR i IN range(1, len(q.v) + 1)]), 6) AS distance
  FROM v q JOIN v c ON q.vec_id % 50 = 0
)
SELECT query_id, doc_id, distance, round(1.0 / (1.0 + distance), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5
"""
_COS = """cs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
    round(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) / ((sqrt(list_sum([x * x FOR x IN q.v])) + 1e-8) * (sqrt(list_sum([x * x FOR x IN c.v])) + 1e-8)), 6) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0
)"""
SQL["knn_cosine"] = f"WITH {_VEC}, {_COS} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM cs QUALIFY rank <= 5"

SQL["hybrid_topk"] = f"""
WITH {_BM25},
z AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE score END AS s FROM s),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{_COS.replace("JOIN v c ON q.vec_id % 50 = 0", "JOIN v c ON q.vec_id IN (SELECT item_id FROM benchmark) AND c.vec_id IN (SELECT doc_id FROM documents)")},
den AS (SELECT query_id, doc_id, score AS d, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM cs QUALIFY r <= 10),
b AS (SELECT query_id, doc_id, d, r, s FROM den FULL JOIN z USING (query_id, doc_id)),
o AS (SELECT query_id, doc_id, r, round(0.7 * coalesce(d, 0) + (1 - 0.7) * coalesce(s, 0), 6) AS score FROM b WHERE r IS NOT NULL OR s > 0.1)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r NULLS LAST, doc_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 5
"""

SQL["embedding_norms"] = f"WITH {_VEC}, n AS (SELECT sqrt(list_sum([x * x FOR x IN v])) AS n FROM v) SELECT round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm, count(*) AS n FROM n"

_at = lambda k: f"""sum(h) FILTER (rank <= {k}) / {k}.0 AS precision_at_{k}, sum(h) FILTER (rank <= {k}) / max(n_rel) AS recall_at_{k},
  sum(h / log2(rank + 1.0)) FILTER (rank <= {k}) / list_sum([1.0 / log2(i + 1.0) FOR i IN range(1, CAST(least(max(n_rel), {k}) AS BIGINT) + 1)]) AS ndcg_at_{k}"""  # noqa: E731
_EVAL = f"""{_VEC}, {_COS},
top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs QUALIFY rank <= 10),
rel AS (SELECT label, vec_id // 500 AS block, count(*) AS n_rel FROM v GROUP BY ALL),
hit AS (
  SELECT t.query_id, t.rank, CAST(c.vec_id // 500 = q.vec_id // 500 AND c.label = q.label AS INTEGER) AS h, n_rel
  FROM top t JOIN v q ON q.vec_id = t.query_id JOIN v c ON c.vec_id = t.doc_id JOIN rel ON rel.label = q.label AND rel.block = q.vec_id // 500
), run AS (SELECT *, sum(h) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM hit),
m AS (
  SELECT query_id, 't' || (query_id % 3) AS query_type, count(*) AS n_retrieved, max(n_rel) AS n_relevant, {_at(1)}, {_at(5)}, {_at(10)},
    coalesce(1.0 / min(rank) FILTER (h = 1), 0) AS mrr, coalesce(sum(CAST(so_far AS DOUBLE) / rank) FILTER (h = 1), 0) / max(n_rel) AS average_precision
  FROM run GROUP BY query_id
)"""
_NAMES = [f"{m}_at_{k}" for m in ("precision", "recall", "ndcg") for k in (1, 5, 10)] + ["mrr", "average_precision"]
SQL["eval_per_query"] = f"WITH {_EVAL} SELECT query_id, query_type, n_retrieved, n_relevant, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _NAMES)} FROM m"
_means = ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in _NAMES)
SQL["eval_aggregate"] = f"WITH {_EVAL} SELECT query_type, count(*) AS n_queries, {_means} FROM m GROUP BY ROLLUP (query_type)"
SQL["hit_rate_at_k"] = f"WITH {_EVAL} SELECT {', '.join(f'round(avg(CAST(recall_at_{k} > 0 AS INTEGER)), 6) AS hit_rate_at_{k}' for k in (1, 5, 10))} FROM m"

SQL["gt_last_wins"] = "SELECT 'q' || (doc_id % 50) AS query, doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) = 1"
SQL["skipped_queries"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"
SQL["type_distribution"] = "SELECT role AS query_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM conversations GROUP BY role"
SQL["metadata_sample"] = "SELECT doc_id, lang, source, (SELECT count(*) FROM documents) AS n_docs FROM documents ORDER BY doc_id LIMIT 100"

# What the literal inputs give, written down row by row.
SQL["rst_clean"] = """
SELECT * FROM (VALUES
  (CAST(0 AS BIGINT), '### Title' || chr(10) || chr(10) || 'Text with Foo and x .', ''),
  (1, '###### Sub' || chr(10) || chr(10) || '### a', ''),
  (2, 'body' || chr(10) || 'end', ''),
  (3, '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'after:' || chr(10) || '```' || chr(10) || chr(10) || 'literal' || chr(10) || '```' || chr(10) || 'end',
   'python:x = 1|text:' || chr(10) || 'literal'),
  (4, '### Over' || chr(10) || chr(10) || 'last lit', ''),
  (5, '', '')
) t(id, text, code_blocks)
"""
_MAKE = "def make ( x , * , y : int = 1 ) - > int : if x and y or os : return 1 return 2"
_SIZE = "def size ( self ) : return [ i for i in range ( 3 ) ]"
_RUN = "def run ( self , a , b = ( 1 , 2 ) , * args , * * kw ) : STR def inner ( ) : pass for x in a : with b : pass"
_GO = "def go ( self ) : return STR"
_NESTED = f"class Nested ( Base , abc . ABC ) : {_GO}"
_ROWS = (  # func_name, entity_type, class_name, class_docstring, summary, return_type, lines, complexity, synthetic, tokens, parents, decorators, parameters
    ("Base", "class", None, None, "A base class of all.", None, 4, 30, 1, False, f"class Base ( object ) : STR @ staticmethod {_MAKE} @ property {_SIZE} {_RUN} {_NESTED}", "object", "", ""),
    ("Base.make", "static_method", "Base", "A base class of all.", "Creates the operation. Takes parameters: x, y. Method of Base.", "int", 8, 11, 4, True, _MAKE, "object", "@staticmethod", "x y"),
    ("Base.size", "property", "Base", "A base class of all.", "Property that returns the size.", None, 14, 15, 1, True, _SIZE, "object", "@property", ""),
    ("Base.run", "method", "Base", "A base class of all.", "Runs it all.", None, 17, 26, 3, False, _RUN, "object", "", "a b args kw"),
    ("Nested", "class", None, None, "Nested class. Inherits from: Base, abc.ABC.", None, 28, 30, 1, True, _NESTED, "Base abc.ABC", "", ""),
    ("Nested.go", "method", "Nested", "", "Performs go operation. Method of Nested.", None, 29, 30, 1, True, _GO, "Base abc.ABC", "", ""),
    ("late", "function", None, None, "Performs late operation.", None, 34, 35, 1, True, "async def late ( ) : STR", "", "", ""),
)
SQL["entity_extract"] = f"""
SELECT 'pkg/a.py' AS path, func_name, entity_type, class_name, class_docstring, docstring_summary, return_type, CAST(start_line AS INTEGER) AS start_line,
  CAST(end_line AS INTEGER) AS end_line, CAST(complexity AS INTEGER) AS complexity, is_synthetic_docstring, 'https://example.org/blob/main/pkg/a.py#L' || start_line AS url,
  code_tokens, parent_classes, decorators, parameters
FROM (VALUES {_values(_ROWS)}) t(func_name, entity_type, class_name, class_docstring, docstring_summary, return_type, start_line, end_line, complexity, is_synthetic_docstring,
  code_tokens, parent_classes, decorators, parameters)
"""
SQL["entity_summary"] = """
SELECT 'repo' AS repository, 'out' AS output_directory, '{"min_lines": 1}' AS config, '{"files": 3}' AS statistics, CAST(7 AS BIGINT) AS total_entities, CAST(2 AS BIGINT) AS classes_discovered,
  '{"class":2,"function":1,"method":2,"property":1,"static_method":1}' AS entity_type_counts, 'Base Nested' AS classes
"""

SQL["paginated_discussions"] = """
WITH c AS (SELECT conv_id, count(*) AS turns, row_number() OVER (ORDER BY conv_id DESC) - 1 AS ordinal FROM conversations GROUP BY conv_id)
SELECT ordinal, ordinal // 100 AS page, conv_id, turns FROM c WHERE ordinal < 1000
"""
SQL["enriched_truth"] = """
WITH r AS (
  SELECT CAST(item_id AS VARCHAR) AS query, 0 AS place, 'x/docs_cleaned.json' AS file, d.source || chr(10) || d.text AS t FROM benchmark LEFT JOIN documents d ON doc_id = item_id
  UNION ALL SELECT CAST(item_id AS VARCHAR), 1, 'x/discussions.json', c.text FROM benchmark LEFT JOIN conversations c ON conv_id = item_id * 2 AND turn = 0
  UNION ALL SELECT CAST(item_id AS VARCHAR), 2, 'y/src_filtered_data.json', html FROM benchmark LEFT JOIN pages ON page_id = item_id * 3
  UNION ALL SELECT CAST(item_id AS VARCHAR), 3, 'other.json', NULL FROM benchmark
)
SELECT query, CAST(place AS INTEGER) AS place, file, md5(coalesce(t, 'as it was')) AS text_md5 FROM r
"""
SQL["output_path_filter"] = "SELECT p_partkey FROM part WHERE contains('src/' || p_type || '/' || p_name, 'src/STANDARD') OR contains('src/' || p_type || '/' || p_name, 'BRASS')"
SQL["source_urls"] = r"""
WITH r AS (SELECT page_id, regexp_replace(regexp_replace(CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END, '\.html$', ''), '^/+|/+$', '', 'g') AS rel FROM pages)
SELECT page_id, 'https://raw.example.org/docs/' || rel || '.rst' AS raw, 'https://docs.example.org/stable/_sources/' || rel || '.rst.txt' AS txt FROM r
"""
_WORDY = f"len({_WORDS}) >= 40 OR doc_id % 5 = 0"
SQL["clean_counters"] = f"""
SELECT count(*) AS processed, count(*) FILTER (source <> 'src1' AND ({_WORDY})) AS kept, count(*) FILTER (source = 'src1') AS filtered_by_url,
  count(*) FILTER (source <> 'src1' AND NOT ({_WORDY})) AS filtered_by_min_words FROM documents
"""
SQL["kept_documents"] = f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index, 'docs' AS label, 'docs_cleaned.json' AS file FROM documents WHERE {_WORDY}"
SQL["collection_created"] = """
SELECT CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS v, count(*) AS n, CAST(64 AS INTEGER) AS size, 'COSINE' AS distance FROM embeddings GROUP BY 1
"""
SQL["json_lines_round_trip"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"
SQL["json_array_round_trip"] = "SELECT page_id, url, md5(html) AS html_md5 FROM pages"
SQL["requests_loaded"] = """
WITH r AS (SELECT 0 AS f, item_id, text, 'docs' AS t FROM benchmark UNION ALL SELECT 1, item_id, text, 'code' FROM benchmark)
SELECT row_number() OVER (ORDER BY f, item_id) AS query_id, text AS query, t AS query_type FROM r
"""
SQL["result_dump"] = f"""
WITH {_VEC}, d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) FOR i IN range(1, len(q.v) + 1)]), 6) AS distance
  FROM v q JOIN v c ON q.vec_id % 50 = 0
), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS r FROM d QUALIFY r <= 5)
SELECT query_id, 'q' || query_id AS query, string_agg(doc_id::VARCHAR, ' ' ORDER BY r) AS doc_ids, string_agg('v' || doc_id, ' ' ORDER BY r) AS top_docs,
  string_agg('https://x/' || doc_id, ' ' ORDER BY r) AS doc_links, round(sum(distance), 5) AS total FROM t GROUP BY query_id
"""
SQL["eval_latency"] = f"""
WITH {_EVAL} SELECT query_type, round(avg((query_id % 7) / 8.0), 6) AS mean, round(stddev_pop((query_id % 7) / 8.0), 6) AS std FROM m GROUP BY ROLLUP (query_type)
"""
_four = lambda c: f"printf('%.4f', avg(CAST({c} AS DOUBLE)))"
SQL["eval_report"] = f"""
WITH {_EVAL} SELECT query_type, upper(coalesce(query_type, 'all')) || ' (' || count(*) || ' queries), MRR ' || {_four("mrr")} || ', MAP ' || {_four("average_precision")}
  || ', NDCG@10 ' || {_four("ndcg_at_10")} || ', Precision@5 ' || {_four("precision_at_5")} || ', Recall@5 ' || {_four("recall_at_5")}
  || ', latency ' || printf('%.2f', avg((query_id % 7) / 8.0) * 1000) || ' +- ' || printf('%.2f', stddev_pop((query_id % 7) / 8.0) * 1000) || ' ms' AS line FROM m GROUP BY ROLLUP (query_type)
"""
SQL["retrieved_with_latency"] = f"""
WITH {_BM25.replace("FROM documents", "FROM (SELECT doc_id, source || ' ' || text AS text FROM documents)")}, o AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= 5)
SELECT item_id AS query_id, coalesce(string_agg(doc_id::VARCHAR, ' ' ORDER BY rank), '') AS found, true AS timed FROM benchmark LEFT JOIN r ON item_id = query_id GROUP BY item_id
"""

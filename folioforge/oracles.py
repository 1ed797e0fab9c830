"""DuckDB SQL for the queries that SQL can express, over the same tables. Patterns come from one place and are spelled for RE2."""

from __future__ import annotations

from .corpus import CORPUS_SQL
from .functions import patterns as P
from .functions import predicates as pr
from .functions import text as tx
from .functions.dialect import re2, sql

NBSP = "chr(160)"


def m(c: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({c}, {sql(re2(pattern, flags))})"


def rep(c: str, pattern: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({c}, {sql(re2(pattern, flags))}, {sql(by)}, 'g')"


def ext(c: str, pattern: str, group: int) -> str:
    return f"regexp_extract({c}, {sql(re2(pattern))}, {group})"


def trim(c: str) -> str:
    return rep(rep(c, r"^\s+", ""), r"\s+$", "")


def links(c: str) -> str:
    return rep(rep(c, P.WEB_AUTOLINK, r"\1"), P.MAIL_AUTOLINK, r"\1")


def bare(c: str) -> str:
    return rep(rep(links(c), P.ESCAPED_ELLIPSIS, "…"), P.ESCAPED_ANY, r"\1")


def prose(c: str) -> str:
    c = rep(rep(links(c), P.ESCAPED_ELLIPSIS, "…"), P.ESCAPED_PUNCTUATION, r"\1")
    return f"replace({rep(rep(c, P.BOLD_SPACE_END, chr(92).join(['**', '1**', '2'])), P.BOLD_SPACE_START, chr(92).join(['', '1**', '2**']))}, {NBSP}, ' ')"


def words(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, {sql(re2(chr(92) + 'S+'))})) AS BIGINT)"


def unbold(c: str) -> str:
    return rep(c, P.WHOLE_LINE_BOLD, r"\1\2\3")


def residue(c: str) -> str:
    for pattern in P.RESIDUE:
        c = rep(c, pattern, " ")
    return trim(c)


def folded(c: str) -> str:
    return f"translate(lower({c}), {sql(tx._FROM)}, {sql(tx._TO)})"


def slug(c: str) -> str:
    dashed = f"regexp_replace({folded(c)}, '[^a-z0-9]+', '-', 'g')"
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace({dashed}, '^-+', ''), '-+$', ''), 1, 50), ''), 'modulo')"


def lines_of(source: str, key: str = "doc_id", text: str = "text", newline: str = r"\r?\n") -> str:
    return f"(SELECT {key}, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT {key}, string_split_regex({text}, {sql(newline)}) AS l FROM {source} WHERE {text} IS NOT NULL))"


WITH = f"WITH {CORPUS_SQL}, lines AS (SELECT * FROM {lines_of('corpus')})"
DOC_LINES = f"(SELECT line FROM lines UNION ALL SELECT line FROM {lines_of('documents')})"


def named(c: str, name: str) -> str:
    return m(c, *pr.NAMED[name])


def mixed(c: str) -> str:
    r = residue(c)
    hits = f"list_distinct(list_transform(regexp_extract_all({r}, {sql(re2(P.SPANISH_FUNCTION_WORD, 'i'))}), lambda w: lower(w)))"
    return f"({words(r)} >= 3 AND len({hits}) >= 2)"


def path_label(c: str) -> str:
    t = trim(unbold(c))
    return f"(NOT {m(t, chr(92) + 's')} AND NOT {m(t, P.URL_SCHEME, 'i')} AND {named(t, 'file_path_label')})"


def label(c: str) -> str:
    t = trim(rep(rep(trim(unbold(c)), P.FILE_TOKEN, " ", "i"), r"\s+", " "))
    return f"({words(t)} >= 2 AND {named(t, 'pure_text')} AND NOT {named(t, 'keyword_start')} AND NOT {named(t, 'shell_start')} AND (({words(t)} >= 4 AND {m(t, '[.:]$')}) OR {named(t, 'spanish_word')}))"


def gloss(c: str) -> str:
    t = trim(c)
    return f"({t} <> '' AND NOT {m(t, P.NOT_A_GLOSS)} AND {m(t, P.GLOSS)})"


PREDICATES = [(n, named("line", n)) for n in pr.NAMED] + [("file_token", m("line", P.FILE_TOKEN, "i")), ("function_word", m("line", P.SPANISH_FUNCTION_WORD, "i"))]

_SEQUENCES = """seqs AS (SELECT l_suppkey AS seq_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos, CASE WHEN l_returnflag = 'R' THEN 'list'
WHEN CAST(l_quantity AS INT) % 4 = 0 THEN 'code' WHEN CAST(l_quantity AS INT) % 4 = 1 THEN 'prose' ELSE 'unknown' END AS kind FROM lineitem)"""

_PLAN = """mods AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS parent_id, CAST(o_orderkey AS INT) AS module_no, o_orderstatus AS st FROM orders),
state AS (SELECT parent_id, module_no, 'page-' || module_no AS page_id, st = 'F' AS done FROM mods WHERE st <> 'O')"""


def _detect(code: str, title: str) -> str:
    n = "greatest(len(ls), 1)"
    share = lambda p: f"len(list_filter(ls, lambda x: {m('x', p)})) / {n}"
    typed = " OR ".join([m("body", P.LANG_TS_RETURN, "m"), *(m("body", p) for p in P.LANG_TS_STRONG), m(title, "typescript", "i")])
    shell = f"{m("coalesce(ls[1], '')", P.LANG_SHELL_FIRST)} AND len(list_filter(ls, lambda x: NOT {m('x', P.LANG_SHELL_LINE)})) = 0"
    return f"""CASE WHEN {m('body', P.LANG_DOCTYPE, 'i')} OR {share(P.LANG_TAG_LINE)} >= 0.6 THEN 'html' WHEN {shell} THEN 'bash'
WHEN {m('body', '^[{[]')} AND {m('body', P.LANG_JSON_KEY)} AND NOT {m('body', P.LANG_JSON_NOT)} THEN 'json'
WHEN {share(P.LANG_CSS_LINE)} >= 0.7 AND NOT {m('body', P.LANG_CSS_NOT)} THEN 'css' WHEN {typed} THEN 'typescript' ELSE 'javascript' END"""


_PATHS = """paths AS (SELECT '/cursos/' || s_name || '/' || CASE WHEN s_suppkey % 3 = 0 THEN 'Clases' ELSE 'mi_curso--' || s_suppkey END || '.docx' AS path FROM supplier
UNION ALL SELECT './media/' || replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' ELSE '.bin' END FROM part),
cut AS (SELECT path, split_part(path, '/', -1) AS name, split_part(path, '/', -2) AS folder, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(path, '\\.[^.]*$')) AS suffix FROM paths)"""


def _title(c: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split(trim(regexp_replace({c}, '[-_]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"


_MIME = "CASE suffix " + " ".join(f"WHEN {sql(k)} THEN {sql(v)}" for k, v in P.MIME.items()) + f" ELSE {sql(P.DEFAULT_MIME)} END"
_CODE = """CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'npm install p' || o_orderkey || chr(10) || 'cd p' || o_orderkey WHEN 1 THEN '{' || chr(10) || '  "total": ' || o_orderkey || chr(10) || '}'
WHEN 2 THEN '.a {' || chr(10) || '  width: ' || o_orderkey || 'px;' || chr(10) || '}' || chr(10) || '.b {' WHEN 3 THEN 'let total: number = ' || o_orderkey || ';' ELSE 'const a = b ? c(' || o_orderkey || ') : d();' END"""

#: Requests of a push as one ordered list: each has a stage, a number and a part in its module, and places are counted in that order.
_REQUESTS = f"""WITH {_PLAN}, li AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS parent_id, CAST(l_orderkey AS INT) AS module_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS no, l_partkey, CAST(l_quantity AS INT) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
b AS (SELECT parent_id, module_no, no, i, (row_number() OVER (PARTITION BY parent_id, module_no ORDER BY no, i) - 1) // 100 AS batch_no, CASE WHEN no % 2 = 0 AND i = 0 THEN l_partkey END AS image FROM (SELECT *, unnest(range(q + 1)) AS i FROM li)),
refs AS (SELECT b.*, row_number() OVER (PARTITION BY parent_id, module_no ORDER BY no) - 1 AS ref_no, p_size FROM b LEFT JOIN part ON p_partkey = image AND p_size % 5 <> 0 WHERE image IS NOT NULL),
todo AS (SELECT * FROM mods WHERE st <> 'F' AND (parent_id, module_no) NOT IN (SELECT parent_id, module_no FROM refs WHERE p_size * 430000 > 20 * 1024 * 1024)),
live AS (SELECT parent_id, module_no FROM state WHERE module_no % 3 <> 0),
place AS (SELECT t.parent_id, t.module_no, max(l.module_no) AS p FROM todo t LEFT JOIN live l ON l.parent_id = t.parent_id AND l.module_no < t.module_no WHERE st = 'P' GROUP BY 1, 2),
r AS (SELECT parent_id, module_no, 0 AS stage, 0 AS n, 0 AS part, 'listing' AS kind, 'GET' AS method, '/blocks/' || parent_id || '/children' AS endpoint, NULL::INT AS batch_no, NULL::INT AS ref_no, NULL AS token FROM todo WHERE st = 'P'
UNION ALL SELECT parent_id, module_no, 1, 0, 0, 'archive', 'PATCH', '/pages/page-' || module_no, NULL, NULL, NULL FROM todo WHERE st = 'P'
UNION ALL SELECT t.parent_id, t.module_no, 2, ref_no, part, CASE part WHEN 0 THEN 'reserve' ELSE 'send' END, 'POST', CASE part WHEN 0 THEN '/file_uploads' ELSE '/file_uploads/{{upload}}/send' END, batch_no, ref_no, 'image' || image || '.png' FROM todo t JOIN refs USING (parent_id, module_no), (SELECT unnest([0, 1]) AS part) WHERE p_size IS NOT NULL
UNION ALL SELECT t.parent_id, t.module_no, 3, coalesce(batch_no, 0), 0, CASE WHEN coalesce(batch_no, 0) = 0 THEN 'page' ELSE 'append' END, CASE WHEN coalesce(batch_no, 0) = 0 THEN 'POST' ELSE 'PATCH' END, CASE WHEN coalesce(batch_no, 0) = 0 THEN '/pages' ELSE '/blocks/{{page}}/children' END, coalesce(batch_no, 0), NULL, NULL
FROM todo t LEFT JOIN (SELECT DISTINCT parent_id, module_no, batch_no FROM b) USING (parent_id, module_no))
SELECT r.parent_id, r.module_no, row_number() OVER (PARTITION BY r.parent_id, r.module_no ORDER BY stage, n, part) - 1 AS seq, row_number() OVER (PARTITION BY r.parent_id ORDER BY r.module_no, stage, n, part) - 1 AS parent_seq,
row_number() OVER (ORDER BY r.parent_id, r.module_no, stage, n, part) - 1 AS run_seq, kind, method, endpoint, batch_no::INT AS batch_no, ref_no::INT AS ref_no, token,
CASE WHEN kind = 'page' AND place.module_no IS NOT NULL THEN CASE WHEN p IS NULL THEN 'page_start' ELSE 'after_block' END END AS position, CASE WHEN kind = 'page' THEN 'page-' || p END AS after_id FROM r LEFT JOIN place ON place.parent_id = r.parent_id AND place.module_no = r.module_no"""

#: Waits by places in two ordered lists: all uploads before all batches, and group by group.
_ATTACH = """WITH li AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS parent_id, CAST(l_suppkey AS INT) AS module_no, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS no, l_partkey, CAST(l_quantity AS INT) AS q FROM lineitem),
b AS (SELECT parent_id, module_no, no, i, (row_number() OVER (PARTITION BY module_no ORDER BY no, i) - 1) // 100 AS batch_no, CASE WHEN no % 3 = 0 AND i = 0 THEN 'image' || l_partkey END AS token FROM (SELECT *, unnest(range(q + 1)) AS i FROM li)),
refs AS (SELECT *, row_number() OVER (PARTITION BY module_no ORDER BY no) - 1 AS ref_no FROM b WHERE token IS NOT NULL),
c AS (SELECT parent_id, module_no, batch_no, 1 + 2 * count(*) FILTER (token NOT LIKE '%7') AS cost FROM b GROUP BY 1, 2, 3),
g AS (SELECT *, (sum(cost) OVER (PARTITION BY module_no ORDER BY batch_no) - 1) // greatest(1, 90000 // 340 - max(cost) OVER (PARTITION BY module_no)) AS group_no FROM c),
steps AS (SELECT module_no, batch_no, group_no, 1 AS late_stage, batch_no AS n, 0 AS part, NULL AS ref_no FROM g
UNION ALL SELECT r.module_no, r.batch_no, group_no, 0, ref_no, part, ref_no FROM refs r JOIN g ON g.module_no = r.module_no AND g.batch_no = r.batch_no, (SELECT unnest([0, 1]) AS part) WHERE token NOT LIKE '%7'),
placed AS (SELECT *, row_number() OVER (PARTITION BY module_no ORDER BY late_stage, n, part) AS flat, row_number() OVER (PARTITION BY module_no ORDER BY group_no, late_stage, n, part) AS grouped FROM steps)
SELECT r.parent_id, r.module_no, r.ref_no::INT AS ref_no, r.token, r.batch_no::INT AS batch_no, (340 * (a.flat - s.flat))::BIGINT AS wait_ms, 340 * (a.flat - s.flat) > 90000 AS late, s.group_no::BIGINT AS group_no, (340 * (a.grouped - s.grouped))::BIGINT AS grouped_wait_ms, 340 * (a.grouped - s.grouped) > 90000 AS grouped_late
FROM refs r JOIN placed s ON s.module_no = r.module_no AND s.ref_no = r.ref_no AND s.part = 1 JOIN placed a ON a.module_no = r.module_no AND a.batch_no = r.batch_no AND a.ref_no IS NULL"""

ORACLES: dict[str, str] = {
    "f_unescape": f"{WITH} SELECT doc_id, CAST(line_no AS INT) AS line_no, {links('line')} AS links, {bare('line')} AS bare, {prose('line')} AS prose, {m('line', P.AUTOLINK_LINE)} AS autolink FROM lines",
    "f_line_measures": f"""{WITH}, hard AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN replace(line, ' ', {NBSP}) ELSE line END AS line FROM lines),
counted AS (SELECT *, length(line) - length(replace(line, {NBSP}, '')) AS nb, length(line) - length(replace(line, ' ', '')) AS sp FROM hard)
SELECT doc_id, CAST(line_no AS INT) AS line_no, {words('line')} AS words, {unbold('line')} AS unbold, {m('line', P.NBSP_INDENT)} AND {m('line', P.NBSP_START)} AS indented,
CASE WHEN nb = 0 THEN 0.0::DOUBLE ELSE nb / (nb + sp)::DOUBLE END AS ratio, {residue('line')} AS residue FROM counted""",
    "f_slugs": f"""WITH t AS (SELECT p_partkey AS id, 0 AS line_no, 'Módulo ' || p_name || ' ¿Qué es ' || p_brand || '?' AS title FROM part UNION ALL SELECT -doc_id - 1, line_no, line FROM {lines_of('documents')}),
s AS (SELECT id, line_no, {slug('title')} AS slug FROM t) SELECT id, line_no::INT AS line_no, slug, lpad(CAST(((id % 150) + 150) % 150 AS VARCHAR), CASE WHEN ((id % 150) + 150) % 150 > 99 THEN 3 ELSE 2 END, '0') || '-' || slug || '.md' AS file FROM s""",
    "f_paths": f"""WITH {_PATHS}, stems AS (SELECT *, replace({slug('stem')}, '-', ' ') AS spaced FROM cut)
SELECT path, folder, {slug("folder || '-' || stem")} AS slug, {_title("CASE WHEN lower(stem) IN ('clase', 'clases') THEN folder ELSE stem END")} AS title, '![](' || name || ')' AS marker, {_MIME} AS mime, upper(spaced[1]) || spaced[2:] AS from_file FROM stems""",
    "f_languages": f"""WITH n AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT ' ' || upper(x) || ' ', 1 FROM (SELECT unnest([{', '.join(map(sql, P.SAFE_LANGUAGES))}]) AS x))
SELECT name, n, CASE WHEN lower(trim(name)) IN ({', '.join(map(sql, P.SAFE_LANGUAGES))}) THEN lower(trim(name)) ELSE 'plain text' END AS language FROM n""",
    "f_hashes": "SELECT doc_id, sha256(text) AS hash, replace(source || '-' || doc_id || '-' || lang, '-', '') AS plain FROM documents",
    "p_predicates": f"{WITH}, x AS (SELECT * FROM {DOC_LINES}) " + " UNION ALL ".join(f"SELECT {sql(n)} AS predicate, coalesce(sum(CAST({c} AS BIGINT)), 0)::BIGINT AS n FROM x" for n, c in PREDICATES),
    "p_line_predicates": f"{WITH} SELECT line, concat({', '.join(f'CAST(CAST({c} AS INT) AS VARCHAR)' for _, c in PREDICATES)}) AS holds FROM (SELECT DISTINCT line FROM {DOC_LINES})",
    "c_labels": f"{WITH}, x AS (SELECT line, count(*) AS n FROM {DOC_LINES} GROUP BY 1) SELECT line, n, {mixed('line')} AS mixed, {path_label('line')} AS path_label, {label('line')} AS label, {gloss('line')} AS gloss FROM x",
    "t_lines": f"SELECT doc_id, count(*) AS n_lines, max(length(line))::BIGINT AS longest FROM {lines_of('documents')} GROUP BY 1",
    "l_languages": f"""WITH c AS (SELECT 'p' || page_id AS id, replace(html, '>', '>' || chr(10)) AS code FROM pages UNION ALL SELECT 'o' || o_orderkey, {_CODE} FROM orders),
s AS (SELECT id, list_filter(list_transform(string_split(code, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS ls FROM c),
t AS (SELECT id, ls, array_to_string(ls, chr(10)) AS body FROM s) SELECT id, {_detect('code', "'Módulo'")} AS language FROM t""",
    "b_list_depths": """WITH RECURSIVE i AS (SELECT l_orderkey AS id, row_number() OVER w AS no, l_partkey % 4 AS depth, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
w AS (SELECT id, k, no, 0::BIGINT AS level, [no] AS stack FROM i WHERE k = 1
UNION ALL SELECT i.id, i.k, i.no, least(i.depth, len(w.stack))::BIGINT, list_append(w.stack[1:least(i.depth, len(w.stack))::INT], i.no) FROM w JOIN i ON i.id = w.id AND i.k = w.k + 1)
SELECT id, no, level, stack[len(stack) - 1] AS parent FROM w""",
    "b_batches": """WITH b AS (SELECT l_suppkey AS parent_id, count(*) FILTER (l_linenumber % 4 <> 0) AS n FROM lineitem GROUP BY 1)
SELECT parent_id, n AS n_top, ceil(n / 100.0)::BIGINT AS n_batches, ceil(n / 100.0)::BIGINT - 1 AS n_appends FROM b""",
    "k_push_actions": f"""WITH {_PLAN} SELECT parent_id, CASE st WHEN 'F' THEN 'skip' WHEN 'O' THEN 'create' ELSE 'redo' END AS action, count(*) AS n, sum(module_no)::BIGINT AS module_sum FROM mods GROUP BY 1, 2""",
    "k_pending": f"WITH {_PLAN} SELECT parent_id, module_no FROM mods WHERE st <> 'F'",
    "k_positions": f"""WITH {_PLAN}, live AS (SELECT parent_id, module_no, page_id FROM state WHERE module_no % 3 <> 0),
prev AS (SELECT s.parent_id, s.module_no, max(l.module_no) AS p FROM state s LEFT JOIN live l ON l.parent_id = s.parent_id AND l.module_no < s.module_no GROUP BY 1, 2)
SELECT parent_id, module_no, CASE WHEN p IS NULL THEN 'page_start' ELSE 'after_block' END AS position, 'page-' || p AS after_id FROM prev""",
    "k_registry": """WITH c AS (SELECT 'c-' || c_custkey AS slug, c_custkey, c_mktsegment AS seg, sha256(c_name) AS h, c_custkey % 3 = 0 AS old, c_custkey % 2 = 0 OR c_custkey % 3 <> 0 AS new, c_custkey % 5 = 0 AS other FROM customer),
x AS (SELECT *, new AND NOT (old AND other) AS fresh FROM c WHERE old OR new)
SELECT slug, CAST(c_custkey AS VARCHAR) AS page_id, CASE WHEN fresh AND other THEN 'other' ELSE seg END AS docx_file_name, CASE WHEN fresh THEN h ELSE 'old' END AS docx_hash,
CASE WHEN old THEN '2024-01-01' ELSE '2025-01-01' END AS created_at, CASE WHEN fresh THEN '2025-01-01' ELSE '2024-01-02' END AS last_synced_at FROM x""",
    "k_images": """WITH u AS (SELECT p_partkey FROM part WHERE p_size % 2 = 0), l AS (SELECT l_linenumber % 2 = 0 AS has, u.p_partkey IS NOT NULL AND l_linenumber % 2 = 0 AS up FROM lineitem LEFT JOIN u ON p_partkey = l_partkey)
SELECT CASE WHEN up THEN 'image' ELSE 'paragraph' END AS type, count(*) AS n, count(*) FILTER (up) AS uploaded, count(*) FILTER (has) AS tokens FROM l GROUP BY 1""",
    "k_requests": f"""WITH {_PLAN}, tops AS (SELECT CAST(l_orderkey AS INT) AS module_no, sum(CAST(l_quantity AS INT) + 1) AS n FROM lineitem GROUP BY 1),
todo AS (SELECT parent_id, m.module_no, st, greatest(coalesce(ceil(n / 100.0), 1), 1)::INT AS b FROM mods m LEFT JOIN tops USING (module_no) WHERE st <> 'F'),
r AS (SELECT parent_id, 'PATCH' AS method, 0 AS seq FROM todo WHERE st = 'P' UNION ALL SELECT parent_id, CASE WHEN i = 0 THEN 'POST' ELSE 'PATCH' END, i + 1 FROM (SELECT parent_id, unnest(range(b)) AS i FROM todo))
SELECT parent_id, method, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM r GROUP BY 1, 2""",
    "k_push_sequence": _REQUESTS,
    "k_attach_windows": _ATTACH,
    "k_retries": """WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), e AS (SELECT user_id, i // 6 AS series, i % 6 AS attempt, CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 500 ELSE 200 END AS status,
CASE WHEN event_id % 8 = 0 THEN 3 END AS after FROM i),
o AS (SELECT *, CASE WHEN status = 200 THEN 'done' WHEN attempt < 5 THEN 'retry' WHEN status = 429 THEN 'exhausted' ELSE 'failed' END AS outcome,
CASE WHEN status = 429 THEN coalesce(after, 1)::DOUBLE WHEN status >= 500 AND attempt < 5 THEN pow(2, attempt) ELSE 0 END AS w FROM e),
g AS (SELECT *, coalesce(max(CAST(outcome <> 'retry' AS INT)) OVER (PARTITION BY user_id, series ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM o)
SELECT user_id, outcome, count(*) AS n, sum(w) AS waited FROM g WHERE ended = 0 GROUP BY 1, 2""",
    "k_commit": f"""WITH {_PLAN} SELECT parent_id, module_no, CASE WHEN st = 'F' THEN 'page-' || module_no ELSE 'new-' || module_no END AS page_id, CASE WHEN st = 'F' THEN true ELSE module_no % 2 = 0 END AS done FROM mods""",
    "k_uploads": """WITH p AS (SELECT p_partkey % 9 AS doc_id, 'image' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.png' ELSE '.emf' END AS token, CASE WHEN p_size % 2 = 0 THEN 'image/png' ELSE 'image/emf' END AS content_type FROM part WHERE p_size % 5 <> 0 AND p_size * 512 * 1024 <= 20 * 1024 * 1024)
SELECT doc_id, token, 0 AS seq, 'POST' AS method, '/file_uploads' AS endpoint, content_type, NULL::INT AS attach_seconds FROM p UNION ALL SELECT doc_id, token, 1, 'POST', '/file_uploads/{upload}/send', content_type, 3600 FROM p""",
    "k_sync_runs": """WITH mods AS (SELECT DISTINCT o_custkey % 500 AS doc_id, o_orderkey % 40 AS module_no FROM orders),
state AS (SELECT o_custkey % 500 AS doc_id, o_orderkey % 40 AS module_no, bool_or(o_orderstatus = 'F') AS done FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2),
runs AS (SELECT c_custkey AS run_id, c_custkey % 510 AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 45 END AS only_no, c_custkey % 4 = 0 AS force, c_custkey % 7 = 0 AS dry FROM customer),
stopped AS (SELECT *, CASE WHEN force AND only_no IS NULL THEN 'force needs a module' WHEN doc_id NOT IN (SELECT doc_id FROM mods) THEN 'no such document'
WHEN only_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mods m WHERE m.doc_id = runs.doc_id AND m.module_no = only_no) THEN 'no such module; 1 to ' || (SELECT max(module_no) FROM mods m WHERE m.doc_id = runs.doc_id) END AS problem FROM runs),
x AS (SELECT run_id, NULL AS action, problem, NULL::BIGINT AS module_no FROM stopped WHERE problem IS NOT NULL
UNION ALL SELECT run_id, CASE WHEN done AND NOT force THEN 'skip' WHEN dry THEN 'dry_run' WHEN s.doc_id IS NULL THEN 'create' ELSE 'redo' END, NULL, m.module_no
FROM stopped r JOIN mods m ON m.doc_id = r.doc_id AND (only_no IS NULL OR only_no = m.module_no) LEFT JOIN state s ON s.doc_id = m.doc_id AND s.module_no = m.module_no WHERE problem IS NULL)
SELECT run_id, action, problem, count(*) AS n, sum(module_no)::BIGINT AS module_sum FROM x GROUP BY 1, 2, 3""",
    "k_course_runs": """WITH c AS (SELECT s_name AS slug, s_suppkey % 3 = 0 AS known, s_suppkey % 6 = 0 AND s_suppkey <> 0 AS other, s_suppkey % 5 = 0 AS no_area, s_suppkey % 7 = 0 AS no_platform, CASE WHEN s_suppkey % 2 = 0 THEN 'En curso' ELSE 'Terminado' END AS status FROM supplier),
p AS (SELECT *, CASE WHEN known AND other THEN 'slug taken by another file' WHEN known THEN NULL WHEN no_area THEN 'area missing' WHEN no_platform THEN 'platform missing' END AS problem FROM c)
SELECT slug, CASE WHEN problem IS NULL THEN CASE WHEN known THEN 'update' ELSE 'create' END END AS action, status, problem FROM p""",
    "k_course_steps": f"""WITH c AS (SELECT s_name AS slug, s_suppkey % 3 = 0 AS known, s_suppkey % 11 = 0 AS dry, s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0 AS bad, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE {_title("'web-' || s_name")} END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'En curso' ELSE 'Terminado' END AS status FROM supplier),
s AS (SELECT slug, title, status, CASE WHEN dry THEN CASE WHEN known THEN ['push dry'] ELSE ['show'] END WHEN known THEN ['push', 'save', 'update'] ELSE ['create', 'save', 'push', 'update'] END AS steps FROM c WHERE NOT bad)
SELECT slug, unnest(range(len(steps)))::INT AS step_no, unnest(steps) AS step, title, status FROM s""",
    "k_payloads": """WITH c AS (SELECT s_name AS slug, 'Curso "' || s_name || '"' AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'En curso' ELSE 'Terminado' END AS status, s_nationkey AS n, s_suppkey FROM supplier), t AS (SELECT '"Última sincronización":{"date":{"start":"2024-01-02T03:04:05Z"}}' AS synced)
SELECT slug, 'POST' AS method, '/pages' AS endpoint, '{"parent":{"database_id":"db"},"properties":{"Título":{"title":[{"type":"text","text":{"content":' || to_json(title)::VARCHAR || '}}]},"Área":{"select":{"name":"Web"}},"Plataforma":{"select":{"name":"Libre"}},"Estado":{"select":{"name":"' || status || '"}},"Módulos":{"number":' || n || '},"Archivo origen":{"rich_text":[{"type":"text","text":{"content":' || to_json(slug || '.docx')::VARCHAR || '}}]},' || synced || '}}' AS body FROM c, t
UNION ALL SELECT slug, 'PATCH', '/pages/page-' || s_suppkey, '{"properties":{"Módulos":{"number":' || n || '},' || synced || '}}' FROM c, t""",
    "k_titles": f"""WITH f AS (SELECT p_partkey, p_size, p_brand, lpad(p_partkey::VARCHAR, 5, '0') || '-' || {slug('p_name')} AS stem, replace({slug('p_name')}, '-', ' ') AS said FROM part)
SELECT stem, p_partkey::INT AS module_no, CASE WHEN p_size % 2 = 0 THEN 'Módulo ' || p_brand ELSE upper(said[1]) || said[2:] END AS title FROM f""",
    "k_state_files": f"""WITH {_PLAN} SELECT parent_id, module_no, page_id, done, NULL AS synced FROM state
UNION ALL SELECT 'c-' || c_custkey, NULL, c_custkey::VARCHAR, fresh, CASE WHEN fresh THEN '2025-01-01' ELSE '2024-01-02' END FROM (SELECT c_custkey, (c_custkey % 2 = 0 OR c_custkey % 3 <> 0) AND NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0) AS fresh FROM customer)""",
    "s_markdown": "SELECT c_nationkey::BIGINT AS nation, string_agg('- ' || c_name || chr(10), '' ORDER BY c_custkey) AS text, sha256(string_agg('- ' || c_name || chr(10), '' ORDER BY c_custkey)) AS hash FROM customer GROUP BY 1",
    "s_parents": f"""SELECT o_custkey::VARCHAR AS parent_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS position, 'page-' || o_orderkey AS block_id, NULL AS title FROM orders
UNION ALL SELECT c_custkey || '' || c_custkey, NULL, NULL, CASE WHEN c_custkey % 3 = 0 THEN {sql(P.NO_TITLE)} ELSE c_name END FROM customer""",
    "o_options": """WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
t AS (SELECT user_id || '/' || (i // 7) AS run_id, (i % 7)::INT AS pos, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN '--area' ELSE '--titulo' END WHEN 'signup' THEN '--estado' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN '--dry-run' ELSE '--force' END
ELSE CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' || event_id END END AS token FROM i),
w AS (SELECT run_id, -1 AS pos, NULL::VARCHAR AS waits, []::VARCHAR[] AS ps, NULL::VARCHAR AS area, NULL::VARCHAR AS title, NULL::VARCHAR AS status, false AS dry_run, false AS force FROM t WHERE pos = 0
UNION ALL SELECT t.run_id, t.pos, CASE WHEN waits IS NULL AND token IN ('--area', '--titulo', '--estado') THEN token END, CASE WHEN waits IS NULL AND token NOT LIKE '--%' THEN list_append(ps, token) ELSE ps END,
CASE WHEN waits = '--area' THEN token WHEN waits IS NULL AND token = '--area' THEN NULL ELSE area END, CASE WHEN waits = '--titulo' THEN token WHEN waits IS NULL AND token = '--titulo' THEN NULL ELSE title END, CASE WHEN waits = '--estado' THEN token WHEN waits IS NULL AND token = '--estado' THEN NULL ELSE status END,
dry_run OR (waits IS NULL AND token = '--dry-run'), force OR (waits IS NULL AND token = '--force') FROM w JOIN t ON t.run_id = w.run_id AND t.pos = w.pos + 1)
SELECT run_id, ps[1] AS docx_path, ps[2] AS module, area, NULL::VARCHAR AS platform, status, title, dry_run, force, CASE WHEN coalesce(ps[1], '') = '' THEN 'usage' END AS problem FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) AS back FROM w) WHERE back = 1""",
    "k_state_log": """WITH t AS (SELECT CAST(user_id % 50 AS VARCHAR) AS parent_id, CAST(user_id // 50 % 200 AS INT) AS module_no, event_id AS version, CASE WHEN event_type <> 'purchase' THEN 'page-' || event_id END AS page_id, event_type = 'purchase' AS done FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY parent_id, module_no ORDER BY version DESC) AS back, last_value(page_id IGNORE NULLS) OVER (PARTITION BY parent_id, module_no ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page FROM t)
SELECT parent_id, module_no, page AS page_id, done FROM l WHERE back = 1""",
    "k_media": """WITH files AS (SELECT p_partkey % 9 AS doc_id, 'image' || p_partkey || '.png' AS token, sha256(p_brand || p_type) AS hash, length(p_brand || p_type)::BIGINT AS size FROM part WHERE p_size % 5 <> 0),
refs AS (SELECT l_partkey % 9 AS doc_id, 'image' || l_partkey || '.png' AS token, (row_number() OVER (PARTITION BY l_partkey % 9 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS ref_no FROM lineitem),
r AS (SELECT refs.*, hash, size, CASE WHEN hash IS NOT NULL THEN min(ref_no) OVER (PARTITION BY refs.doc_id, hash) END AS first_ref FROM refs LEFT JOIN files ON files.doc_id = refs.doc_id AND files.token = refs.token)
SELECT doc_id, ref_no, token, hash, size, CASE WHEN hash IS NULL THEN 'missing' WHEN first_ref < ref_no THEN 'repeated' ELSE 'stored' END AS status, first_ref FROM r""",
}

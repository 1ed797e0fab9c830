"""DuckDB SQL for the structuring, rendering and block queries, over the same tables.

Where the operators use closed forms over windows, this walks: fences, brackets, dangling lines, lists and inline marks are
recursive queries that carry a state from one line, unit or mark to the next.
"""

from __future__ import annotations

from .functions import patterns as P
from .functions.dialect import RE2_SPACE, re2, sql
from .oracles import _SEQUENCES, DOC_LINES, NBSP, WITH, _detect, bare, ext, gloss, label, lines_of, m, mixed, named, path_label, prose, rep, slug, trim, unbold, words

NL = "chr(10)"
WALK = WITH.replace("WITH ", "WITH RECURSIVE ", 1)


def rtrim(c: str) -> str:
    return rep(c, r"\s+$", "")


def _string(q: str) -> str:
    return rf"{q}(?:[^{q}\\]|\\+[^\\])*{q}"


#: A line in pieces: closed strings, a slash after a colon, a comment's start, plain text, and single characters.
_PIECES = "|".join([*map(_string, "\"'`"), ":/", "//", "[^\"'`/:]+", "[\"'`:/]"])


def uncommented(c: str) -> str:
    """Without a comment: what stands before the first `//` piece, unless a string is left open before it."""
    pieces = f"regexp_extract_all({c}, {sql(_PIECES)})"
    at = lambda x: f"coalesce(nullif(list_position(p, {sql(x)}), 0), 1000000000)"
    open_ = f"least({', '.join(at(q) for q in chr(34) + chr(39) + chr(96))})"
    return f"(CASE WHEN contains({c}, '//') THEN (SELECT CASE WHEN {at('//')} < 1000000000 AND {at('//')} < {open_} THEN array_to_string(p[1:{at('//')} - 1], '') ELSE {c} END FROM (SELECT {pieces} AS p)) ELSE {c} END)"


def call(c: str) -> str:
    a = trim(ext(c, P.FIRST_CALL, 1))
    return f"({m(c, P.FIRST_CALL)} AND ({a} = '' OR {m(a, P.CALL_ARGUMENT)} OR {m(a, P.DOTTED_NAME)} OR {m(a, P.NUMBER)}))"


SCORE = " + ".join(
    f"CASE WHEN {test} THEN {weight} ELSE 0 END"
    for test, weight in (
        (named("t", "keyword_start"), 3), (named("t", "shell_start"), 3), (named("t", "api_tokens"), 3), (m("t", P.ARROW), 3), ("ends_code", 2), ("tail", 3),
        (f"{m('tt', P.KEY_VALUE)} AND words <= 12", 2), (m("t", P.METHOD_START), 2), (f"{m('tt', P.CALL_AT_END)} AND words <= 10 AND NOT {gloss(ext('tt', P.CALL_AT_END, 1))}", 2),
        (m("t", P.OPERATORS), 1), (m("t", P.MEMBER), 1), (m("t", P.BRACKET), 1), (f"NOT {named('t', 'accented')}", 1), ("words <= 4", 1),
    )
)


def kinds(source: str) -> str:
    """The rows of `source`, which have a column raw, with their line_kind."""
    bold_code = " OR ".join([named("inner_text", "hard_syntax"), named("inner_text", "keyword_start"), m("inner_text", P.ARROW), m("inner_text", P.STATEMENT_END), call("inner_text")])
    return f"""(SELECT *, CASE WHEN tt = '' THEN 'unknown' WHEN {m('raw', P.AUTOLINK_LINE)} OR {m('tt', P.BARE_URL)} OR {m('raw', P.ANCHOR_LINK)} OR {m('raw', P.ONLY_LINKS)} THEN 'prose'
WHEN {m('t', P.COMMENT_START)} OR ({m('raw', P.NBSP_INDENT)} AND {m('raw', P.NBSP_START)}) OR (nb > 0 AND nb >= 0.5 * (nb + sp)) OR {m('t', P.HTML_TAG_START)} OR {m('t', P.DOCTYPE_START, 'i')} OR {m('tt', P.ONLY_CLOSERS)} OR {m('tt', P.LONE_OPENER)} THEN 'code'
WHEN {m('tt', P.BOLD_LINE)} THEN CASE WHEN {bold_code} THEN 'code' ELSE 'prose' END
WHEN words >= 7 AND {named('t', 'connectors')} AND NOT ends_code AND NOT {named('t', 'hard_syntax')} THEN 'prose'
WHEN {label('t')} OR {mixed('t')} OR {path_label('t')} THEN 'prose'
WHEN words >= 6 AND {named('t', 'accented')} AND {m('tt', P.SENTENCE_COLON_END)} AND NOT ends_code THEN 'prose'
WHEN score >= 4 OR (score >= 3 AND words <= 8) THEN 'code' ELSE 'unknown' END AS line_kind
FROM (SELECT *, {SCORE} AS score FROM (SELECT *, {m('body', P.CODE_END)} AS ends_code, length(body) > 0 AND length(body) < length(tt) AS tail, {trim(ext('tt', P.BOLD_LINE, 1))} AS inner_text,
length(raw) - length(replace(raw, {NBSP}, '')) AS nb, length(raw) - length(replace(raw, ' ', '')) AS sp
FROM (SELECT *, {trim('t')} AS tt, {words('t')} AS words, {trim('code_part')} AS body FROM (SELECT *, {uncommented('t')} AS code_part FROM (SELECT *, {bare('raw')} AS t FROM {source}))))))"""


def fenced(lines: str, keys: str, name: str = "x") -> str:
    """CTEs that walk the lines (keys, line_no from 0, line) and say which are inside a fence and which open one."""
    same = " AND ".join(f"l.{k} = w.{k}" for k in keys.split(", "))
    own = ", ".join(f"l.{k}" for k in keys.split(", "))
    return f"""{name}_marked AS MATERIALIZED (SELECT {keys}, line_no, line, CASE WHEN {m('line', P.FENCE_BARE)} THEN 'B' WHEN starts_with(line, '```') THEN 'O' ELSE 'N' END AS k FROM {lines}),
{name}_walk AS (SELECT {keys}, line_no, line, k, false AS inside, k <> 'N' AS then_inside FROM {name}_marked WHERE line_no = 0
UNION ALL SELECT {own}, l.line_no, l.line, l.k, w.then_inside, CASE WHEN w.then_inside THEN l.k <> 'B' ELSE l.k <> 'N' END FROM {name}_walk w JOIN {name}_marked l ON {same} AND l.line_no = w.line_no + 1),
{name} AS MATERIALIZED (SELECT {keys}, line_no, line, inside OR k <> 'N' AS in_fence, NOT inside AND k <> 'N' AS opens FROM {name}_walk)"""


_TEXTS = f"string_split_regex(line, {sql(re2(P.IMAGE))})"
_SOURCES = f"regexp_extract_all(line, {sql(re2(P.IMAGE))}, 1)"

UNITS = f"""{WALK}, {fenced('lines', 'doc_id')},
y AS (SELECT *, NOT in_fence AND {trim('line')} = '' AS blank FROM x),
s AS (SELECT *, opens OR (NOT in_fence AND NOT blank AND coalesce(lag(blank OR in_fence) OVER (PARTITION BY doc_id ORDER BY line_no), true)) AS starts FROM y),
g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS gid FROM s),
h AS (SELECT doc_id, gid, line_no, line, in_fence, first_value(line) OVER (PARTITION BY doc_id, gid ORDER BY line_no) AS first_line, count(*) OVER (PARTITION BY doc_id, gid) AS n FROM g WHERE NOT blank),
typed AS (SELECT *, CASE WHEN in_fence THEN 'fence' WHEN n = 1 AND {m('line', P.HEADING)} THEN 'heading' WHEN {m('first_line', P.LIST)} THEN 'list' WHEN {m('first_line', P.QUOTE)} THEN 'quote' ELSE 'para' END AS gtype
FROM h WHERE NOT (in_fence AND {m('first_line', P.FENCE_HTML)})),
cut AS (SELECT *, CASE WHEN gtype IN ('fence', 'heading') OR NOT {m('line', P.IMAGE)} THEN [{{'text': line, 'src': NULL::VARCHAR}}]
ELSE list_filter(flatten(list_transform(range(1, len(texts) + 1), lambda i: [{{'text': texts[i], 'src': NULL::VARCHAR}}, {{'text': NULL::VARCHAR, 'src': srcs[i]}}])), lambda z: z.src IS NOT NULL OR {trim('z.text')} <> '') END AS els
FROM (SELECT *, {_TEXTS} AS texts, {_SOURCES} AS srcs FROM typed)),
element AS (SELECT doc_id, gid, gtype, line_no, unnest(range(len(els))) AS part, unnest(els) AS el FROM cut),
island AS (SELECT *, el.src IS NOT NULL AS is_image, sum((el.src IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no, part) AS island FROM element),
grouped AS (SELECT doc_id, gid, island, is_image, min(line_no * 100000 + part) AS spot, any_value(gtype) AS gtype, any_value(el.src) AS src, list(el.text ORDER BY line_no, part) AS ls FROM island GROUP BY 1, 2, 3, 4),
units AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1)::INT AS unit_no, CASE WHEN is_image THEN 'image' ELSE gtype END AS type,
CASE WHEN gtype = 'heading' THEN length({ext('ls[1]', P.HEADING, 1)})::INT END AS level, CASE WHEN gtype = 'heading' THEN {trim(prose(ext('ls[1]', P.HEADING, 2)))} END AS text,
src, CASE WHEN gtype <> 'heading' AND NOT is_image THEN ls END AS lines FROM grouped)"""

MODULES = f"""{UNITS}, numbered AS (SELECT *, coalesce(type = 'heading' AND level = 1, false) AS opens_module, sum(coalesce(type = 'heading' AND level = 1, false)::INT) OVER (PARTITION BY doc_id ORDER BY unit_no) AS seq FROM units),
counted AS (SELECT doc_id, seq, max(text) FILTER (opens_module) AS title, count(*) FILTER (NOT opens_module) AS n,
count(*) FILTER (NOT opens_module AND len(list_filter(coalesce(lines, []), lambda l: {m('l', P.ANCHOR_LINK)})) > 0) AS anchors FROM numbered WHERE seq > 0 GROUP BY 1, 2),
judged AS (SELECT *, seq = 1 AND ({m('title', P.INDEX_TITLE, 'i')} OR anchors >= greatest(3.0, n * 0.6)) AS is_index FROM counted),
modules AS (SELECT doc_id, seq, title, (seq - (bool_or(is_index) OVER (PARTITION BY doc_id))::INT)::BIGINT AS module_no, is_index FROM judged),
kept AS (SELECT * FROM modules WHERE NOT is_index),
placed AS MATERIALIZED (SELECT u.doc_id, k.module_no, k.title, u.unit_no, u.type, u.level, u.text, u.src, u.lines FROM numbered u JOIN kept k ON k.doc_id = u.doc_id AND k.seq = u.seq WHERE NOT u.opens_module)"""

_VOTERS = f"""(SELECT doc_id, module_no, unit_no, CASE WHEN type = 'quote' THEN {rep('l', P.QUOTE, '')} ELSE l END AS raw FROM (SELECT doc_id, module_no, unit_no, type, unnest(lines) AS l FROM placed WHERE type IN ('para', 'quote')))"""

SETTLED = f"""{MODULES}, votes AS (SELECT doc_id, module_no, unit_no, count(*) FILTER (line_kind = 'code') AS c, count(*) FILTER (line_kind = 'prose') AS p FROM {kinds(_VOTERS)} GROUP BY 1, 2, 3),
voted AS (SELECT u.*, CASE u.type WHEN 'quote' THEN CASE WHEN c > 0 AND c >= p THEN 'code' ELSE 'quote' END WHEN 'para' THEN CASE WHEN c > p THEN 'code' WHEN p > c THEN 'prose' ELSE 'unknown' END ELSE u.type END AS vote
FROM placed u LEFT JOIN votes v ON v.doc_id = u.doc_id AND v.module_no = u.module_no AND v.unit_no = u.unit_no),
around AS (SELECT u.doc_id, u.module_no, u.unit_no, arg_max(k.vote, k.unit_no) FILTER (k.unit_no < u.unit_no) AS before, arg_min(k.vote, k.unit_no) FILTER (k.unit_no > u.unit_no) AS later
FROM voted u JOIN voted k ON k.doc_id = u.doc_id AND k.module_no = u.module_no AND k.vote <> 'unknown' WHERE u.vote = 'unknown' GROUP BY 1, 2, 3),
resolved AS (SELECT u.*, CASE WHEN vote <> 'unknown' THEN vote WHEN before = 'code' AND later = 'code' THEN 'code' ELSE 'prose' END AS known FROM voted u LEFT JOIN around a ON a.doc_id = u.doc_id AND a.module_no = u.module_no AND a.unit_no = u.unit_no),
between_code AS (SELECT *, coalesce(known = 'prose' AND type = 'para' AND lag(known) OVER w = 'code' AND lead(known) OVER w = 'code', false) AS inner_prose, {trim(bare("coalesce(array_to_string(lines, ' '), '')"))} AS joined
FROM resolved WINDOW w AS (PARTITION BY doc_id, module_no ORDER BY unit_no)),
settled AS MATERIALIZED (SELECT * EXCLUDE (vote, known, inner_prose, joined), CASE WHEN inner_prose AND NOT ({label('joined')} OR {mixed('joined')} OR {path_label('joined')}) AND {words('joined')} <= 6 AND NOT ({m('joined', P.SENTENCE_END)} AND {words('joined')} >= 5) THEN 'code' ELSE known END AS kind FROM between_code)"""


def dangling(source: str, keys: str, name: str = "dangling") -> str:
    """CTE (keys, r, o, acc): walks the lines (keys, r from 1, line); acc is output line o as it stands after line r."""
    same = " AND ".join(f"l.{k} = w.{k}" for k in keys.split(", "))
    own = ", ".join(f"l.{k}" for k in keys.split(", "))
    joins = f"{m('w.acc', P.DANGLING)} AND {trim('l.line')} <> ''"
    return f"""{name} AS (SELECT {keys}, r, 1 AS o, line AS acc FROM {source} WHERE r = 1
UNION ALL SELECT {own}, l.r, CASE WHEN {joins} THEN w.o ELSE w.o + 1 END, CASE WHEN {joins} THEN {rtrim('w.acc')} || ' ' || {trim('l.line')} ELSE l.line END FROM {name} w JOIN {source} l ON {same} AND l.r = w.r + 1)"""


_PLAIN = f"list_transform(lines, lambda l: {rep('l', P.QUOTE, '')})"
_FILLED = f"list_filter({_PLAIN}, lambda l: {trim('l')} <> '')"
_BLANKS = f"(len(lines) - len({_FILLED}))"
_CODE_LINES = f"""list_transform(CASE WHEN type <> 'quote' THEN lines WHEN {_BLANKS} > 0 AND {_BLANKS} * 3 >= len(lines) THEN {_FILLED} ELSE {_PLAIN} END, lambda l: {rtrim(f"replace({unbold(bare('l'))}, {NBSP}, ' ')")})"""


def _less(chars: str) -> str:
    c = "joined"
    for x in chars:
        c = f"replace({c}, '{x}', '')"
    return f"(length(joined) - length({c}))"


def left(c: str, width: int) -> str:
    return f"(CASE WHEN length({c}::VARCHAR) >= {width} THEN {c}::VARCHAR ELSE lpad({c}::VARCHAR, {width}, ' ') END)"


_FILE = f"CASE WHEN length(module_no::VARCHAR) >= 2 THEN module_no::VARCHAR ELSE lpad(module_no::VARCHAR, 2, '0') END || '-' || {slug('title')} || '.md'"
_COUNTED = {"code": "counted = 'code'", "images": "counted = 'image'", "headings": "counted = 'heading'", "lists": "counted = 'list'", "paras": "counted = 'para'", "quotes": "counted = 'quote'"}

RENDERED = f"""{SETTLED}, with_code AS (SELECT *, CASE WHEN kind = 'code' THEN {_CODE_LINES} END AS code_lines FROM settled),
netted AS (SELECT *, coalesce(array_to_string(code_lines, {NL}), '') AS joined, row_number() OVER (PARTITION BY doc_id, module_no ORDER BY unit_no) AS k, {m(trim("coalesce(code_lines[1], '')"), '^[{[]')} AS root FROM with_code),
cu AS MATERIALIZED (SELECT doc_id, module_no, title, unit_no, kind = 'code' AS code, code_lines, k, root, {_less('{[')} - {_less('}]')} AS net FROM netted),
seg AS (SELECT doc_id, module_no, k, code, CASE WHEN code THEN unit_no END AS seg, CASE WHEN code THEN greatest(0, net) ELSE 0 END AS depth, code AND root AS run_root FROM cu WHERE k = 1
UNION ALL SELECT c.doc_id, c.module_no, c.k, c.code, CASE WHEN NOT c.code THEN NULL WHEN NOT p.code OR (c.root AND p.run_root AND p.depth = 0) THEN c.unit_no ELSE p.seg END,
CASE WHEN NOT c.code THEN 0 WHEN NOT p.code THEN greatest(0, c.net) ELSE greatest(0, p.depth + c.net) END, CASE WHEN NOT c.code THEN false WHEN NOT p.code THEN c.root ELSE p.run_root END
FROM seg p JOIN cu c ON c.doc_id = p.doc_id AND c.module_no = p.module_no AND c.k = p.k + 1),
code_line AS (SELECT c.doc_id, c.module_no, c.title, s.seg, c.unit_no, unnest(range(len(c.code_lines))) AS pos, unnest(c.code_lines) AS line FROM cu c JOIN seg s ON s.doc_id = c.doc_id AND s.module_no = c.module_no AND s.k = c.k WHERE c.code),
ordered_line AS MATERIALIZED (SELECT doc_id, module_no, seg, title, line, row_number() OVER (PARTITION BY doc_id, module_no, seg ORDER BY unit_no, pos) AS r FROM code_line),
{dangling('ordered_line', 'doc_id, module_no, seg')},
merged AS (SELECT doc_id, module_no, seg, o, arg_max(acc, r) AS line FROM dangling GROUP BY 1, 2, 3, 4),
pieces AS (SELECT *, coalesce(sum({m('line', P.DOCUMENT_END, 'i')}::INT) OVER (PARTITION BY doc_id, module_no, seg ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS piece FROM merged),
blocked AS (SELECT doc_id, module_no, seg, piece, string_agg(line, {NL} ORDER BY o) AS code, max(piece) OVER (PARTITION BY doc_id, module_no, seg) AS last_piece FROM pieces GROUP BY 1, 2, 3, 4),
headed AS (SELECT doc_id, module_no, seg, piece, last_piece, CASE WHEN piece = 0 THEN regexp_replace(code, '^\\n+', '') ELSE code END AS code FROM blocked),
tailed AS (SELECT doc_id, module_no, seg, piece, CASE WHEN piece = last_piece THEN regexp_replace(code, '\\n+\\z', '') ELSE code END AS code FROM headed),
listed AS (SELECT t.*, title, list_filter(list_transform(string_split(code, {NL}), lambda x: {trim('x')}), lambda x: x <> '') AS ls FROM tailed t JOIN (SELECT DISTINCT doc_id, module_no, title FROM cu) USING (doc_id, module_no) WHERE {trim('code')} <> ''),
bodied AS (SELECT *, array_to_string(ls, {NL}) AS body FROM listed),
chunks AS (SELECT doc_id, module_no, seg AS unit_no, piece, 'code' AS counted, '```' || ({_detect('code', 'title')}) || {NL} || code || {NL} || '```' || {NL} AS chunk FROM bodied
UNION ALL SELECT doc_id, module_no, unit_no, 0, type, CASE type WHEN 'heading' THEN repeat('#', least(level, 6)) || ' ' || text WHEN 'image' THEN '![](' || string_split(regexp_replace(src, '/+\\z', ''), '/')[-1] || ')'
WHEN 'fence' THEN array_to_string(lines, {NL}) ELSE array_to_string(list_transform(lines, lambda l: {rtrim(prose('l'))}), {NL}) END || {NL} FROM settled WHERE kind <> 'code'),
bodies AS (SELECT doc_id, module_no, string_agg(chunk, {NL} ORDER BY unit_no, piece) AS body, {', '.join(f'count(*) FILTER ({c})::INT AS n_{k}' for k, c in _COUNTED.items())} FROM chunks GROUP BY 1, 2),
texts AS (SELECT k.doc_id, k.module_no, k.title, {rtrim(f"regexp_replace(coalesce(body, ''), '\\n{{3,}}', {NL} || {NL}, 'g')")} || {NL} AS inner_text, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _COUNTED)} FROM kept k LEFT JOIN bodies USING (doc_id, module_no)),
rendered AS MATERIALIZED (SELECT doc_id, module_no, title, {_FILE} AS file, '# ' || title || {NL} || {NL} || inner_text AS text, coalesce(array_to_string(regexp_extract_all(inner_text, {sql(re2(P.RENDERED_IMAGE))}, 1), ','), '') AS images, {', '.join(f'n_{k}' for k in _COUNTED)} FROM texts)"""

_REPORT = f"{left('module_no', 2)} || '  ' || CASE WHEN length(file) >= 42 THEN file ELSE rpad(file, 42, ' ') END || ' código=' || {left('n_code', 3)} || '  imgs=' || {left('n_images', 3)} || '  H2=' || {left('n_headings', 2)} || '  párr=' || {left('n_paras', 3)} || '  listas=' || {left('n_lists', 3)}"


def blocks_of(source: str) -> str:
    """CTEs up to `block` (doc_id, module_no, block_no, kind, type, content, language, token, depth, parent_no) for the texts of `source`."""
    lang = f"lower({trim('substr(first_line, 4)')})"
    item = lambda i: f"CASE WHEN kind = 'bulleted_list_item' THEN {ext('first_line', P.BLOCK_BULLET, i)} ELSE {ext('first_line', P.BLOCK_NUMBER, i)} END"
    return f"""text_line AS MATERIALIZED (SELECT doc_id, module_no, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, module_no, string_split(text, {NL}) AS l FROM {source})),
{fenced('text_line', 'doc_id, module_no', 'b')},
lined AS (SELECT *, CASE WHEN in_fence THEN 'code' WHEN {trim('line')} = '' THEN 'blank' WHEN {m('line', P.BLOCK_IMAGE)} THEN 'image' WHEN {m('line', P.BLOCK_HEADING)} THEN 'heading'
WHEN {m('line', P.BLOCK_BULLET)} THEN 'bulleted_list_item' WHEN {m('line', P.BLOCK_NUMBER)} THEN 'numbered_list_item' ELSE 'paragraph' END AS kind FROM b WHERE NOT (line_no = 0 AND starts_with(line, '# ') AND {m('line', P.BLOCK_HEADING)})),
block_line AS (SELECT doc_id, module_no, line_no, line, kind, (sum((kind <> 'code' OR opens)::INT) OVER (PARTITION BY doc_id, module_no ORDER BY line_no) - 1)::BIGINT AS block_no FROM lined WHERE kind <> 'blank'),
raw_block AS (SELECT doc_id, module_no, block_no, any_value(kind) AS kind, arg_min(line, line_no) AS first_line, list(line ORDER BY line_no) AS ls FROM block_line GROUP BY 1, 2, 3),
ran AS (SELECT *, kind IN ('bulleted_list_item', 'numbered_list_item') AS is_item, coalesce(lag(kind) OVER (PARTITION BY doc_id, module_no ORDER BY block_no) = kind, false) AS goes_on FROM raw_block),
deep AS MATERIALIZED (SELECT *, CASE WHEN is_item THEN (length({item(1)}) // 4)::INT ELSE 0 END AS wanted FROM ran),
tree AS (SELECT doc_id, module_no, block_no, 0 AS level, CASE WHEN is_item THEN [block_no] ELSE []::BIGINT[] END AS stack FROM deep WHERE block_no = 0
UNION ALL SELECT d.doc_id, d.module_no, d.block_no, CASE WHEN d.is_item AND d.goes_on THEN least(d.wanted, len(t.stack))::INT ELSE 0 END,
CASE WHEN NOT d.is_item THEN []::BIGINT[] WHEN d.goes_on THEN list_append(t.stack[1:least(d.wanted, len(t.stack))::INT], d.block_no) ELSE [d.block_no] END
FROM tree t JOIN deep d ON d.doc_id = t.doc_id AND d.module_no = t.module_no AND d.block_no = t.block_no + 1),
block AS MATERIALIZED (SELECT d.doc_id, d.module_no, d.block_no, kind, CASE kind WHEN 'heading' THEN 'heading_' || length({ext('first_line', P.BLOCK_HEADING, 1)}) WHEN 'image' THEN 'callout' ELSE kind END AS type,
CASE WHEN kind = 'heading' THEN {ext('first_line', P.BLOCK_HEADING, 2)} WHEN kind = 'image' THEN '![](' || {ext('first_line', P.BLOCK_IMAGE, 1)} || ')' WHEN is_item THEN {item(2)}
WHEN kind = 'code' THEN array_to_string(CASE WHEN len(ls) > 1 AND {m('ls[-1]', P.FENCE_BARE)} THEN ls[2:len(ls) - 1] ELSE ls[2:] END, {NL}) ELSE {trim('first_line')} END AS content,
CASE WHEN kind = 'code' THEN CASE WHEN {lang} IN ({', '.join(map(sql, P.SAFE_LANGUAGES))}) THEN {lang} ELSE {sql(P.PLAIN_TEXT)} END END AS language, CASE WHEN kind = 'image' THEN {ext('first_line', P.BLOCK_IMAGE, 1)} END AS token,
t.level AS depth, t.stack[len(t.stack) - 1] AS parent_no FROM deep d JOIN tree t ON t.doc_id = d.doc_id AND t.module_no = d.module_no AND t.block_no = d.block_no)"""


#: A text in marks: escapes, code, links, addresses, bold, italic, and single characters.
_MARKS = sql(rf"(?s)\\.|`[^`]*`|\[[^\]]*\]\([^){RE2_SPACE}]+\)|(?:https?|ftp)://[^{RE2_SPACE}<>()]+|\*\*.*?\*\*|\*[^*\n]+\*|.")
_BOLD = "(length(mark) >= 4 AND starts_with(mark, '**') AND ends_with(mark, '**'))"
_ITALIC = f"(length(mark) >= 3 AND starts_with(mark, '*') AND NOT {_BOLD})"
_RUN = """'{"type":"text","text":{"content":' || to_json(content)::VARCHAR || coalesce(',"link":{"url":' || to_json(url)::VARCHAR || '}', '') || '}' || CASE WHEN bold OR italic OR code THEN ',"annotations":{' || array_to_string(list_filter([CASE WHEN bold THEN '"bold":true' END, CASE WHEN italic THEN '"italic":true' END, CASE WHEN code THEN '"code":true' END], lambda x: x IS NOT NULL), ',') || '}' ELSE '' END || '}'"""

RICH = f"""{RENDERED}, {blocks_of('rendered')},
spelled AS (SELECT doc_id, module_no, block_no, [i] AS path, marks[i] AS mark, false AS bold, false AS italic FROM (SELECT doc_id, module_no, block_no, regexp_extract_all(content, {_MARKS}) AS marks FROM block WHERE kind NOT IN ('code', 'image')) q, unnest(range(1, len(q.marks) + 1)) AS u(i)
UNION ALL SELECT doc_id, module_no, block_no, list_append(path, i), marks[i], bold OR is_bold, italic OR NOT is_bold
FROM (SELECT *, {_BOLD} AS is_bold, regexp_extract_all(CASE WHEN {_BOLD} THEN mark[3:-3] ELSE mark[2:-2] END, {_MARKS}) AS marks FROM spelled WHERE {_BOLD} OR {_ITALIC}) q, unnest(range(1, len(q.marks) + 1)) AS u(i)),
leaf AS (SELECT *, CASE WHEN length(mark) = 1 OR starts_with(mark, '\\') THEN 'plain' WHEN starts_with(mark, '`') THEN 'code' WHEN starts_with(mark, '[') THEN 'link' ELSE 'address' END AS sort FROM spelled WHERE NOT ({_BOLD} OR {_ITALIC})),
parted AS (SELECT *, CASE WHEN sort = 'plain' AND lag(sort) OVER w = 'plain' AND lag(path[1:len(path) - 1]) OVER w = path[1:len(path) - 1] AND lag(path[-1]) OVER w = path[-1] - 1 THEN 0 ELSE 1 END AS fresh FROM leaf WINDOW w AS (PARTITION BY doc_id, module_no, block_no ORDER BY path)),
told AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, module_no, block_no ORDER BY path) AS run,
CASE sort WHEN 'code' THEN mark[2:-2] WHEN 'link' THEN coalesce(nullif(regexp_extract(mark, '(?s)^\\[([^\\]]*)\\]', 1), ''), regexp_extract(mark, '(?s)\\]\\((.*)\\)$', 1)) WHEN 'plain' THEN CASE WHEN length(mark) = 2 THEN mark[2:] ELSE mark END ELSE mark END AS said,
CASE sort WHEN 'link' THEN regexp_extract(mark, '(?s)\\]\\((.*)\\)$', 1) WHEN 'address' THEN mark END AS url FROM parted),
runs AS (SELECT doc_id, module_no, block_no, run, string_agg(said, '' ORDER BY path) AS content, any_value(url) AS url, any_value(bold) AS bold, any_value(italic) AS italic, any_value(sort) = 'code' AS code FROM told GROUP BY 1, 2, 3, 4
UNION ALL SELECT doc_id, module_no, block_no, 1, content, NULL, false, false, kind = 'image' FROM block WHERE kind IN ('code', 'image')),
rich AS (SELECT doc_id, module_no, block_no, string_agg({_RUN}, ',' ORDER BY run) AS rich FROM runs GROUP BY 1, 2, 3)"""
BLOCKS = f"""{RICH} SELECT doc_id, module_no, block_no, type, language, token, depth, parent_no, '[' || coalesce(rich, '') || ']' AS rich_text FROM block LEFT JOIN rich USING (doc_id, module_no, block_no)"""


def folded(source: str, keys: str, name: str = "fold") -> str:
    """CTE `name` (keys, no, parent, level, open, shut, d, kids): the rows of `source` (keys, no, parent, level, open, shut), from the deepest level
    to the top; with each level its objects go into their parents. The rows of d = 0 have all their children."""
    same = " AND ".join(f"c.{k} = p.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    child = "c.open || CASE WHEN c.kids <> '' THEN ',\"children\":[' || c.kids || ']' ELSE '' END || c.shut"
    return f"""{name} AS (SELECT {keys}, no, parent, level, open, shut, (SELECT max(level) FROM {source}) AS d, ''::VARCHAR AS kids FROM {source}
UNION ALL SELECT {own}, p.no, p.parent, p.level, p.open, p.shut, p.d - 1, CASE WHEN p.level = p.d - 1 THEN coalesce(string_agg({child}, ',' ORDER BY c.no), '') ELSE p.kids END
FROM {name} p LEFT JOIN {name} c ON {same} AND c.parent = p.no AND c.level = p.d AND p.level = p.d - 1 WHERE p.level < p.d GROUP BY {own}, p.no, p.parent, p.level, p.open, p.shut, p.d, p.kids)"""


_TOP = "open || CASE WHEN kids <> '' THEN ',\"children\":[' || kids || ']' ELSE '' END || shut"
NESTED = f"""{RICH}, object AS MATERIALIZED (SELECT doc_id, module_no, block_no AS no, parent_no AS parent, depth AS level, '{{"object":"block","type":"' || kind_ || '","' || kind_ || '":{{' || CASE WHEN kind = 'code' THEN '"language":' || to_json(language)::VARCHAR || ',' ELSE '' END
|| '"rich_text":[' || coalesce(rich, '') || ']' || CASE WHEN kind = 'heading' THEN ',"is_toggleable":false' ELSE '' END AS open, '}}' || CASE WHEN kind = 'image' THEN ',"_marker":' || to_json(token)::VARCHAR ELSE '' END || '}}' AS shut
FROM (SELECT *, CASE WHEN kind = 'image' THEN 'paragraph' ELSE type END AS kind_ FROM block) LEFT JOIN rich USING (doc_id, module_no, block_no)), {folded('object', 'doc_id, module_no')}
SELECT doc_id, module_no, no AS block_no, {_TOP} AS json FROM fold WHERE d = 0"""

NESTED_LISTS = f"""WITH RECURSIVE i AS (SELECT l_orderkey AS id, l_partkey, l_partkey % 7 AS depth, row_number() OVER w AS no FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
w AS (SELECT id, no, l_partkey, 0::BIGINT AS level, [no] AS stack FROM i WHERE no = 1
UNION ALL SELECT i.id, i.no, i.l_partkey, least(i.depth, len(w.stack))::BIGINT, list_append(w.stack[1:least(i.depth, len(w.stack))::INT], i.no) FROM w JOIN i ON i.id = w.id AND i.no = w.no + 1),
object AS MATERIALIZED (SELECT id, no, stack[len(stack) - 1] AS parent, level, '{{"object":"block","type":"bulleted_list_item","bulleted_list_item":{{"rich_text":[{{"type":"text","text":{{"content":"p \\"' || l_partkey || '\\"\\n"}}}}]' AS open, '}}}}' AS shut FROM w), {folded('object', 'id')},
top AS (SELECT id, no, {_TOP} AS json, (row_number() OVER (PARTITION BY id ORDER BY no) - 1) // 3 AS batch_no FROM fold WHERE d = 0)
SELECT id, batch_no::INT AS batch_no, count(*) AS n_blocks, '[' || string_agg(json, ',' ORDER BY no) || ']' AS children FROM top GROUP BY 1, 2"""

_PAGES = """pages_md AS (SELECT conv_id AS doc_id, turn AS module_no, '# T' || chr(10) || chr(10) || '## ' || role || chr(10) || '- a' || chr(10) || '    - b' || chr(10) || chr(10) || '- c' || chr(10) || '1. d' || chr(10) || coalesce(text, '') AS text FROM conversations)"""

STRUCTURE: dict[str, str] = {
    "f_line_comment": f"""{WITH}, x AS (SELECT line FROM lines UNION ALL SELECT 'go(''' || url || '''); // from ' || url FROM pages), d AS (SELECT line, count(*) AS n FROM x GROUP BY 1) SELECT line, {uncommented('line')} AS code, n FROM d""",
    "c_line_kinds": f"""{WITH}, x AS (SELECT line AS raw FROM {DOC_LINES} UNION ALL SELECT line FROM {lines_of('pages', 'page_id', 'html')}) SELECT line_kind, count(*) AS n, sum(length(raw))::BIGINT AS chars FROM {kinds('x')} GROUP BY 1""",
    "c_kinds_by_line": f"""{WITH}, x AS (SELECT line AS raw, count(*) AS n FROM (SELECT line FROM {DOC_LINES} UNION ALL SELECT line FROM {lines_of('pages', 'page_id', 'html')}) GROUP BY 1) SELECT raw AS line, n, line_kind FROM {kinds('x')}""",
    "t_fences": f"""{WALK}, {fenced('lines', 'doc_id')} SELECT doc_id, sum(in_fence::INT)::BIGINT AS fenced, sum(opens::INT)::BIGINT AS fences FROM x GROUP BY 1""",
    "t_units": f"{UNITS} SELECT doc_id, unit_no, type, level, text, src, array_to_string(lines, {NL}) AS body FROM units",
    "t_unit_counts": f"{UNITS} SELECT doc_id, type, count(*) AS n FROM units GROUP BY 1, 2",
    "t_headings": f"{UNITS} SELECT doc_id, level::BIGINT AS level, text FROM units WHERE type = 'heading'",
    "m_modules": f"{MODULES} SELECT doc_id, module_no, title FROM kept",
    "u_kinds": f"{SETTLED} SELECT doc_id, module_no, type, kind, count(*) AS n FROM settled GROUP BY 1, 2, 3, 4",
    "u_resolve_unknowns": f"""WITH {_SEQUENCES}, near AS (SELECT u.seq_id, u.pos, arg_max(k.kind, k.pos) FILTER (k.pos < u.pos) AS b, arg_min(k.kind, k.pos) FILTER (k.pos > u.pos) AS a FROM seqs u JOIN seqs k ON k.seq_id = u.seq_id AND k.kind <> 'unknown' WHERE u.kind = 'unknown' GROUP BY 1, 2)
SELECT seq_id, CASE WHEN kind <> 'unknown' THEN kind WHEN b = 'code' AND a = 'code' THEN 'code' ELSE 'prose' END AS kind, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM seqs LEFT JOIN near USING (seq_id, pos) GROUP BY 1, 2""",
    "r_modules": f"{RENDERED} SELECT doc_id, module_no, title, file, text, images, {', '.join(f'n_{k}' for k in _COUNTED)}, {_REPORT} AS report FROM rendered",
    "r_join_dangling": f"""WITH RECURSIVE l AS MATERIALIZED (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r,
CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'const url =' WHEN 1 THEN '=' WHEN 2 THEN '' ELSE '  v' || l_partkey END AS line FROM lineitem), {dangling('l', 'id')},
merged AS (SELECT id, o, arg_max(acc, r) AS line FROM dangling GROUP BY 1, 2) SELECT id, string_agg(line, {NL} ORDER BY o) AS code FROM merged GROUP BY 1""",
    "b_blocks": BLOCKS,
    "b_nested": NESTED,
    "b_image_refs": f"{RENDERED}, {blocks_of('rendered')} SELECT doc_id, module_no, (row_number() OVER (PARTITION BY doc_id, module_no ORDER BY block_no) - 1)::INT AS ref_no, token FROM block WHERE token IS NOT NULL",
    "b_nested_lists": NESTED_LISTS,
    "b_page_blocks": f"WITH RECURSIVE {_PAGES}, {blocks_of('pages_md')} SELECT doc_id, type, count(*) AS n, sum(depth)::BIGINT AS depths FROM block GROUP BY 1, 2",
}
#: The same rows, worked out in blocks.
STRUCTURE |= {"t_fences_segmented": STRUCTURE["t_fences"], "u_kinds_segmented": STRUCTURE["u_kinds"]}
#: The same modules, whether they come from a cache or not.
STRUCTURE["r_incremental"] = STRUCTURE["r_modules"]
_ENTRY = f"""'{{"number":' || module_no || ',"title":' || to_json(title)::VARCHAR || ',"file":' || to_json('modules/' || file)::VARCHAR || ',"images":' || to_json(CASE WHEN images = '' THEN [] ELSE string_split(images, ',') END)::VARCHAR || ',"stats":{{' || {" || ',' || ".join(f"""'"{k}":' || n_{k}""" for k in _COUNTED)} || '}}}}'"""
STRUCTURE["r_manifests"] = f"{RENDERED} SELECT doc_id, '[' || string_agg({_ENTRY}, ',' ORDER BY module_no) || ']' AS modules, string_agg({_REPORT} || {NL}, '' ORDER BY module_no) AS report FROM rendered GROUP BY 1"

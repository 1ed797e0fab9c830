"""DuckDB SQL for the queries here that SQL can express over whole tables."""

from __future__ import annotations

_SAID = r"\### Assistant: </turn> ok"

CHAT = rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
e AS (SELECT *, 14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

_REACH = """reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_reached AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)), {_REACH}
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id FROM words w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN least_reached ON a = w.doc_id"""

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93), {_REACH},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(r.b, vec_id)) AS component_id, vec_id <= coalesce(r.b, vec_id) AS kept FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least_reached r ON r.a = vec_id"""

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings WHERE {_USABLE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

RESAMPLING = r"""WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
split AS (SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM texts),
held AS (SELECT side, id, w, count(*) AS n FROM (SELECT side, id, unnest(ws) AS w FROM split) GROUP BY ALL),
spelled AS (SELECT w, list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT w FROM held)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 10000 AS bucket FROM spelled, steps),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t FROM held JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, sums),
weights AS (SELECT id, sum(n * gain)::BIGINT AS weight FROM held JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT s.id AS doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || s.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM split s LEFT JOIN weights w ON w.id = s.id WHERE side = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS draw FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draw THEN place END AS rank FROM placed"""

MIXING = r"""WITH quality AS (SELECT doc_id, 1 + 3 * greatest(0, least(1, avg(quality))) AS w FROM labels WHERE quality IS NOT NULL GROUP BY 1),
sized AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
-ln((('0x' || substr(sha256('13:' || d.doc_id || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / coalesce(w, 2) AS key FROM documents d LEFT JOIN quality q ON q.doc_id = d.doc_id),
sources AS (SELECT source, sum(size)::BIGINT AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source),
ratios AS (SELECT *, sum(size) OVER ()::BIGINT AS total, coalesce(sum(3 * size) OVER before, 0)::BIGINT AS limits, sum(weight) OVER onwards::BIGINT AS open FROM sources
WINDOW before AS (ORDER BY 3 * size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), onwards AS (ORDER BY 3 * size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
limited AS (SELECT *, weight * (total - limits) > 3 * size * open AS at_limit FROM ratios),
rest AS (SELECT max(total) - coalesce(sum(3 * size) FILTER (at_limit), 0)::BIGINT AS words, sum(weight) FILTER (NOT at_limit)::BIGINT AS weights FROM limited),
targets AS (SELECT source, size AS source_size, CASE WHEN at_limit THEN (3 * size)::DOUBLE ELSE (weight * words)::DOUBLE / weights END AS target FROM limited, rest),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
walked AS (SELECT s.*, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS rest, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id)::BIGINT - size AS before FROM sized s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs::BIGINT AS epochs, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM walked"""

ORACLES = {"op1_chat_format": CHAT, "op7_ngram_jaccard": JACCARD, "op9_embedding_dedup": NEAR_VECTORS, "op10_top_k": TOP_K, "op12_importance_resampling": RESAMPLING, "op13_source_mixing": MIXING}

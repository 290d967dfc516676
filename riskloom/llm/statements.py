"""DuckDB statements for those queries of this subpackage that SQL can express."""

from __future__ import annotations

# Filters A to E: the failure conditions, then every order and step over the counted combinations.
FILTER_AUDIT = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), label AS (
    SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id
), failing AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
        CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
    FROM words LEFT JOIN label ON words.doc_id = label.doc_id
), cells AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM failing GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), told AS (
    SELECT part, filter_order, step, f, n, cells.good, cells.toxic, contains(fails, f) AS own,
        length(translate(earlier, fails, '')) < length(earlier) AS gone, fails = f AS alone
    FROM steps, cells
), figures AS (
    SELECT part, filter_order, step, f,
        sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM told GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM figures
"""

# Words of documents and items; windows of each length that items have, joined as word lists; hit words as a union of spans.
DECONTAMINATION = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), b AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
    SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, places.n, item FROM places JOIN windows ON places.n = windows.n AND places.win = windows.win),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# Pairs of documents by shingles in common, then the least document reachable over links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 3) - 1) AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)
), links AS (SELECT x AS a, y AS b FROM pairs UNION SELECT y, x FROM pairs),
reach AS (
    SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM links)
    UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a WHERE r.root < l.b
), least_root AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_root ON node = d.doc_id
"""

TOP_INNER_PRODUCTS = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

VECTOR_LINKS = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT p.vec_id AS x, q.vec_id AS y FROM sound p JOIN sound q ON p.label = q.label AND p.vec_id < q.vec_id
    WHERE list_cosine_similarity(p.v, q.v) >= 0.93
), links AS (SELECT x AS a, y AS b FROM pairs UNION SELECT y, x FROM pairs),
reach AS (
    SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM links)
    UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a WHERE r.root < l.b
), least_root AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counted ON a = e.vec_id LEFT JOIN least_root ON node = e.vec_id
"""

# Turns in order, those of assistants under the loss mask, and the length of the form of chat.render.
CHAT_FORMAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
    SELECT *, CASE WHEN role = 'assistant' THEN t ELSE '' END AS learnt,
        length(regexp_replace(role || chr(0) || t, '(</?s>|\[/?(?:ROLE|INST)\]|<</?SYS>>)', '\\\1', 'g')) - 1 + length('<s>[ROLE]  [/ROLE]  </s>') AS size
    FROM turns
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
    CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role)) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""

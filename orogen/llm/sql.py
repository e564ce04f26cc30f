"""DuckDB SQL for the registered queries that SQL can express, written from their contracts.

Repeated and null doc_ids are told apart by row numbers.  Token ids, XXH64, language models and packing are beyond SQL.
"""

from __future__ import annotations

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
LINE = "chr(10)"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# A turn is written raw if no mark in it could be taken for the grammar's, else with backslashes doubled and "<|" broken up.
CHAT = r"""WITH rows AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (SELECT *, contains(role, '<|text|>') OR contains(role, '<|end|>') OR contains(text, '<|end|>') AS conflict FROM rows),
sized AS (SELECT *, 10 + 8 + 7 + CASE WHEN conflict THEN length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) ELSE length(role) + length(text) END AS size FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORDS}') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
g AS MATERIALIZED (SELECT DISTINCT item_id, size, array_to_string(w[p:p+size-1], ' ') AS gram FROM (SELECT item_id, w, size, unnest(range(1, len(w)-size+2)) AS p FROM s)),
x AS (SELECT r, size, p, array_to_string(w[p:p+size-1], ' ') AS gram FROM (SELECT r, w, size, unnest(range(1, len(w)-size+2)) AS p FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)),
h AS MATERIALIZED (SELECT r, x.size, p, item_id FROM x JOIN g USING (size, gram)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p+size)) AS k FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20*coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""

LINEDEDUP = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), {LINE}) AS lines FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, line, k, translate(trim(line, {BLANKS}), {AZ}) AS key FROM (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d)),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, {LINE} ORDER BY k) FILTER (f.key IS NULL), '')) AS kept_sha256 FROM l LEFT JOIN f USING (key) GROUP BY r"""

# Base32: five hexadecimal digits are twenty bits and so four characters.
DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {a}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)"
BASE32 = " || ".join(DIGIT.format(a=5 * c + 1, s=s) for c in range(8) for s in (15, 10, 5, 0))
WARC = f"""WITH p AS MATERIALIZED (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, true AS complete FROM q"""

RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, t, w, list_filter(string_split(t, {LINE}), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS MATERIALIZED (SELECT r, p, w[p] AS a, w[p+1] AS b, w[p+2] AS c FROM (SELECT r, w, unnest(range(1, len(w)-1)) AS p FROM e WHERE len(w) >= 3)),
m AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([p, p+1, p+2]) AS k FROM g SEMI JOIN (SELECT r, a, b, c FROM g GROUP BY ALL HAVING count(*) > 1) s USING (r, a, b, c)) GROUP BY r),
v AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM e LEFT JOIN m USING (r)),
x AS (SELECT *, n_words < 50 OR 100*n_repeat_words > 50*n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 5*n_symbols > n_words OR (n_dup_lines >= 3 AND 10*n_dup_lines > 3*n_lines) OR word_chars < 2*n_words OR word_chars > 15*n_words) AS kept FROM x"""

ORACLES = {"op2_chat": CHAT, "op5_decontaminate": DECONTAMINATE, "op7_linededup": LINEDEDUP, "op8_warc": WARC, "op9_rules": RULES}

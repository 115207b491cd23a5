"""SQL (DuckDB) for the queries that SQL can express over whole tables. The others are held against brute force in
tests/llm."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "'[^\\x20\\x09-\\x0D]+'"

#: Mixing: targets by raising the rate until no more sources reach their cap; then the Pareto order.
MIXING = f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0) AS size,
  (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
sources AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM rows_ GROUP BY source),
rates(step, rate, full_, done) AS (
  SELECT 0, 0.0::DOUBLE, CAST(-1 AS BIGINT), false
  UNION ALL
  SELECT step + 1, CASE WHEN n = full_ OR rest = 0 THEN rate ELSE (total - capped) / rest END, n, n = full_ OR rest = 0
  FROM (SELECT any_value(r.step) AS step, any_value(r.rate) AS rate, any_value(r.full_) AS full_, count(*) FILTER (WHERE r.full_ >= 0 AND w * r.rate >= 2 * s) AS n,
    coalesce(sum(2 * s) FILTER (WHERE r.full_ >= 0 AND w * r.rate >= 2 * s), 0) AS capped, coalesce(sum(w) FILTER (WHERE NOT (r.full_ >= 0 AND w * r.rate >= 2 * s)), 0) AS rest, sum(s) * 1.5 AS total
    FROM sources, (SELECT * FROM rates) r WHERE NOT r.done)
  WHERE step IS NOT NULL),
goal AS (SELECT source, s, least(2 * s, w * (SELECT rate FROM rates ORDER BY step DESC LIMIT 1)) AS target FROM sources),
held AS (SELECT r.*, g.s, g.target, least(2.0::DOUBLE, CASE WHEN g.s > 0 THEN 1.0::DOUBLE * g.target / g.s ELSE 0 END) AS m FROM rows_ r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
parts AS (SELECT *, floor(m + 1e-9) AS certain, greatest(m - floor(m + 1e-9), 0) AS part FROM held),
ranked AS (SELECT *, target - sum(size * certain) OVER (PARTITION BY source) AS left_, CASE WHEN certain + 1 <= 2 AND size > 0 AND part > 0 THEN (u / (1 - u)) * ((1 - part) / part) END AS odds FROM parts),
sums AS (SELECT *, sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before_ FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target, CAST(size * (certain + CASE WHEN odds IS NOT NULL AND left_ > 0 AND before_ + size / 2.0 <= left_ THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM sums
"""

#: HTML extraction: on these pages the article element holds the article, and nothing else.
HTML = """
SELECT page_id, url, t AS text, CAST(length(t) AS BIGINT) AS n_chars FROM (
 SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(p|h1)>|<br>', ' ', 'g'), '<[^>]+>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\\s]+', ' ', 'g')) AS t FROM pages)
"""

#: Quality rules: measures in thousandths, their histograms by group, language and over all, and averaged quantiles.
QUALITY = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 3)) WHERE k > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x) AS k FROM (SELECT doc_id, unnest(l) AS x FROM texts)) WHERE k > 1 AND regexp_matches(x, {WORDS}) GROUP BY 1),
base AS MATERIALIZED (SELECT doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  coalesce(x.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, len(l) AS n_lines FROM texts LEFT JOIN lines x USING (doc_id) LEFT JOIN again a USING (doc_id)),
each_ AS (SELECT doc_id, lang, source, n_words, unnest([0, 1, 2, 3]) AS k, unnest([CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END, n_dup_lines * 1000 // n_lines,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END]) AS v FROM base),
sketch AS MATERIALIZED (SELECT lang, source, k, CASE WHEN v < 128 THEN v ELSE (length(bin(v)) - 7) * 64 + (v >> (length(bin(v)) - 7)) END AS b, count(*) AS c FROM each_ WHERE n_words > 0 GROUP BY ALL),
wider AS (SELECT 2 AS depth, * FROM sketch UNION ALL SELECT 1, lang, NULL, k, b, sum(c) FROM sketch GROUP BY lang, k, b UNION ALL SELECT 0, NULL, NULL, k, b, sum(c) FROM sketch GROUP BY k, b),
ends AS (SELECT depth, lang, source, k, any_value(n) AS n, min(b) FILTER (WHERE 2 * s >= n) AS b5, min(b) FILTER (WHERE 10 * s >= 9 * n) AS b9
  FROM (SELECT *, sum(c) OVER (PARTITION BY depth, lang, source, k ORDER BY b) AS s, sum(c) OVER (PARTITION BY depth, lang, source, k) AS n FROM wider) GROUP BY depth, lang, source, k),
points AS (SELECT depth, lang, source, k, CAST(n AS DOUBLE) AS n, CAST(((b5 - greatest(b5 // 64 - 1, 0) * 64 + 1) << CAST(greatest(b5 // 64 - 1, 0) AS INT)) - 1 AS DOUBLE) AS q5,
  CAST(((b9 - greatest(b9 // 64 - 1, 0) * 64 + 1) << CAST(greatest(b9 // 64 - 1, 0) AS INT)) - 1 AS DOUBLE) AS q9 FROM ends),
means AS (SELECT o.lang, o.source, o.k, (o.n * o.q5 + 40 * ((l.n * l.q5 + 40 * a.q5) / (l.n + 40))) / (o.n + 40) AS q5, (o.n * o.q9 + 40 * ((l.n * l.q9 + 40 * a.q9) / (l.n + 40))) / (o.n + 40) AS q9
  FROM points o JOIN points l ON l.depth = 1 AND o.k = l.k AND o.lang IS NOT DISTINCT FROM l.lang JOIN points a ON a.depth = 0 AND a.k = o.k WHERE o.depth = 2),
limits AS (SELECT *, greatest(q5 + [20, 200, 100, 1000][k + 1], q9 + 2.0::DOUBLE * (q9 - q5)) AS most FROM means),
fine AS (SELECT e.doc_id, bool_and(coalesce(e.v <= m.most, true)) AS fine FROM each_ e LEFT JOIN limits m ON e.k = m.k AND e.lang IS NOT DISTINCT FROM m.lang AND e.source IS NOT DISTINCT FROM m.source GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND fine AS kept FROM base JOIN fine USING (doc_id)
"""

DECONTAMINATION = """
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, i, w[i:i + 12] AS g, least(len(w), 13) AS m FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
starts AS (SELECT doc_id, m, i, w[i:i + m - 1] AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT s.doc_id, s.i, s.m, x.item, s.i - x.i AS d FROM starts s JOIN windows x ON s.m = x.m AND s.g = x.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
runs AS (SELECT doc_id, min(i) - 1 AS place, max(i) - min(i) + any_value(m) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, d, m ORDER BY i) AS run FROM hits) GROUP BY doc_id, item, d, m, run),
longest AS (SELECT doc_id, max(n) AS longest, min(place) FILTER (WHERE n = most) AS longest_at FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM runs) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
 CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(longest_at AS BIGINT) AS longest_at
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

CHAT = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (SELECT *, '<|turn|>' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;') || chr(10) || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;') || '<|end|>' AS line FROM turns),
sized AS (SELECT *, CAST(ceil((2 * length(line) + 3 * (strlen(line) - length(line))) / 8.0) AS BIGINT) AS tokens, length(line) AS chars FROM written),
systems AS (SELECT *, CASE WHEN role = 'system' THEN CASE WHEN tokens <= 512 THEN chars ELSE 22 + length(replace(replace(replace(left(text, 368), '&', '&amp;'), '<', '&lt;'), '[', '&lbr;')) END ELSE 0 END AS again FROM sized),
placed AS (SELECT *, row_number() OVER o AS place, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS after_, first_value(again) OVER o AS head_chars FROM systems WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
past AS (SELECT *, after_ - tokens AS before_, lag(chars, 1) OVER p AS c1, lag(after_ - tokens, 1) OVER p AS s1, lag(chars, 2) OVER p AS c2, lag(after_ - tokens, 2) OVER p AS s2, head_chars > 0 AND place > 1 AS repeats FROM placed WINDOW p AS (PARTITION BY conv_id ORDER BY place)),
spans AS (SELECT *, 2 * floor(before_ / 1024) + CASE WHEN floor((after_ - 1) / 1024) > floor(before_ / 1024) THEN 1 ELSE 0 END AS span,
  CASE WHEN repeats THEN head_chars ELSE 0 END + CASE WHEN c1 IS NOT NULL AND place - 1 > CAST(repeats AS INTEGER) AND before_ - s1 <= 512 THEN c1 ELSE 0 END
  + CASE WHEN c2 IS NOT NULL AND place - 2 > CAST(repeats AS INTEGER) AND before_ - s2 <= 512 THEN c2 ELSE 0 END AS lead FROM past),
firsts AS (SELECT conv_id, sum(lead) AS lead FROM (SELECT conv_id, arg_min(lead, place) AS lead FROM spans GROUP BY conv_id, span) GROUP BY conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + any_value(f.lead) AS BIGINT) AS formatted_chars
FROM spans s JOIN firsts f ON s.conv_id = f.conv_id GROUP BY s.conv_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_source_mixing": MIXING,
    "op4_quality_rules": QUALITY,
    "op5_html_extraction": HTML,
    "op7_decontamination": DECONTAMINATION,
    "op9_chat_windows": CHAT,
    "op10_near_duplicates": NEAR_DUPLICATES,
}

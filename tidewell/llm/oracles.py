"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK, PERIOD
from .quality import CHAR_LIMIT, COMMON_WORDS, MIN_CHARS, MIN_WORDS, WORD_LIMIT


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_lists = " ".join(f"WHEN '{code}' THEN {_sql_list(words)}" for code, words in COMMON_WORDS.items())

QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT r, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, CASE lang {_lists} END AS list,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM f WHERE len(w) >= 8)),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i FROM d WHERE c > 1), (SELECT unnest(range(8)) AS o) GROUP BY r),
b AS (
  SELECT f.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM f LEFT JOIN p USING (r)),
h AS (
  SELECT *, [length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')), length(text) - length(regexp_replace(text, '[0-9]', '', 'g')), n_symbols,
    length(text) - length(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')) - n_symbols, length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')),
    length(text) - word_chars] AS six, list_transform(list, lambda x: len(list_filter(w, lambda y: y = x))) AS counts FROM b),
k AS (SELECT *, list_append(six, length(text) - list_sum(six)) AS chars, list_append(counts, n_words - list_sum(counts)) AS common FROM h),
rc AS (SELECT lang, list(s ORDER BY j) AS ref FROM (SELECT lang, j, sum(chars[j]) AS s FROM k, (SELECT unnest(range(1, 8)) AS j) GROUP BY ALL) GROUP BY lang),
rw AS (SELECT lang, list(s ORDER BY j) AS ref FROM (SELECT lang, j, sum(common[j]) AS s FROM k, (SELECT unnest(range(1, 18)) AS j) WHERE common IS NOT NULL GROUP BY ALL) GROUP BY lang),
v AS (
  SELECT k.*, list_transform(range(1, 8), lambda j: chars[j] / nullif(list_sum(chars), 0)::DOUBLE) AS cp, list_transform(range(1, 8), lambda j: rc.ref[j] / nullif(list_sum(rc.ref), 0)::DOUBLE) AS cq,
    list_transform(range(1, 18), lambda j: common[j] / nullif(list_sum(common), 0)::DOUBLE) AS wp, list_transform(range(1, 18), lambda j: rw.ref[j] / nullif(list_sum(rw.ref), 0)::DOUBLE) AS wq
  FROM k LEFT JOIN rc ON k.lang IS NOT DISTINCT FROM rc.lang LEFT JOIN rw ON k.lang IS NOT DISTINCT FROM rw.lang),
x AS (
  SELECT *, sqrt(greatest(list_sum(list_transform(range(1, 8), lambda j: (CASE WHEN cp[j] > 0 THEN cp[j] * log2(cp[j] / ((cp[j] + cq[j]) / 2)) ELSE 0 END) + (CASE WHEN cq[j] > 0 THEN cq[j] * log2(cq[j] / ((cp[j] + cq[j]) / 2)) ELSE 0 END))) / 2, 0)) AS cd,
    sqrt(greatest(list_sum(list_transform(range(1, 18), lambda j: (CASE WHEN wp[j] > 0 THEN wp[j] * log2(wp[j] / ((wp[j] + wq[j]) / 2)) ELSE 0 END) + (CASE WHEN wq[j] > 0 THEN wq[j] * log2(wq[j] / ((wp[j] + wq[j]) / 2)) ELSE 0 END))) / 2, 0)) AS wd FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND NOT (length(text) >= {MIN_CHARS} AND coalesce(cd, 0) > {CHAR_LIMIT[0]} + {CHAR_LIMIT[1]} / sqrt(greatest(length(text), 1)))
  AND NOT (length(text) >= {MIN_CHARS} AND n_words >= {MIN_WORDS} AND list IS NOT NULL AND coalesce(wd, 0) > {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / sqrt(greatest(n_words, 1))) AS kept
FROM x"""

MIXING = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS src, md5('mix' || '|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h) - 1 AS rk FROM rows_),
sizes AS (SELECT src, count(*) AS n FROM rows_ GROUP BY src),
shares AS (SELECT src, n, pow(n::DOUBLE, 0.5) / sum(pow(n::DOUBLE, 0.5)) OVER () * ({PERIOD} - count(*) OVER ()) AS share FROM sizes),
w AS (
  SELECT src, n, 1 + floor(share)::BIGINT + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, src) <= {PERIOD} - count(*) OVER () - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS weight FROM shares),
srcs AS (SELECT list({{'src': src, 'n': n, 'weight': weight}} ORDER BY src) AS s FROM w),
slots AS (
  SELECT -1 AS t, list_transform(s, lambda x: 0::BIGINT) AS given, 0::BIGINT AS chosen FROM srcs
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, i: g + CASE WHEN i = c THEN 1 ELSE 0 END), c FROM (
    SELECT t, given, list_min(list_filter(list_transform(given, lambda g, i: CASE WHEN (g * {PERIOD}) // s[i].weight <= t + 1 THEN ((g + 1) * {PERIOD} + s[i].weight - 1) // s[i].weight * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS c
    FROM slots, srcs WHERE t < {PERIOD} - 1)),
plan AS (SELECT t, s[chosen].src AS src, s[chosen].weight AS weight, s[chosen].n AS n, given[chosen] - 1 AS k, list_transform(given, lambda g, i: g - CASE WHEN i = chosen THEN 1 ELSE 0 END) AS before FROM slots, srcs WHERE t >= 0),
j AS (
  SELECT ranked.*, rk // {BLOCK} AS mix_block, (rk // {BLOCK}) // plan.weight AS cyc, plan.t, plan.before, plan.n
  FROM ranked JOIN plan ON ranked.src = plan.src AND (rk // {BLOCK}) % plan.weight = plan.k)
SELECT doc_id, source, mix_block::BIGINT AS mix_block, (cyc * {PERIOD} + t)::BIGINT AS mix_slot,
  (list_sum(list_transform(before, lambda g, i: least(s[i].n, (s[i].weight * cyc + g) * {BLOCK}))) + rk % {BLOCK})::BIGINT AS mix_position,
  (mix_block + 1) * {BLOCK} <= n AND len(list_filter(before, lambda g, i: s[i].n // {BLOCK} < s[i].weight * cyc + g)) = 0 AS mix_balanced
FROM j, srcs"""

_controls = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|OUT\]|ROLE\]|/ROLE\]|NULL\])"

CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '{_controls}', '\1\\\2\3', 'g')) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 9 ELSE 17 + coalesce(length(role), 6) END AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(chars))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first_id,
    array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, (5 * k + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * j)::INT) % 32, 1)), '')), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d"""

DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, win)),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""


SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS c FROM g) WHERE c > 1),
c AS (SELECT r, list(DISTINCT q) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS q FROM h) GROUP BY r),
p AS (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
x AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(gone) AS q FROM c)),
k AS (SELECT p.r, string_agg(word, ' ' ORDER BY j) AS kept FROM p LEFT JOIN x ON p.r = x.r AND p.j = x.q WHERE x.q IS NULL GROUP BY p.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT *, row_number() OVER () AS r FROM e),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS cid, a.label = c.label AS same, coalesce(list_sum(list_transform(a.q, lambda x, i: x * c.q[i])), 0)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, cid, cr) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.cid AS positive_id, s.cid AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.cid, s.cr)::INT AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

FILTER_AUDIT = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
m AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first_id < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS filter, 1 << (ascii(filter_order[step]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS gone FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & gone <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY part, filter_order, step, filter)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY,
        "op2_pfair_mixing": MIXING,
        "op5_chat_format": CHAT,
        "op7_substring_graph": SUBSTRINGS,
        "op8_warc_writer": WARC,
        "op9_decontamination": DECONTAMINATION,
        "op11_hard_negatives": HARD_NEGATIVES,
        "op12_filter_audit": FILTER_AUDIT,
    }

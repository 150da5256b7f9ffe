"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
g AS (SELECT rid, pos, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)),
t AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS q FROM t WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT d.rid, d.doc_id, d.source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words AS symbols_failed, n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines AS lines_failed FROM m),
h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f
  FROM (SELECT source, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base_failed, symbols_failed, lines_failed]) AS failed FROM f)
  GROUP BY source, rule),
k AS (
  SELECT rule, sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) ** 2
    - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS between_var FROM h GROUP BY rule),
c AS (SELECT rule, m, CASE WHEN between_var <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, m * (1 - m) / between_var - 1)) END AS k FROM k),
v AS (SELECT source, rule, (f + m * k) / (n + k) AS rate FROM h JOIN c USING (rule)),
s AS (
  SELECT source, max(CASE WHEN rule = 'base' THEN rate END) AS base_rate, max(CASE WHEN rule = 'symbols' THEN rate END) AS symbols_rate,
    max(CASE WHEN rule = 'lines' THEN rate END) AS lines_rate FROM v GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (base_rate > 0.5 OR symbols_failed AND symbols_rate > 0.02 OR lines_failed AND lines_rate > 0.02) AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN 'mix' ELSE 'mix:' || doc_id::VARCHAR END), 1, 15))::BIGINT AS point FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
o AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
-- The share per unit of weight: sources whose limit binds are those of the lowest limit per weight.
r AS (
  SELECT *, coalesce(sum(3 * n) OVER e, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER e, 0) AS open_weight, sum(n) OVER () AS total
  FROM o WINDOW e AS (ORDER BY 3 * n / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT max((total - full_before) / open_weight) FILTER (WHERE weight * ((total - full_before) / open_weight) <= 3 * n) AS share FROM r),
t AS (SELECT source, n, CASE WHEN weight * share > 3 * n THEN 3 * n ELSE weight * share END AS target FROM o, q),
b AS (SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n)) ELSE 0 END AS whole FROM t),
u AS (SELECT *, CASE WHEN whole < 3 THEN target - whole * n ELSE 0 END AS budget FROM b),
p AS (SELECT source, point, sum(size)::DOUBLE AS size FROM d GROUP BY source, point),
a AS (SELECT p.source, point, size, budget, sum(size) OVER (PARTITION BY p.source ORDER BY point) AS upto
  FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source),
x AS (SELECT source, point, upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size)) AS more FROM a)
SELECT d.doc_id, d.size, u.n::BIGINT AS source_size, u.target, (d.size * (u.whole + (CASE WHEN x.more THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.point = x.point
"""

_OP11 = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT rid, doc_id, words, len(words)::BIGINT AS n FROM w WHERE len(words) > 0),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
p AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY rid, doc_id, n, term),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), tot),
g AS (SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)) AS gain FROM p, tot),
s AS (SELECT item_id, rid, doc_id, sum(w * gain)::BIGINT AS score FROM q JOIN g USING (term) JOIN f USING (term) GROUP BY item_id, rid, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (len(words) < 50)::INT AS a, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT AS c,
    regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), w.doc_id IS NULL AND min(w.doc_id) OVER (PARTITION BY text) IS NOT NULL)::INT AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
k AS (SELECT part, [a, b, c, d, e] AS fails, count(*)::BIGINT AS n, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad FROM m GROUP BY part, [a, b, c, d, e]),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
o AS (
  SELECT [p.f, q.f, r.f, s.f, t.f] AS o FROM x p, x q, x r, x s, x t
  WHERE p.f <> q.f AND p.f <> r.f AND p.f <> s.f AND p.f <> t.f AND q.f <> r.f AND q.f <> s.f AND q.f <> t.f AND r.f <> s.f AND r.f <> t.f AND s.f <> t.f),
t AS (SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, f AS step, o[f] AS filter, o[1:f - 1] AS earlier FROM o, x),
c AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN NOT dropped AND fails[filter] = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT dropped AND fails[filter] = 1 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN dropped AND fails[filter] = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails[filter] = 1 AND list_sum(fails) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT dropped AND fails[filter] = 1 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT dropped AND fails[filter] = 1 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT k.*, t.*, coalesce(list_sum(list_transform(earlier, lambda i: fails[i])), 0) > 0 AS dropped FROM k, t) GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM c
"""

ORACLES: dict[str, str] = {"op1_quality": _OP1, "op8_mixing": _OP8, "op11_search": _OP11, "op13_audit": _OP13}

"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
  starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b),
  windows AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS g, len(w[k:k + 9]) AS n FROM starts),
  sizes AS (SELECT DISTINCT n FROM windows),
  places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes),
  found AS (SELECT doc_id, item_id, k, windows.n FROM places JOIN windows
    ON windows.n = places.n AND windows.g = array_to_string(w[k:k + places.n - 1], ' ')),
  hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id),
  t AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b),
  words AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
  postings AS (SELECT * FROM words WHERE term IN (SELECT term FROM t)),
  df AS (SELECT term, count(DISTINCT doc_id) AS df FROM postings GROUP BY term),
  rare AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), term) AS r
    FROM t LEFT JOIN df USING (term) QUALIFY r <= 3),
  first AS (SELECT item_id, doc_id, p FROM rare JOIN postings USING (term) WHERE r = 1),
  others AS (SELECT first.item_id, first.doc_id, first.p, count(DISTINCT o.term) AS n FROM first
    JOIN rare o ON o.item_id = first.item_id AND o.r > 1
    JOIN postings q ON q.doc_id = first.doc_id AND q.term = o.term AND q.p BETWEEN first.p - 19 AND first.p + 19 GROUP BY ALL),
  near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM first LEFT JOIN others USING (item_id, doc_id, p)
    WHERE coalesce(n, 0) = (SELECT count(*) - 1 FROM rare WHERE rare.item_id = first.item_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""

_WORD = "'[^\\x20\\x09-\\x0D]+'"

FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, {_WORD}) AS ws FROM d),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
  m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    CAST(len(ws) < 50 AS INT)
    + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
    FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
  c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM m GROUP BY part, mask),
  f AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
  o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
  s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(list_concat([0], bits[1:step - 1])) AS before
    FROM o, (SELECT unnest(range(1, 6)) AS step)),
  r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & CAST(before + bit AS INT) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & CAST(before AS INT) = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & CAST(before AS INT) > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & CAST(before AS INT) = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(bad) FILTER (mask & CAST(before AS INT) = 0 AND mask & bit > 0), 0) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  own AS (SELECT *, row_number() OVER () AS own FROM (SELECT DISTINCT doc_id, t FROM d)),
  l AS (SELECT own, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM own),
  k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
  f AS (SELECT key FROM (SELECT DISTINCT own, key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
  r AS (SELECT own, count(*) AS n_lines, count(f.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f ON f.key = k.key GROUP BY own)
SELECT d.doc_id, n_lines, n_dropped, kept_sha256 FROM d
JOIN own ON own.doc_id IS NOT DISTINCT FROM d.doc_id AND own.t = d.t JOIN r USING (own)"""

"""DuckDB SQL with the results of the operators that SQL can express.

Values that the operators share with it are written out again.
"""

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
tokens AS (
  SELECT doc_id, i, t, list_transform({_WORDS.format('t')}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM lines),
cuts AS (SELECT doc_id, i, len(w) AS n, w, [2 + (len(w) - 2) * j // 3 FOR j IN range(4)] AS c FROM tokens WHERE len(w) > 0),
keys AS (
  SELECT doc_id, i, n, unnest(list_concat(['0 ' || array_to_string(w, ' ')], CASE WHEN n < 5 THEN [] ELSE [
    j || ' ' || array_to_string(w[1:c[j]], ' ') || chr(1) || array_to_string(w[c[j + 1] + 1:n], ' ') FOR j IN [1, 2, 3]] END)) AS k FROM cuts),
known AS (SELECT n, k, min(doc_id) AS first FROM keys GROUP BY n, k HAVING count(DISTINCT doc_id) >= CASE WHEN n >= 20 THEN 2 ELSE 3 END),
dropped AS (SELECT DISTINCT doc_id, i FROM keys JOIN known USING (n, k) WHERE doc_id <> first),
kept AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(d.i) AS BIGINT) AS n_removed,
    coalesce(string_agg(t, chr(10) ORDER BY l.i) FILTER (WHERE d.i IS NULL), '') AS clean
  FROM lines l LEFT JOIN dropped d USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(clean) AS BIGINT) AS kept_chars, sha256(clean) AS kept_sha256 FROM kept"""

_PARTED = r"list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '')"
_SEQUENCE = "[array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(1, len(w) - 4) + 1)]"

OP3 = f"""
WITH doc_words AS (SELECT doc_id, {_PARTED} AS w FROM documents),
item_words AS (SELECT item_id, {_PARTED} AS w FROM benchmark),
docs AS (SELECT doc_id, len(w) AS words, {_SEQUENCE} AS s FROM doc_words WHERE len(w) > 0),
items AS (SELECT item_id, len(w) AS words, {_SEQUENCE} AS s FROM item_words WHERE len(w) > 0),
doc_shingles AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS p FROM docs),
item_shingles AS (SELECT item_id, x, count(*) AS k FROM (SELECT item_id, unnest(s) AS x FROM items) GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, item_id FROM doc_shingles JOIN item_shingles USING (x)),
windows AS (
  SELECT doc_id, item_id, len(i.s) AS m, least(len(i.s), len(d.s)) AS width, least(i.words, d.words) AS n_words,
    unnest(range(0, len(d.s) - least(len(i.s), len(d.s)) + 1)) AS start
  FROM pairs JOIN docs d USING (doc_id) JOIN items i USING (item_id)),
counted AS (
  SELECT w.doc_id, item_id, start, m, width, n_words, x, count(*) AS k
  FROM windows w JOIN doc_shingles d ON d.doc_id = w.doc_id AND d.p > start AND d.p <= start + width GROUP BY ALL),
scores AS (
  SELECT doc_id, item_id, start, n_words, sum(least(c.k, i.k)) AS low, any_value(m) + any_value(width) - sum(least(c.k, i.k)) AS high
  FROM counted c JOIN item_shingles i USING (item_id, x) GROUP BY doc_id, item_id, start, n_words),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY low / high DESC, start) AS r FROM scores WHERE 100 * low >= 80 * high)
SELECT doc_id, item_id, start, CAST(n_words AS BIGINT) AS n_words, round(CAST(low AS DOUBLE) / high, 6) AS similarity FROM best WHERE r = 1"""

_PHRASES = [
    "all rights reserved", "click here", "cookie policy", "copyright (c)", "copyright ©", "javascript is", "licensed under", "powered by", "privacy policy",
    "sign in", "sign up", "subscribe to our", "terms and conditions", "terms of service", "terms of use",
]
_STOCK = " OR ".join(f"contains(lower(t), '{p}')" for p in _PHRASES)

OP4 = rf"""
WITH read AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM read),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a) AS k FROM (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[i:i + 2] FOR i IN range(1, len(w) - 1)]) AS a FROM words)),
repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE k > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM read),
judged AS (
  SELECT doc_id, t, len({_WORDS.format('t')}) AS n, len(regexp_extract_all(t, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(t, '!!+')) AS shouts,
    len(list_filter(string_split_regex(t, '[\x20\x09]'), lambda x: regexp_full_match(x, '[|»«>•·]+'))) AS separators FROM lines),
passed AS (
  SELECT doc_id, t, n, n = 0 OR (regexp_matches(t, '[.!?:;…。！？؟।][\x22\x27”’»)\]]*(?:[\x20\x09-\x0D]|$)')
    AND symbols * 4 < n AND separators * 3 < n AND shouts * 3 < n AND NOT ({_STOCK})) AS ok FROM judged),
sums AS (
  SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT t) FILTER (WHERE n > 0) AS n_dup_lines,
    coalesce(sum(length(t) + 1) FILTER (WHERE ok) - 1, 0) AS kept_chars FROM passed GROUP BY doc_id),
figures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, kept_chars, length(text) AS chars
  FROM words JOIN sums USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * chars AS kept
FROM figures"""

OP6 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS x FROM words),
sizes AS (SELECT doc_id, count(x) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN links ON a = other)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n"""

#: CRC-32 byte by byte; a prefix is the row of the digests of its turns.
OP12 = r"""
WITH turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (
  SELECT c, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, sha256(length(role)::VARCHAR || ':' || role || text) AS k FROM turns),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM keyed),
convs AS (
  SELECT c, max(p) AS own, c - c % 20 AS b, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(c::VARCHAR)), lambda i: ascii((c::VARCHAR)[i + 1])::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda v, nth: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 4 AS h
  FROM placed GROUP BY c),
plans AS (SELECT x.c, x.b, x.h, x.own, least(x.h, coalesce(y.own, 0)) AS m FROM convs x LEFT JOIN convs y ON y.c = x.b),
rebuilt AS (
  SELECT q.c, t.p AS d, t.k, t.n_words FROM plans q JOIN placed t ON t.c = q.b AND t.p <= q.h
  UNION ALL SELECT q.c, t.p - q.h + q.m, t.k, t.n_words FROM plans q JOIN placed t ON t.c = q.c AND t.p > q.h
  UNION ALL SELECT c, 0, '', 0 FROM plans),
prefixes AS (
  SELECT c, d, n_words, sha256(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS f, d = max(d) OVER (PARTITION BY c) AS whole FROM rebuilt),
nodes AS (
  SELECT d, f, min(c) AS c, count(*) AS n, max(n_words) AS n_words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE whole), '') AS ends FROM prefixes GROUP BY d, f),
linked AS (
  SELECT x.*, y.f AS above, z.c AS parent FROM nodes x LEFT JOIN prefixes y ON y.c = x.c AND y.d = x.d - 1 LEFT JOIN nodes z ON z.d = y.d AND z.f = y.f),
children AS (SELECT d - 1 AS d, above AS f, count(*) AS n FROM linked WHERE d > 0 GROUP BY ALL),
valued AS (
  SELECT x.*, coalesce(y.n, 0) AS branches FROM linked x LEFT JOIN children y ON y.d = x.d AND y.f = x.f),
below AS (
  SELECT a.d, a.f, sum(CASE WHEN x.branches = 0 THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.n_words) AS saved
  FROM valued x JOIN prefixes a ON a.c = x.c AND a.d <= x.d GROUP BY ALL)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, x.parent AS parent_conv_id, x.n AS n_convs, x.branches AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM valued x JOIN below b ON b.d = x.d AND b.f = x.f
"""

"""DuckDB statements that state the results of the operators which SQL can express."""

from .line_dedup import CHARS_PER_WORD, MIN_WORDS, UNSPACED, WORD

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, (SELECT unnest(range(0, 20)) AS k)),
flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT f.doc_id, string_agg(f.x, ' ' ORDER BY f.p) AS t, count(*) AS n
  FROM flat f ANTI JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op10_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
own AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT o.doc_id, o.i, o.k, w.item_id FROM own o JOIN win w ON o.k = w.k AND o.g = w.g),
n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit h ON d.doc_id = h.doc_id LEFT JOIN its t ON d.doc_id = t.doc_id""",
    "op6_url_filters": r"""
WITH own AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         DATE '2020-01-01' + CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7))::BIGINT % 1461 AS INTEGER) AS fetched
  FROM pages),
x AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS parts FROM own WHERE host != ''),
known AS (
  SELECT 'domain' AS kind, array_to_string(labels[-2:], '.') AS pattern FROM x
  UNION SELECT 'host', host FROM x
  UNION SELECT 'prefix', host || array_to_string(parts[1:2], '/') FROM x),
seeded AS (
  SELECT *, ('0x' || substr(md5(list || '|' || kind || '|' || pattern), 1, 7))::BIGINT AS n
  FROM known, (SELECT unnest(['allow', 'malware', 'spam']) AS list)),
entries AS (
  SELECT list, kind, pattern, action, DATE '2020-01-01' + CAST(d AS INTEGER) AS day FROM (
    SELECT list, kind, pattern, 'add' AS action, n % 700 AS d FROM seeded WHERE n % 5 < 2
    UNION ALL SELECT list, kind, pattern, 'remove', n % 700 + 30 + n % 400 FROM seeded WHERE n % 5 < 2
    UNION ALL SELECT list, kind, pattern, 'add', n % 700 + 500 + n % 600 FROM seeded WHERE n % 5 < 2)),
daily AS (SELECT list, kind, pattern, day, bool_and(action = 'add') AS listed FROM entries GROUP BY ALL),
turns AS (
  SELECT * FROM (SELECT *, coalesce(lag(listed) OVER (PARTITION BY list, kind, pattern ORDER BY day), false) AS was FROM daily)
  WHERE listed != was),
spans AS (
  SELECT * FROM (SELECT list, kind, pattern, listed, day AS valid_from, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS valid_to FROM turns)
  WHERE listed),
offered AS (
  SELECT page_id, fetched, 'domain' AS kind, array_to_string(labels[-n:], '.') AS pattern FROM (SELECT *, unnest(range(2, len(labels) + 1)) AS n FROM x)
  UNION ALL SELECT page_id, fetched, 'host', host FROM x
  UNION ALL SELECT page_id, fetched, 'prefix', host || array_to_string(parts[1:n], '/') FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS n FROM x)),
met AS (
  SELECT o.page_id, o.fetched, s.* , CASE o.kind WHEN 'prefix' THEN -3 WHEN 'host' THEN -2 ELSE -1 END AS r
  FROM offered o JOIN spans s ON o.kind = s.kind AND o.pattern = s.pattern AND s.valid_from <= o.fetched AND (s.valid_to IS NULL OR o.fetched < s.valid_to)),
best AS (
  SELECT page_id, fetched, list, pattern FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, fetched ORDER BY r, -length(pattern), list, pattern) AS k FROM met) WHERE k = 1),
n AS (SELECT page_id, fetched, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM met GROUP BY ALL)
SELECT o.page_id, o.fetched, coalesce(n.n_active, 0) AS n_active, coalesce(n.lists, '') AS lists, b.list AS decided_by, b.pattern,
       coalesce(b.list != 'allow', false) AS blocked
FROM own o LEFT JOIN n ON o.page_id = n.page_id AND o.fetched = n.fetched LEFT JOIN best b ON o.page_id = b.page_id AND o.fetched = b.fetched""",
    "op7_line_dedup": f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
pos AS (
  SELECT doc_id, p, ls[p] AS line, CASE WHEN p + 2 <= len(ls) THEN array_to_string(list_slice(ls, p, p + 2), chr(10)) END AS run
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM d WHERE text IS NOT NULL)),
one AS (SELECT doc_id, p, len(regexp_extract_all(line, '{WORD}')) >= {MIN_WORDS} OR len(regexp_extract_all(line, '{UNSPACED}')) >= {CHARS_PER_WORD * MIN_WORDS} AS alone, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS r FROM pos),
three AS (SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS r FROM pos WHERE run IS NOT NULL),
gone AS (
  SELECT doc_id, p FROM one WHERE r > 1 AND alone
  UNION SELECT doc_id, p + k FROM three, (SELECT unnest([0, 1, 2]) AS k) WHERE r > 1),
kept AS (
  SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.p) AS t, count(*) AS n
  FROM pos x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(d.ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.t, '')) END AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op11_phrase_collocations": r"""
WITH piece AS (
  SELECT row_number() OVER () AS id, lang, w FROM (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))),
total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang),
f AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS g, count(*) AS f FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
cand AS (SELECT lang, k AS m, g, f AS a FROM f WHERE k > 1 AND f >= 30),
cut AS (
  SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, c.k) JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, c.k + 1, c.m)),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cut) WHERE o = 1),
inner_ AS (
  SELECT lang, list_slice(g, i, i + k - 1) AS g, max(a) AS over FROM (
    SELECT lang, g, a, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM cand)) GROUP BY ALL),
kept AS (
  SELECT w.lang, array_to_string(w.g, ' ') AS phrase, w.a, w.l, w.r, w.score FROM worst w LEFT JOIN inner_ i ON w.lang = i.lang AND w.g = i.g
  WHERE i.over IS NULL OR 100::HUGEINT * i.over < 80::HUGEINT * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, r.score
FROM ranked r JOIN total t ON r.lang = t.lang WHERE r.rank <= 2000""",
    "op12_tree_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
}

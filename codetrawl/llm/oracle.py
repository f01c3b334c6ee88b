"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

_URLS = r"""
parts AS (
  SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {pages}
), split AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^&=]*|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM parts
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS k
  FROM split
)
"""

ORACLE: dict[str, str] = {}

# The given pages name no other url, so the groups of aliases are the keys themselves.
ORACLE["op6_url_filter"] = "WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), " \
    "('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')), " \
    + _URLS.format(pages="pages").strip() + r""",
best AS (
  SELECT page_id, any_value(host) AS host, any_value(path) AS path, any_value(k) AS k,
         arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT *, row_number() OVER () AS rid FROM keyed)
  LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY rid, page_id
), said AS (
  SELECT k, bool_or(v = 'allow') AS allowed, bool_or(v = 'block') AS blocked FROM best WHERE k IS NOT NULL AND v IS NOT NULL GROUP BY k
)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict
FROM best LEFT JOIN said USING (k)
"""

ORACLE["op9_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(source, '') AS host, text FROM documents),
lines AS (
  SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d WHERE text IS NOT NULL
), bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS b FROM lines),
pages AS (SELECT min(rid) AS rid, host FROM d GROUP BY host, text),  -- copies on a site are one page of it
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
boiler AS (
  SELECT host, b FROM bare JOIN pages USING (rid, host) JOIN totals USING (host) WHERE b <> ''
  GROUP BY host, b, pages HAVING count(DISTINCT rid) >= 3 AND count(DISTINCT rid) > CAST(0.05 AS DOUBLE) * pages
), kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE x.b IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE x.b IS NULL), '') AS kept
  FROM bare LEFT JOIN boiler x ON x.host = bare.host AND x.b = bare.b GROUP BY rid
)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(kept) END AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op1_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format(text='text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(text='text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
runs AS (
  SELECT rid, size, p, array_to_string(w[p:p + size - 1], ' ') AS said
  FROM (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT rid, size, p, item_id FROM runs JOIN win USING (size, said)),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM hits) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR) FILTER (WHERE item_id IS NOT NULL)) AS items FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ORACLE["op8_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), places AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
windows AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS said FROM places),
often AS (SELECT rid, said FROM windows GROUP BY rid, said HAVING count(*) > 1),
repeats AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM windows SEMI JOIN often USING (rid, said)) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS again
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), words AS (
  SELECT rid, max(n) AS most, sum(n) FILTER (WHERE regexp_matches(said, '\p{L}')) AS named
  FROM (SELECT rid, said, count(*) AS n FROM (SELECT rid, unnest(w) AS said FROM d) GROUP BY rid, said) GROUP BY rid
), counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.again, 0) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, coalesce(most, 0) AS most, coalesce(named, 0) AS named,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters
  FROM d LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN words USING (rid)
), based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 7 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 10 * named < 6 * n_words OR 2 * capitals > letters OR 10 * most > 3 * n_words) AS kept
FROM based
"""

# Phrases as lists of words; every window of one to four words is counted.
ORACLE["op12_collocations"] = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, size, ws[i:i + size - 1] AS g, count(*) AS f
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) sizes(size))
  GROUP BY lang, size, ws[i:i + size - 1]
), candidates AS (
  SELECT * FROM grams WHERE size > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.size, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.size = c.k AND x.g = c.g[1:c.k]
  JOIN grams y ON y.lang = c.lang AND y.size = c.size - c.k AND y.g = c.g[c.k + 1:c.size]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, part AS g, f FROM (
    SELECT lang, f, size, n, g[pos:pos + n - 1] AS part
    FROM (SELECT *, unnest(range(1, size - n + 2)) AS pos FROM candidates, (VALUES (2), (3)) shorter(n) WHERE n < size))
), longest AS (
  SELECT lang, g, max(f) AS f FROM inside GROUP BY lang, g
), kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longest i ON i.lang = c.lang AND i.g = c.g WHERE i.f IS NULL OR 100 * i.f < 80 * c.a
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM kept))
JOIN total USING (lang) WHERE rank <= 2000
"""

# The given pages hold one article element each, of headings and paragraphs; regular expressions read those.
ORACLE["op13_html_text"] = r"""
WITH blocks AS (
  SELECT page_id, url, list_transform(
    regexp_split_to_array(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      x, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g'))) AS parts
  FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM blocks
)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""

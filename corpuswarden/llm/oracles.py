"""SQL for the queries that SQL can express, over the same tables."""

from . import lines, quality

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS k FROM p),
u AS (SELECT r, count(DISTINCT i + j) AS n FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) WHERE k >= 2 GROUP BY r),
m AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(u.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN u USING (r)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS pages, count_if(base_failed)::DOUBLE AS failed FROM b GROUP BY source),
s AS (SELECT sum(pages) AS n, count(*) AS h, sum(failed) / sum(pages) AS p, sum(failed * failed / pages) AS q,
             least(greatest(sum(failed) / sum(pages), 1e-6), 1 - 1e-6) AS mean FROM h),
k AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(greatest(q / n - p * p, 0) - mean * (1 - mean) * h / n, 1e-9) - 1, 1), 1e6) AS strength FROM s),
v AS (SELECT source, (failed + mean * strength) / (pages + strength) > {quality.MOST_FAILING} AS bad FROM h CROSS JOIN k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT v.bad AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

_TRIM = "trim({0}, concat(' ', chr(9), chr(11), chr(12), chr(13)))"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
t AS (SELECT *, {_TRIM.format("line")} AS k FROM l),
hp AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
bad AS (SELECT t.source, k FROM t JOIN hp ON t.source IS NOT DISTINCT FROM hp.source WHERE k <> ''
        GROUP BY t.source, k HAVING count(DISTINCT r) >= {lines.LEAST_PAGES} AND count(DISTINCT r) > {lines.RATIO} * max(pages)),
f AS (SELECT t.r, t.pos, t.line, bad.k IS NOT NULL AS dropped FROM t LEFT JOIN bad ON t.source IS NOT DISTINCT FROM bad.source AND t.k = bad.k),
a AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS clean, count_if(dropped) AS n FROM f GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE a.clean END AS text, d.lang, d.source,
       CASE WHEN coalesce(a.n, 0) > 0 THEN length(a.clean) ELSE d.n_chars END::BIGINT AS n_chars, coalesce(a.n, 0)::BIGINT AS lines_dropped
FROM d LEFT JOIN a USING (r)
"""

"""The same rows in SQL, where SQL can say it."""

WORD = "[^\\x20\\x09-\\x0D]+"

ORACLES = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM d),
spots AS (SELECT rid, words, unnest(range(1, len(words) - 3)) AS p FROM w),
win AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, array_to_string(words[p:p + 4], ' ')) AS n FROM spots),
rep AS (SELECT rid, sum(step)::BIGINT AS n_repeat_words FROM
          (SELECT rid, least(5, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p) - p, 5)) AS step FROM win WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words
            OR 2 * n_dup_lines > n_lines) AS kept
FROM b""",
    "op8_mix_sources": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * floor(sqrt(size::DOUBLE) * 16)::BIGINT)::BIGINT AS root_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
weighted AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
-- water filling: those above twice their size stop there, the rest is shared out again
fill AS (
  SELECT 0 AS step, list(k) AS open, (SELECT sum(source_size) * 150 / 100.0 FROM s)::DOUBLE AS free FROM weighted
  UNION ALL
  SELECT step + 1, list(w.k) FILTER (WHERE NOT w.above), any_value(free) - sum(CASE WHEN w.above THEN 2 * w.source_size ELSE 0 END)
  FROM (SELECT f.*, x.k, x.source_size, 2 * x.source_size <= f.free * x.weight / sum(x.weight) OVER () AS above
        FROM fill f, weighted x WHERE list_contains(f.open, x.k)) w GROUP BY step HAVING bool_or(w.above) AND NOT bool_and(w.above)),
last AS (SELECT * FROM fill ORDER BY step DESC LIMIT 1),
t AS (SELECT source, source_size, root_size,
             CASE WHEN list_contains((SELECT open FROM last), k)
                  THEN (SELECT free FROM last) / (SELECT sum(weight) FROM weighted, last WHERE list_contains(open, k)) * weight
                  ELSE 2.0 * source_size END AS target FROM weighted),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
-- documents whose share reaches 1 are certain, the others share what is left
trim AS (
  SELECT source, 0 AS step, 'inf'::DOUBLE AS sure, target - whole * source_size AS free, root_size::DOUBLE AS roots, 0::BIGINT AS n FROM p
  UNION ALL
  SELECT x.source, x.step + 1, any_value(x.at_one), any_value(p.target - p.whole * p.source_size) - sum(x.size), any_value(p.root_size) - sum(x.size * x.r), count(*)
  FROM (SELECT t.source, t.step, t.n, t.roots / t.free AS at_one, e.size, e.r FROM trim t
        JOIN (SELECT source, size, floor(sqrt(size::DOUBLE) * 16)::BIGINT AS r FROM d WHERE size > 0) e
        ON e.source IS NOT DISTINCT FROM t.source AND t.free > 0 AND t.roots / t.free < t.sure AND e.r >= t.roots / t.free) x
  JOIN p ON p.source IS NOT DISTINCT FROM x.source GROUP BY x.source, x.step HAVING count(*) > any_value(x.n)),
sure AS (SELECT source AS sure_source, arg_max(sure, step) AS sure, arg_max(free, step) AS free, arg_max(roots, step) AS roots FROM trim GROUP BY source),
r AS (SELECT d.doc_id, d.size, p.*, sure, free, roots, target - whole * source_size AS rest, floor(sqrt(d.size::DOUBLE) * 16)::BIGINT AS own,
             (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|' || d.size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN sure ON d.source IS NOT DISTINCT FROM sure_source),
q AS (SELECT *, CASE WHEN size > 0 AND own >= sure THEN 1 WHEN roots > 0 AND free > 0 THEN free * own / roots ELSE 0 END AS i FROM r),
o AS (SELECT *, CASE WHEN i >= 1 THEN 0 WHEN i <= 0 THEN 'inf'::DOUBLE ELSE (u / (1 - u)) / (i / (1 - i)) END AS ord, coalesce(doc_id, -1) AS id FROM q),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
cut AS (SELECT source, max(row(ord, id, size)) AS cut FROM c WHERE size > 0 AND 2 * before + size <= 2 * rest GROUP BY source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN cut IS NOT NULL AND row(ord, id, size) <= cut THEN 1 ELSE 0 END END * size)::BIGINT AS taken
FROM o LEFT JOIN cut ON o.source IS NOT DISTINCT FROM cut.source""",
    "op10_url_filters": r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, split_part(url, '#', 1) AS node, coalesce(html, '') AS html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
found AS (
  SELECT url, node, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM p
  UNION ALL
  SELECT url, node, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM p),
l AS (SELECT node AS a, split_part(CASE
        WHEN contains(link, '://') THEN link
        WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
        WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
        WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        WHEN ends_with(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '/') AND NOT ends_with(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '://')
          THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) || link
        ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || link END, '#', 1) AS b
      FROM found WHERE link <> '' AND contains(url, '://')),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hosts AS (SELECT node, host, path FROM p UNION
          SELECT b, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) FROM e),
own AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
        FROM (SELECT DISTINCT host, path FROM hosts) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
alias AS (SELECT reach.a AS node, min(own.verdict) AS verdict FROM reach JOIN hosts ON hosts.node = reach.b JOIN own USING (host, path) GROUP BY reach.a)
SELECT page_id, host, path, own.rule, coalesce(own.verdict, alias.verdict, 'allow') AS verdict
FROM p LEFT JOIN own USING (host, path) LEFT JOIN alias USING (node)""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(total, 0) + v) AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
      LEFT JOIN size ON size.lang = g.lang AND size.source = g.source),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
whole AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q FROM c JOIN whole USING (lang) JOIN v USING (lang) GROUP BY lang, term),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_importance_resampling": r"""
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], [0, 0, 0, 0, 0, 0, 0, 0]),
               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
texts AS (SELECT row_number() OVER () AS rid, doc_id, true AS own, text FROM documents UNION ALL SELECT 0, NULL, false, text FROM benchmark),
d AS (SELECT rid, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT rid, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
             list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM d),
names AS (SELECT DISTINCT feature FROM f),
b AS (SELECT feature, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
             lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT feature, hex(encode(feature)) AS h FROM names), tab),
n AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM f JOIN b USING (feature) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
gain AS (SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (whole.s + 10000)::DOUBLE / ((n.s + 1)::DOUBLE * (whole.t + 10000)::DOUBLE)))::BIGINT AS gain FROM n, whole),
sums AS (SELECT rid, count(*) AS n_features, sum(gain) AS weight FROM f JOIN b USING (feature) JOIN gain USING (bucket) WHERE own GROUP BY rid),
r AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (rid) WHERE own),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score FROM r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * fit // 100 THEN place END AS rank FROM ranked""",
}

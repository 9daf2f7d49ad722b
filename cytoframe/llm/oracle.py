"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op10_repetition_rates"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), f AS (
  SELECT *, 2 * source_size AS cap,
    (CAST(1.5 AS DOUBLE) * (sum(source_size) OVER ()) - coalesce(sum(2 * source_size) OVER fill, 0))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER fill, 0)) AS level,
    CAST(2 * source_size AS DOUBLE) / weight AS stops
  FROM w
  WINDOW fill AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, first_value(level) OVER (ORDER BY CASE WHEN stops >= level THEN 0 ELSE 1 END, stops, level ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water
  FROM f
), t AS (
  SELECT source, source_size, CASE WHEN weight * water < cap THEN weight * water ELSE CAST(cap AS DOUBLE) END AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * CAST(floor(r.rate) + CASE WHEN
    CAST(CAST('0x' || substr(md5('1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < r.rate - floor(r.rate)
    THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

ORACLE["op9_sampled_splitters"] = r"""
WITH RECURSIVE step AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT n, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g'), ' ')[1:octet_length(encode(text))], lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d
), c AS (
  SELECT n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, x: xor(t[1 + (xor(a, x) & 255)], a >> 8)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM b, crc
), r AS (
  SELECT n, doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, md5(text) AS key,
    sum(octet_length(encode(text)) + 1) OVER (ORDER BY md5(text), doc_id, n ROWS UNBOUNDED PRECEDING) AS till,
    row_number() OVER (ORDER BY md5(text), doc_id, n) AS place,
    sum(octet_length(encode(text)) + 1) OVER () AS total
  FROM d
), p AS (
  SELECT n, doc_id, size, place, CAST(least(7, ((2 * till - size) * 8) // (2 * total)) AS INTEGER) AS shard FROM r
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM p JOIN c USING (n)
"""

ORACLE["op11_prefix_crc_resampling"] = r"""
WITH RECURSIVE step AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), m AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), df AS (
  SELECT n, feature, count(*) AS c FROM (
    SELECT n, unnest(flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS feature FROM d
  ) GROUP BY n, feature
), mf AS (
  SELECT feature, count(*) AS c FROM (
    SELECT unnest(flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS feature FROM m
  ) GROUP BY feature
), f AS (
  SELECT feature, string_split(rtrim(regexp_replace(hex(encode(feature)), '(..)', '\1 ', 'g')), ' ') AS h FROM (SELECT feature FROM df UNION SELECT feature FROM mf)
), b AS (
  SELECT feature, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(h, lambda x: CAST('0x' || x AS BIGINT))),
    lambda a, x: xor(t[1 + (xor(a, x) & 255)], a >> 8)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM f, crc
), s AS (
  SELECT bucket, sum(c) AS s FROM df JOIN b USING (feature) GROUP BY bucket
), t AS (
  SELECT bucket, sum(c) AS t FROM mf JOIN b USING (feature) GROUP BY bucket
), sums AS (
  SELECT coalesce((SELECT sum(s) FROM s), 0) AS all_s, coalesce((SELECT sum(t) FROM t), 0) AS all_t
), g AS (
  SELECT bucket, CAST(floor(1000.0 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE))
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), sums
), w AS (
  SELECT n, sum(c * gain) AS weight FROM df JOIN b USING (feature) JOIN g USING (bucket) GROUP BY n
), x AS (
  SELECT n, doc_id, len(w) AS words, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features,
    CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(floor(CAST(-1000.0 AS DOUBLE) * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS noise
  FROM d LEFT JOIN w USING (n)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + noise DESC, doc_id, n) AS place, count(*) FILTER (words >= 20) OVER () AS fitting FROM x
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + noise AS score,
  CASE WHEN words >= 20 AND place <= 5 * fitting // 100 THEN place END AS rank
FROM r
"""

ORACLE["op13_divergence_cube"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n FROM kept GROUP BY lang
), g AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), full_ AS (
  SELECT g.lang, g.source, k.term, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1) // (g.n + v.v) AS BIGINT) AS p
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), shares AS (
  SELECT c.lang, c.source, c.term, CAST(1 + CAST(1000000000 AS HUGEINT) * (c.c + 1) // (g.n + v.v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (k.total + 1) // (v.n + v.v) AS BIGINT) AS q
  FROM c JOIN kept k USING (lang, term) JOIN g ON g.lang = c.lang AND g.source = c.source JOIN v ON v.lang = c.lang
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM every UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 200
"""

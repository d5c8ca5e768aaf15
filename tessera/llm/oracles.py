"""DuckDB statements that give the same rows as the queries, where SQL can express them."""

#: The statement ends with the table ``mixed``; both the query's oracle and the pipeline's build on it.
MIX_TABLES = r"""
sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))) AS key
  FROM {documents}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT::DOUBLE * 1.5::DOUBLE AS wanted,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
    (sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight
  FROM ranked),
filled AS (
  SELECT *, (wanted - spent::DOUBLE) / open_weight::DOUBLE AS level,
    cap::DOUBLE <= (wanted - spent::DOUBLE) / open_weight::DOUBLE * weight::DOUBLE AS is_full
  FROM levels),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN cap::DOUBLE ELSE (SELECT arg_min(level, spent) FROM filled WHERE NOT is_full) * weight::DOUBLE END AS target
  FROM filled),
placed AS (
  SELECT s.*, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, greatest(0, least(size, floor(target - (epochs * source_size)::DOUBLE)::BIGINT - before))::BIGINT AS last_epoch
  FROM placed)
"""

MIX = f"WITH {MIX_TABLES.format(documents='documents')} SELECT doc_id, size, source_size, target, (epochs * size + last_epoch)::BIGINT AS taken FROM mixed"

URLS = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hosts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, arg_max(h || p, length(h) * 100 + length(p)) AS rule, coalesce(arg_max(v, length(h) * 100 + length(p)), 'allow') AS verdict
FROM hosts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""

#: Ends with the table ``judged``: every document's columns, its counts, base_failed and kept.
QUALITY_TABLES = r"""
texts AS (SELECT *, row_number() OVER () AS rowno, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {documents}),
runs AS (SELECT rowno, i, list_slice(ws, i, i + 7) AS run FROM texts, unnest(range(1, len(ws) - 6)) AS u(i)),
again AS (SELECT rowno, i FROM runs QUALIFY count(*) OVER (PARTITION BY rowno, run) > 1),
covered AS (SELECT rowno, count(DISTINCT i + k) AS n FROM again, range(0, 8) AS r(k) GROUP BY rowno),
counted AS (
  SELECT texts.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN covered USING (rowno)),
rated AS (
  SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    1000 * n_symbols // greatest(n_words, 1) AS symbol_rate,
    1000 * (len(lines) - len(list_distinct(lines))) // greatest(len(lines), 1) AS dup_line_rate,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate,
    100 * word_chars // greatest(n_words, 1) AS word_length,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted),
long AS (
  SELECT lang, source, rate, ((v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0)) AS bucket
  FROM (SELECT lang, source, symbol_rate::BIGINT AS symbol_rate, dup_line_rate::BIGINT AS dup_line_rate, repeat_rate::BIGINT AS repeat_rate, word_length::BIGINT AS word_length, n_words, n_lines
        FROM rated WHERE NOT base_failed) UNPIVOT (v FOR rate IN (symbol_rate, dup_line_rate, repeat_rate, word_length, n_words, n_lines))),
sketch AS (
  SELECT 0 AS level, lang, source, rate, bucket, count(*) AS n FROM long GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rate, bucket, count(*) FROM long GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rate, bucket, count(*) FROM long GROUP BY ALL),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS size FROM sketch),
quartiles AS (
  SELECT level, lang, source, rate, max(size) AS size, min(bucket) FILTER (upto * 4 >= size) AS q1, min(bucket) FILTER (upto * 4 >= size * 2) AS q2,
    min(bucket) FILTER (upto * 4 >= size * 3) AS q3
  FROM upto GROUP BY ALL),
by_lang AS (
  SELECT l.level, l.lang, l.source, l.rate, l.size, (l.size * l.q1 + 100 * o.q1) // (l.size + 100) AS q1, (l.size * l.q2 + 100 * o.q2) // (l.size + 100) AS q2,
    (l.size * l.q3 + 100 * o.q3) // (l.size + 100) AS q3
  FROM quartiles l JOIN quartiles o ON l.level = 1 AND o.level = 2 AND o.rate = l.rate),
drawn AS (
  SELECT g.level, g.lang, g.source, g.rate, (g.size * g.q1 + 100 * l.q1) // (g.size + 100) AS q1, (g.size * g.q2 + 100 * l.q2) // (g.size + 100) AS q2,
    (g.size * g.q3 + 100 * l.q3) // (g.size + 100) AS q3
  FROM quartiles g JOIN by_lang l ON g.level = 0 AND l.rate = g.rate AND l.lang IS NOT DISTINCT FROM g.lang
  UNION ALL SELECT level, lang, source, rate, q1, q2, q3 FROM by_lang
  UNION ALL SELECT level, lang, source, rate, q1, q2, q3 FROM quartiles WHERE level = 2),
events(rate, of, adds, adds_q2, both_sides) AS (VALUES ('symbol_rate', 'n_words', 1000, 0, false), ('dup_line_rate', 'n_lines', 1000, 0, false),
  ('repeat_rate', 'n_words', 16000, 0, false), ('word_length', 'n_words', 0, 10, true)),
values_ AS (
  SELECT rowno, lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS rate,
    unnest([symbol_rate, dup_line_rate, repeat_rate, word_length]) AS v, unnest([n_words, n_lines, n_words, n_words]) AS n FROM rated),
levels AS (
  SELECT x.*, CASE WHEN f0.level IS NOT NULL THEN 0 WHEN f1.level IS NOT NULL THEN 1 ELSE 2 END AS level
  FROM values_ x
  LEFT JOIN drawn f0 ON f0.level = 0 AND f0.rate = x.rate AND f0.lang IS NOT DISTINCT FROM x.lang AND f0.source IS NOT DISTINCT FROM x.source
  LEFT JOIN drawn f1 ON f1.level = 1 AND f1.rate = x.rate AND f1.lang IS NOT DISTINCT FROM x.lang),
spreads AS (
  SELECT x.rowno, x.v, q.q1, q.q3, both_sides, greatest(5 * (q.q3 - q.q1),
    (4 * (adds + adds_q2 * q.q2)) // greatest(floor(sqrt((greatest(o.q2, 1) * least(greatest(x.n, 1), 16 * greatest(o.q2, 1)))::DOUBLE))::BIGINT, 1)) AS spread
  FROM levels x JOIN events e ON e.rate = x.rate
  JOIN drawn q ON q.level = x.level AND q.rate = x.rate AND (x.level = 2 OR q.lang IS NOT DISTINCT FROM x.lang) AND (x.level > 0 OR q.source IS NOT DISTINCT FROM x.source)
  JOIN drawn o ON o.level = x.level AND o.rate = e.of AND (x.level = 2 OR o.lang IS NOT DISTINCT FROM x.lang) AND (x.level > 0 OR o.source IS NOT DISTINCT FROM x.source)),
chosen AS (SELECT rowno, v, q3 + spread AS high, CASE WHEN both_sides THEN q1 - spread END AS low FROM spreads),
bad AS (SELECT rowno, bool_or(coalesce(v > high, false) OR coalesce(v < low, false)) AS bad FROM chosen GROUP BY rowno),
judged AS (SELECT rated.*, NOT base_failed AND NOT coalesce(bad, false) AS kept FROM rated LEFT JOIN bad USING (rowno))
"""

QUALITY = f"""WITH {QUALITY_TABLES.format(documents='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, source FROM judged"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (j // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31) + 1)::INT, 1) for j in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_agrees
FROM d
"""

#: crc32 of each distinct feature comes from its table of 256 values and a fold over the bytes.
RESAMPLING = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
texts AS (SELECT row_number() OVER () AS rowno, doc_id, text AS raw, false AS aim FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, true FROM benchmark),
split AS (
  SELECT rowno, doc_id, raw, aim, regexp_extract_all(translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
features AS (
  SELECT rowno, aim, unnest(ws) AS f FROM split
  UNION ALL SELECT rowno, aim, ws[i] || ' ' || ws[i + 1] FROM split, unnest(range(1, len(ws))) AS u(i)),
per_text AS (SELECT rowno, aim, f, count(*) AS n FROM features GROUP BY ALL),
dictionary AS (
  SELECT f, in_source, in_target, xor(list_reduce(list_transform(range(strlen(f)), lambda j: ('0x' || substr(hex(encode(f)), 2 * j + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT f, coalesce(sum(n) FILTER (NOT aim), 0) AS in_source, coalesce(sum(n) FILTER (aim), 0) AS in_target FROM per_text GROUP BY f), crc_table),
counts AS (SELECT bucket, sum(in_source)::BIGINT AS s, sum(in_target)::BIGINT AS t FROM dictionary GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::BIGINT + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((sum(t) OVER ())::BIGINT + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
sums AS (SELECT rowno, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM per_text JOIN dictionary USING (f) JOIN gains USING (bucket) WHERE NOT aim GROUP BY rowno),
scored AS (
  SELECT doc_id, raw, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce(CASE WHEN total < 0 THEN -((-total + n_features - 1) // n_features) ELSE total // n_features END, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM split LEFT JOIN sums USING (rowno) WHERE NOT aim),
placed AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, md5(coalesce(raw, ''))) AS place, count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""

"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"""
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents))"""

ORACLE = {
    "op2_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
q AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE list_inner_product(e, e) > 0),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM q x JOIN q y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.vec_id, coalesce(c.n, 0) AS n_links, least(d.vec_id, coalesce(m.low, d.vec_id)) AS component_id,
       d.vec_id <= coalesce(m.low, d.vec_id) AS kept
FROM embeddings d LEFT JOIN m ON m.a = d.vec_id LEFT JOIN c ON c.a = d.vec_id
""",
    "op5_substring_dedup": f"""
WITH {_WORDS},
k AS (
  SELECT doc_id, i, n, md5(string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h FROM w),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM k WHERE i <= n - 19),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM f WHERE nth > 1)
SELECT d.doc_id, count(w.i) AS n_words, count(c.i) AS n_removed,
       sha256(coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (c.i IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = w.doc_id AND c.i = w.i
GROUP BY d.doc_id
""",
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE {_WORDS},
s AS (
  SELECT DISTINCT doc_id, h FROM (
    SELECT doc_id, i, n, md5(string_agg(word, ' ') OVER (
      PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS h FROM w)
  WHERE i <= greatest(n - 4, 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM j JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 10 * common >= 8 * (x.n + y.n - common)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_links, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id,
       d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM documents d LEFT JOIN m ON m.a = d.doc_id LEFT JOIN c ON c.a = d.doc_id
""",
    "op7_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         md5(coalesce(text, '')) AS tk FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
sh AS (SELECT source, tokens, tokens / CAST((SELECT sum(tokens) FROM s) AS DOUBLE) AS share FROM s WHERE tokens > 0),
c AS (SELECT count(*) AS k, min(share) AS least FROM sh),
be(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, mid, ln(sum(pow(share, mid))) - mid * sum(pow(share, mid) * ln(share)) / sum(pow(share, mid))
             <= 0.95 * ln(max(k)) + 1e-12 AS ok
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM be WHERE i < 46), sh, c GROUP BY i, lo, hi, mid)),
br(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, mid, pow(max(least), mid - 1) / sum(pow(share, mid)) <= 4.0 + 1e-12 AS ok
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM br WHERE i < 46), sh, c GROUP BY i, lo, hi, mid)),
x AS (SELECT round(greatest((SELECT hi FROM be ORDER BY i DESC LIMIT 1), (SELECT hi FROM br ORDER BY i DESC LIMIT 1)), 9) AS x),
w AS (SELECT source, tokens, pow(share, (SELECT x FROM x)) / (SELECT sum(pow(share, x)) FROM sh, x) AS weight FROM sh),
g AS (SELECT source, tokens, weight, CAST(floor(round(weight * (SELECT sum(tokens) FROM s), 3)) AS BIGINT) AS goal FROM w),
r AS (
  SELECT d.doc_id, d.source, d.n_tokens, g.tokens, g.weight, g.goal, p.pass,
         md5('mix-1|' || p.pass || '|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.tk) AS key
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
  JOIN (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS pass) p ON p.pass < ceil(g.goal / CAST(g.tokens AS DOUBLE))),
t AS (
  SELECT *, pass * tokens + coalesce(sum(n_tokens) OVER (
    PARTITION BY source, pass ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, source, n_tokens, pass, CAST(floor(round(before / (weight * 1000000.0), 6)) AS BIGINT) AS block
FROM t WHERE before < goal
""",
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (c.key IS NOT NULL AND k.doc_id <> c.keep) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL OR k.doc_id = c.keep), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
""",
    "op13_infill": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN len(u) = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS prefix,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM p),
m AS (SELECT *, strpos(output, '<P>') AS pp, strpos(output, '<S>') AS ps, strpos(output, '<M>') AS pm FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN substr(output, 4, ps - 4) || substr(output, pm + 3) || substr(output, ps + 3, pm - ps - 3)
              ELSE substr(output, pp + 3, pm - pp - 3) || substr(output, pm + 3) || substr(output, 4, pp - 4) END) AS restored_sha256
FROM m
""",
}

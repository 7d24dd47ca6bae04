"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = r"""
WITH seen AS (
  SELECT page_id, CASE WHEN h <> '' AND NOT regexp_matches(h, '\s') THEN h END AS host, coalesce(nullif(p, ''), '/') AS path, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_at
  FROM (SELECT page_id, lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.')) AS h,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS p FROM pages)),
hosts AS (SELECT host AS domain, min(page_id) AS k FROM seen WHERE host IS NOT NULL GROUP BY host),
entries AS (
  SELECT 'ads' AS list_name, domain, '/' AS prefix, DATE '2024-01-01' + CAST(k % 200 AS INTEGER) AS since, 'add' AS action FROM hosts WHERE k % 3 = 0
  UNION ALL SELECT 'ads', domain, '/', DATE '2024-01-01' + CAST(k % 200 + 60 AS INTEGER), 'remove' FROM hosts WHERE k % 3 = 0
  UNION ALL SELECT 'ads', domain, '/', DATE '2024-01-01' + CAST(k % 200 + 120 AS INTEGER), 'add' FROM hosts WHERE k % 6 = 0
  UNION ALL SELECT 'spam', domain, '/en', DATE '2024-01-01' + CAST(k % 100 AS INTEGER), 'add' FROM hosts WHERE k % 3 = 1),
last AS (
  SELECT page_id, list_name, domain, prefix, arg_max(action, {'at': since, 'act': action}) AS action
  FROM seen JOIN entries ON (host = domain OR (ends_with(host, '.' || domain) AND contains(domain, '.')))
   AND since <= fetched_at AND (path = prefix OR starts_with(path, CASE WHEN ends_with(prefix, '/') THEN prefix ELSE prefix || '/' END))
  GROUP BY ALL),
per AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists FROM last WHERE action = 'add' GROUP BY page_id)
SELECT page_id, host, CAST(fetched_at AS VARCHAR) AS fetched_at, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(lists, '') AS lists, coalesce(n, 0) > 0 AS blocked
FROM seen LEFT JOIN per USING (page_id)
"""

OP4 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

_STOP = "', '".join(dict.fromkeys((
    "the of and to in is that for it was on are as with be this an a "
    "der die das und den von zu mit sich ist des im nicht ein eine auf für "
    "le la les de des et en un une du que est pour dans qui pas par sur avec "
    "el los las y del se por con no su para es lo como"
).split()))

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ('{_STOP}'))) AS n_stop,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 16 AND n_symbols / n_words <= 0.2 AND n_stop / n_words >= 0.02
       AND n_dup_lines / n_lines <= 0.5 AND (n_letters = 0 OR n_upper / n_letters <= 0.6) AS kept
FROM b
"""

# Matches and the pieces between them alternate, so positions are running sums of lengths.
_KINDS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 1),
    ("hex", "[0-9a-f]{32,}", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _op10() -> str:
    parts = []
    for k, (kind, pattern, group, least) in enumerate(_KINDS):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS o, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS gaps, "
            f"regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS vals FROM d WHERE regexp_matches(t, '{p}')"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(parts)}),
r AS (
  SELECT doc_id, o, kind, least, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'i': i, 'g': length(gaps[i]), 'n': length(hits[i]), 'v': length(vals[i])}})) AS x
  FROM a WHERE len(hits) > 0),
p AS (SELECT doc_id, o, kind, x.n AS n, x.v AS v, least, sum(x.g + x.n) OVER (PARTITION BY doc_id, o ORDER BY x.i) AS e FROM r),
f AS (SELECT doc_id, o, CAST(e - n AS BIGINT) AS s, kind || ':' || CAST(CAST(e - n AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS m FROM p WHERE v >= least),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
         coalesce(string_agg(m, ',' ORDER BY s, o) FILTER (WHERE o < 3), '') AS base, string_agg(m, ',' ORDER BY s, o) AS spans
  FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {{'i': i, 'k': array_to_string(w[i:i + 19], ' ')}})) AS x
  FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, x.i AS i, row_number() OVER (PARTITION BY x.k ORDER BY doc_id, x.i) AS n FROM g),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS hole FROM r WHERE n > 1 GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(hole), 0) AS m,
         list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: hole IS NULL OR NOT list_contains(hole, z[2])) AS z
  FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(list_transform(z, lambda y: y[1]), ' '), '')) AS kept_sha256
FROM k
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, u, len(u) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS UBIGINT)) AS k FROM d),
c AS (
  SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         CAST(least(k[1] % (n + 1), k[2] % (n + 1)) AS BIGINT) AS a, CAST(greatest(k[1] % (n + 1), k[2] % (n + 1)) AS BIGINT) AS b
  FROM r),
m AS (SELECT *, CAST(coalesce(list_sum(list_transform(u[1:a], lambda x: length(x))), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(list_transform(u[a + 1:b], lambda x: length(x))), 0) AS BIGINT) AS q FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, p + q + 1) || '<M>' || substr(t, p + 1, q)
                        ELSE '<S>' || substr(t, p + q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM m
"""

# CRC-32 by half bytes, low half first, over the distinct n-grams.
OP12 = r"""
WITH half AS (SELECT list_transform(range(0, 16), lambda i: list_reduce(range(0, 4), lambda v, s: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, CAST(i AS BIGINT))) AS t),
txt AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
num AS (SELECT *, row_number() OVER () AS r FROM txt),
w AS MATERIALIZED (
  SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM num),
f AS MATERIALIZED (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g
  FROM w),
u AS (SELECT DISTINCT g FROM f),
x AS (SELECT g, hex(encode(g)) AS h FROM u),
b AS MATERIALIZED (
  SELECT g, xor(list_reduce(
           list_transform(range(0, 2 * strlen(g)), lambda j: CAST(instr('0123456789ABCDEF', substr(h, CAST(CASE WHEN j % 2 = 0 THEN j + 2 ELSE j END AS BIGINT), 1)) - 1 AS BIGINT)),
           lambda c, v: xor(c // 16, t[CAST(xor(c % 16, v) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM x, half),
n AS MATERIALIZED (SELECT side, bucket, count(*) AS k FROM f JOIN b USING (g) GROUP BY side, bucket),
total AS (SELECT coalesce(sum(k) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(k) FILTER (WHERE side = 1), 0) AS t FROM n),
gain AS MATERIALIZED (
  SELECT i AS bucket, CAST(floor(1000 * ln((CAST(coalesce(d.k, 0) AS DOUBLE) + 1) * (CAST(s AS DOUBLE) + 10000) / ((CAST(c.k AS DOUBLE) + 1) * (CAST(t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket AS i, k FROM n WHERE side = 0) c LEFT JOIN (SELECT bucket, k FROM n WHERE side = 1) d ON i = d.bucket, total),
per AS (SELECT r, count(*) AS n_features, sum(gain) AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
sc AS (
  SELECT id AS doc_id, r, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS noise
  FROM w LEFT JOIN per USING (r) WHERE side = 0),
rk AS (SELECT *, weight + noise AS score, row_number() OVER (ORDER BY may DESC, weight + noise DESC, doc_id NULLS LAST) AS place FROM sc)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN may AND place <= 5 * (SELECT count(*) FROM sc WHERE may) // 100 THEN CAST(place AS BIGINT) END AS rank
FROM rk
"""

OP13 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h, min(page_id) OVER (PARTITION BY sha256(b)) AS k FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM k THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM k THEN k END AS refers_to
FROM q
"""

ORACLES = {
    "op2_url_filters": OP2,
    "op4_exact_dedup": OP4,
    "op6_quality_rules": OP6,
    "op9_substring_dedup": OP9,
    "op10_secret_scans": _op10(),
    "op11_fill_in_middle": OP11,
    "op12_importance_resampling": OP12,
    "op13_warc": OP13,
}

"""DuckDB SQL for the registered queries, composed of shared parts."""

from __future__ import annotations

# Fixed values, in the dialect of the oracle: the shapes that the operators look for.
ARTICLE = r"^Điều\s+(\d+)\.?\s*(.*)"
CHAPTER = r"(?i)^Chương\s+([IVXLCDM]+|\d+)[.\s]*[-–—]?\s*(.*)"
SECTION = r"(?i)^Mục\s+(\d+)[.\s]*[-–—]?\s*(.*)"
CLAUSE = r"^(\d+)\.\s+(.*)"
POINT = r"^([a-zđ])\)\s+(.*)"
APPENDIX = r"(?i)^Phụ\s+lục(?:\s+số)?(?:\s+([IVXLCDM]+|\d+[\p{L}\p{N}_]*))?\s*(.*)"
MENTION = r"(?i)Phụ\s+lục(?:\s+số)?\s+([IVXLCDM]+|\d+)"
ATTACHED = r"(?i)Phụ\s+lục\s+(?:ban\s+hành\s+)?kèm\s+theo"
FULL_NUMBER = r"(\d+)\s*/\s*(\d{4})\s*/\s*([A-ZĐ\-\d]+)"
SHORT_DECREE = r"(?i)(?:nghị\s*định|nđ|nd)\s*(\d+)"
REF = r"(?i)(?:điểm\s+([a-zđ])\s+)?(?:khoản\s+(\d+)\s+)?điều\s+(\d+)"
CITATION = r"\[Điều\s+([\p{L}\p{N}_]+)(?:,\s*Khoản\s+([\p{L}\p{N}_]+))?(?:,\s*Điểm\s+([\p{L}\p{N}_]+))?\s*[—\-]+\s*([^\]]+)\]"
CITED = r"\d+/\d{4}/[A-ZĐ0-9\-]+"
STOP = "'là','và','của','cho','các','có','được','trong','theo','với','một','khi','hoặc','từ','này','đó','tại','do','để','sẽ','đã','nếu','bị','bởi'"
BROAD = (
    "(?i)khi nào|liệt kê|có mấy|trường hợp nào|các trường hợp|những trường hợp|lỗi nào|các lỗi|những lỗi|hành vi nào|các hành vi|những hành vi|"
    "hạng nào|các hạng|những hạng|loại nào|các loại|những loại|danh sách|điều kiện|bao gồm|gồm những"
)
REFUSAL = "Thông tin này không có trong tài liệu được cung cấp"


def ex(c: str, p: str, g: int) -> str:
    return f"regexp_extract({c}, '{p}', {g})"


def has(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p}')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def roman(e: str) -> str:
    v = lambda i: f"CASE upper(substr({e}, {i}, 1)) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END"
    one = f"CASE WHEN ({v('i')}) < ({v('i + 1')}) THEN -({v('i')}) ELSE ({v('i')}) END"
    return rf"CASE WHEN {e} IS NULL THEN NULL WHEN regexp_matches({e}, '^\d+$') THEN TRY_CAST({e} AS INTEGER) ELSE CAST(coalesce(list_sum(list_transform(range(1, length({e}) + 1), lambda i: {one})), 0) AS INTEGER) END"


def tokens(c: str) -> str:
    clean = rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    return rf"list_filter(string_split_regex({clean}, '\s+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"


BLOCKS = r"""
b0 AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key, list_filter(list_transform(string_split_regex(text, '[\n.]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
b1 AS (SELECT doc_key, len(l) AS n, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM b0),
blk AS (
  SELECT doc_key, i AS block_idx, CASE
    WHEN n >= 12 AND i = n - 2 THEN 'Phụ lục I ' || s
    WHEN i % 24 = 0 THEN 'Chương ' || CAST(1 + i // 24 AS VARCHAR)
    WHEN i % 24 = 2 THEN 'Mục 1. ' || s
    WHEN i % 24 IN (4, 11, 15) THEN 'Điều ' || CAST(i AS VARCHAR) || '. ' || s
    WHEN i % 24 IN (6, 12, 18) THEN '1. ' || s
    WHEN i % 24 = 10 THEN '2. ' || s || ' theo Phụ lục I'
    WHEN i % 24 IN (13, 19) THEN '3. ' || s || ' hình thức xử phạt bổ sung'
    WHEN i % 24 IN (7, 20) THEN 'a) ' || s
    WHEN i % 24 IN (9, 21) THEN 'b) ' || s
    WHEN i % 24 = 14 THEN 'đ) ' || s
    ELSE s END AS raw
  FROM b1)"""

KIND = f"CASE WHEN {has('x', ARTICLE)} THEN 'D' WHEN {has('x', CHAPTER)} THEN 'C' WHEN {has('x', SECTION)} THEN 'M' WHEN {has('x', CLAUSE)} THEN 'K' WHEN {has('x', POINT)} THEN 'P' ELSE 'O' END"


def _part(g: int, t: str = "t") -> str:
    cases = " ".join(f"WHEN '{k}' THEN {ex('x', p, g)}" for k, p in (("D", ARTICLE), ("C", CHAPTER), ("M", SECTION), ("K", CLAUSE), ("P", POINT)))
    return f"CASE {t} {cases} END"


LINES = f"""{BLOCKS},
ln0 AS (SELECT doc_key, block_idx, {strip('raw')} AS x FROM blk),
ln1 AS (SELECT *, {KIND} AS t, {has('x', APPENDIX)} AS is_pl FROM ln0 WHERE x <> ''),
ln2 AS (SELECT *, coalesce(max(CASE WHEN t = 'D' THEN block_idx END) OVER (PARTITION BY doc_key), -1) AS last_d FROM ln1),
ln3 AS (SELECT *, min(CASE WHEN is_pl AND block_idx > last_d THEN block_idx END) OVER (PARTITION BY doc_key) AS pl_start FROM ln2),
ln AS (SELECT *, coalesce(block_idx >= pl_start, false) AS in_appendix FROM ln3)"""

STATE = f"""{LINES},
s1 AS (
  SELECT doc_key, block_idx, x, t, sum(CASE WHEN t = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY block_idx) AS dgrp,
         coalesce(bool_or(t IN ('C', 'D')) OVER (PARTITION BY doc_key ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS has_ch
  FROM ln WHERE NOT in_appendix),
s2 AS (
  SELECT *, coalesce(bool_or(t = 'M' AND has_ch) OVER w, false) AS m_seen, coalesce(bool_or(t = 'C') OVER w, false) AS c_seen,
         max(CASE WHEN t IN ('C', 'K') THEN block_idx * 2 + CASE WHEN t = 'C' THEN 1 ELSE 0 END END) OVER w AS ck
  FROM s1 WINDOW w AS (PARTITION BY doc_key, dgrp ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (
  SELECT *, CASE WHEN t = 'D' THEN 'dieu' WHEN m_seen AND t = 'M' THEN 'muc' WHEN m_seen THEN 'muc_name'
              WHEN ck % 2 = 1 AND t NOT IN ('M', 'D', 'K') THEN 'chuong_name' WHEN t = 'C' THEN 'chuong' WHEN t = 'M' AND has_ch THEN 'muc'
              WHEN t = 'K' AND dgrp > 0 AND NOT c_seen THEN 'khoan' ELSE 'body' END AS e
  FROM s2),
s4 AS (
  SELECT *, dgrp > 0 AND e NOT IN ('chuong', 'muc') AND NOT coalesce(bool_or(e IN ('chuong', 'muc')) OVER (PARTITION BY doc_key, dgrp ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS active,
         sum(CASE WHEN e = 'khoan' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key, dgrp ORDER BY block_idx) AS khoan_ord,
         sum(CASE WHEN e = 'chuong' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY block_idx) AS chuong_ord
  FROM s3),
s5 AS (SELECT * EXCLUDE (e), CASE WHEN e = 'body' AND t = 'P' AND active AND khoan_ord > 0 THEN 'diem' ELSE e END AS eff FROM s4),
st AS (
  SELECT *, sum(CASE WHEN eff = 'diem' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key, dgrp, khoan_ord ORDER BY block_idx) AS diem_ord,
         sum(CASE WHEN eff = 'muc' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key, chuong_ord ORDER BY block_idx) AS muc_ord
  FROM s5)"""

NODES = f"""{STATE},
nm AS (
  SELECT doc_key, CASE WHEN eff LIKE 'chuong%' THEN 'chuong' ELSE 'muc' END AS level, chuong_ord, CASE WHEN eff LIKE 'muc%' THEN muc_ord ELSE 0 END AS muc_ord,
         max(CASE WHEN eff IN ('chuong', 'muc') THEN {_part(1)} END) AS so_raw,
         coalesce(string_agg(nullif(CASE WHEN eff IN ('chuong', 'muc') THEN {strip(_part(2))} ELSE x END, ''), ' ' ORDER BY block_idx), '') AS ten
  FROM st WHERE eff IN ('chuong', 'chuong_name', 'muc', 'muc_name') GROUP BY ALL),
names AS (SELECT doc_key, level, chuong_ord, muc_ord, {roman('so_raw')} AS so, ten FROM nm),
nd0 AS (
  SELECT doc_key, dgrp, khoan_ord, diem_ord, min(chuong_ord) AS chuong_ord, min(muc_ord) AS muc_ord,
         max(CASE WHEN eff IN ('dieu', 'khoan', 'diem') THEN {_part(1)} END) AS number, max(CASE WHEN eff IN ('dieu', 'khoan', 'diem') THEN {strip(_part(2))} END) AS head,
         string_agg(x, ' ' ORDER BY block_idx) FILTER (WHERE eff NOT IN ('dieu', 'khoan', 'diem')) AS rest
  FROM st WHERE active GROUP BY doc_key, dgrp, khoan_ord, diem_ord),
nd AS (
  SELECT n.* EXCLUDE (rest), CASE WHEN khoan_ord > 0 THEN head || coalesce(' ' || rest, '') ELSE coalesce(rest, '') END AS text,
         coalesce(c.so, 0) AS chuong_so, coalesce(c.ten, '') AS chuong_ten, m.so AS muc_so, m.ten AS muc_ten
  FROM nd0 n LEFT JOIN names c ON c.level = 'chuong' AND c.doc_key = n.doc_key AND c.chuong_ord = n.chuong_ord
  LEFT JOIN names m ON m.level = 'muc' AND m.doc_key = n.doc_key AND m.chuong_ord = n.chuong_ord AND m.muc_ord = n.muc_ord)"""

PL = f"""
pl0 AS (SELECT doc_key, block_idx, x, is_pl, sum(CASE WHEN is_pl THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY block_idx) AS pl_idx FROM ln WHERE in_appendix),
pl1 AS (SELECT doc_key, pl_idx, max(CASE WHEN is_pl THEN x END) AS line, coalesce(string_agg(x, ' ' ORDER BY block_idx) FILTER (WHERE NOT is_pl), '') AS noi_dung FROM pl0 WHERE pl_idx > 0 GROUP BY ALL),
pl AS (SELECT doc_key, pl_idx, {roman(f"nullif({ex('line', APPENDIX, 1)}, '')")} AS so, {strip(ex('line', APPENDIX, 2))} AS ten, noi_dung FROM pl1)"""

CHUNKS = f"""{NODES},{PL},
art AS (SELECT doc_key, dgrp, CAST(number AS INTEGER) AS dieu_so, head AS dieu_ten, text AS noi_dung_dieu FROM nd WHERE khoan_ord = 0),
cla AS (SELECT doc_key, dgrp, khoan_ord, CAST(number AS INTEGER) AS khoan_so, text AS noi_dung_khoan FROM nd WHERE khoan_ord > 0 AND diem_ord = 0),
lf0 AS (
  SELECT n.*, max(khoan_ord) OVER (PARTITION BY doc_key, dgrp) AS nk, max(diem_ord) OVER (PARTITION BY doc_key, dgrp, khoan_ord) AS np FROM nd n),
lf AS (
  SELECT l.doc_key, l.dgrp, l.khoan_ord, l.diem_ord, chuong_so, chuong_ten, muc_so, muc_ten, dieu_so, dieu_ten, noi_dung_dieu, khoan_so, coalesce(noi_dung_khoan, '') AS noi_dung_khoan,
         CASE WHEN l.diem_ord > 0 THEN number END AS diem, CASE WHEN l.diem_ord > 0 THEN text ELSE '' END AS noi_dung_diem,
         row_number() OVER (PARTITION BY l.doc_key ORDER BY l.dgrp, l.khoan_ord, l.diem_ord) - 1 AS chunk_seq
  FROM lf0 l JOIN art a ON a.doc_key = l.doc_key AND a.dgrp = l.dgrp
  LEFT JOIN cla c ON c.doc_key = l.doc_key AND c.dgrp = l.dgrp AND c.khoan_ord = l.khoan_ord
  WHERE l.diem_ord > 0 OR (l.khoan_ord > 0 AND np = 0) OR nk = 0),
reg AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_key, doc_id || '/2024/NĐ-CP' AS so_hieu, 'Nghị định ' || doc_id AS ten_van_ban, 'nghi_dinh' AS loai_van_ban, source AS co_quan_ban_hanh,
         '2024-06-27' AS ngay_ban_hanh, '2025-01-01' AS ngay_hieu_luc, doc_id % 10 <> 0 AS con_hieu_luc, 'raw/' || doc_id || '.docx' AS source_file
  FROM documents),
gap AS (SELECT * FROM reg WHERE CAST(doc_key AS BIGINT) % 17 <> 0),
ch AS (
  SELECT doc_key, chunk_seq, replace(replace(so_hieu, '/', '_'), '-', '_') || '_d' || dieu_so || CASE WHEN khoan_so IS NULL THEN '' ELSE '_k' || khoan_so END || CASE WHEN diem IS NULL THEN '' ELSE '_d' || diem END AS chunk_id,
         so_hieu, ten_van_ban, loai_van_ban, coalesce(co_quan_ban_hanh, '') AS co_quan_ban_hanh, ngay_ban_hanh, ngay_hieu_luc, CAST(NULL AS VARCHAR) AS ngay_het_hieu_luc, con_hieu_luc, chuong_so, chuong_ten, muc_so, muc_ten, dieu_so, khoan_so, diem,
         source_file, dieu_ten, noi_dung_dieu, noi_dung_khoan, noi_dung_diem, CASE WHEN noi_dung_diem <> '' THEN 3 WHEN noi_dung_khoan <> '' THEN 2 ELSE 1 END AS level, false AS is_sibling,
         'Điều ' || dieu_so || ': ' || dieu_ten || CASE WHEN noi_dung_dieu <> '' THEN chr(10) || noi_dung_dieu ELSE '' END || chr(10) || CASE WHEN khoan_so IS NULL THEN '' ELSE khoan_so || '. ' || noi_dung_khoan END
           || chr(10) || CASE WHEN diem IS NULL THEN '' ELSE diem || '. ' || noi_dung_diem END AS page_content
  FROM lf JOIN reg USING (doc_key)),
me AS (SELECT doc_key, chunk_seq, unnest(list_zip(regexp_extract_all(page_content, '{MENTION}', 1), range(1, len(regexp_extract_all(page_content, '{MENTION}')) + 1))) AS z FROM ch),
mf AS (SELECT doc_key, chunk_seq, {roman('z[1]')} AS so, min(z[2]) AS pos, min_by(z[1], z[2]) AS raw FROM me GROUP BY ALL),
la AS (SELECT doc_key, so, max_by(ten, pl_idx) AS ten, max_by(noi_dung, pl_idx) AS noi_dung FROM pl GROUP BY ALL),
rf AS (
  SELECT f.doc_key, f.chunk_seq, pos, 'Phụ lục ' || raw || ': ' || ten || ' ' || noi_dung AS ref FROM mf f JOIN la ON la.doc_key = f.doc_key AND la.so = f.so
  UNION ALL SELECT c.doc_key, c.chunk_seq, 1000000, 'Phụ lục kèm theo: ' || ten || ' ' || noi_dung FROM ch c JOIN la ON la.doc_key = c.doc_key AND la.so IS NULL WHERE {has('page_content', ATTACHED)}),
rg AS (SELECT doc_key, chunk_seq, string_agg(ref, ' || ' ORDER BY pos) AS refs FROM rf GROUP BY ALL),
pay AS MATERIALIZED (SELECT ch.*, coalesce(refs, '') AS refs, row_number() OVER (ORDER BY ch.doc_key, ch.chunk_seq) - 1 AS row_id FROM ch LEFT JOIN rg ON rg.doc_key = ch.doc_key AND rg.chunk_seq = ch.chunk_seq)"""

STATS = f"""
tk AS MATERIALIZED (SELECT list_distinct({tokens('text')}) AS w FROM documents),
dc AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM tk) GROUP BY term),
df AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf0 FROM dc, (SELECT count(*) AS n_docs FROM tk)),
ts AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * avg(idf0) OVER () END AS idf FROM df)"""
BM = f"""
bq AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN text || ' ' || text ELSE text END || CASE WHEN item_id % 4 = 0 THEN ' các hành vi' ELSE '' END AS text FROM benchmark),
tk AS (SELECT doc_id AS row_id, {tokens('text')} AS w FROM documents),
po AS (SELECT row_id, term, count(*) AS tf, dl FROM (SELECT row_id, len(w) AS dl, unnest(w) AS term FROM tk) GROUP BY ALL),
cs AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_tokens, avg(len(w)) AS avgdl FROM tk),
df AS (SELECT term, count(*) AS df, ln(max(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM po, cs GROUP BY term),
ts AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * (SELECT avg(idf0) FROM df) END AS idf FROM df),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM bq) GROUP BY ALL),
sc AS (SELECT query_id, row_id, list_reduce(list(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) ORDER BY term), lambda a, b: a + b) AS score FROM qt JOIN ts USING (term) JOIN po USING (term), cs GROUP BY ALL),
sa AS (SELECT query_id, doc_id AS row_id, coalesce(score, 0) AS score FROM bq CROSS JOIN documents LEFT JOIN sc ON sc.query_id = bq.query_id AND sc.row_id = documents.doc_id),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM sa) WHERE rank <= 30)"""
BM = BM.replace("SELECT query_id, doc_id AS row_id, coalesce", "SELECT bq.query_id, doc_id AS row_id, coalesce")

DE = """
dv AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
qv AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
ds AS (SELECT query_id, row_id, list_cosine_similarity(v, q) AS score FROM dv, qv),
dt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM ds) WHERE rank <= 30)"""

FU = f"""{BM},{DE},
fu AS (
  SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.row_id, b.row_id) AS row_id, d.rank AS dense_rank, b.rank AS bm25_rank,
         coalesce(1.0 / (60 + CAST(d.rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(b.rank AS DOUBLE)), 0) AS score
  FROM dt d FULL JOIN bt b ON d.query_id = b.query_id AND d.row_id = b.row_id),
fp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, row_id) AS pos FROM fu)"""


def _hybrid(k: int) -> str:
    return f"SELECT f.query_id, pos, row_id, round(score, 9) AS score, false AS is_sibling FROM fp f JOIN bq USING (query_id) WHERE pos <= CASE WHEN {has('text', BROAD)} THEN 25 ELSE {k} END"


RQ = """
rq AS (
  SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Điểm a ' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'Khoản 1 ' ELSE '' END || 'Điều '
         || CASE o_orderkey % 4 WHEN 0 THEN '4' WHEN 1 THEN '11' WHEN 2 THEN '15' ELSE '28' END
         || CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 <= 2 THEN ' Nghị định ' || (o_custkey % n) ELSE ' Nghị định ' || (o_custkey % n) || '/2024/NĐ-CP' END AS text
  FROM orders, (SELECT count(*) AS n FROM documents))"""

REFS = f"""{CHUNKS},{RQ},
sn AS (SELECT split_part(so_hieu, '/', 1) AS num, min_by(so_hieu, row_id) AS short FROM pay GROUP BY ALL),
r0 AS (
  SELECT query_id, CASE WHEN {has('upper(text)', FULL_NUMBER)} THEN {ex('upper(text)', FULL_NUMBER, 1)} || '/' || {ex('upper(text)', FULL_NUMBER, 2)} || '/' || {ex('upper(text)', FULL_NUMBER, 3)}
         ELSE short END AS so_hieu, text
  FROM rq LEFT JOIN sn ON sn.num = nullif({ex('text', SHORT_DECREE, 1)}, '')),
rr AS (
  SELECT query_id, CAST(0 AS BIGINT) AS ref_idx, so_hieu, CAST({ex('text', REF, 3)} AS INTEGER) AS dieu_so, TRY_CAST(nullif({ex('text', REF, 2)}, '') AS INTEGER) AS khoan_so,
         lower(nullif({ex('text', REF, 1)}, '')) AS diem FROM r0 WHERE {has('text', REF)}),
el AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ref_idx, row_id) AS pos, row_id, CAST(0 AS DOUBLE) AS score, false AS is_sibling
  FROM rr r JOIN pay p ON p.so_hieu = r.so_hieu AND p.dieu_so = r.dieu_so AND (r.khoan_so IS NULL OR r.khoan_so = p.khoan_so) AND (r.diem IS NULL OR r.diem = p.diem))"""

DONE = " OR ".join(f"contains(lower(page_content), '{p}')" for p in ("còn bị trừ điểm giấy phép", "bị trừ điểm giấy phép lái xe", "hình thức xử phạt bổ sung", "tước quyền sử dụng giấy phép", "tịch thu phương tiện", "gây tai nạn giao thông"))
SIB = f"""
sl AS (SELECT row_id, so_hieu, dieu_so, khoan_so, ({DONE}) AS done FROM pay WHERE so_hieu <> '' AND dieu_so <> 0),
sb AS (SELECT a.row_id, b.row_id AS sibling_id FROM sl a JOIN sl b ON a.so_hieu = b.so_hieu AND a.dieu_so = b.dieu_so AND a.row_id <> b.row_id
       WHERE b.done OR abs(a.khoan_so - b.khoan_so) BETWEEN 1 AND 2)"""
ATT = f"""{SIB},
a0 AS (
  SELECT e.query_id, sibling_id AS row_id, min(pos) AS first FROM el e JOIN sb ON sb.row_id = e.row_id
  WHERE NOT EXISTS (SELECT 1 FROM el x WHERE x.query_id = e.query_id AND x.row_id = sibling_id) GROUP BY ALL),
a1 AS (SELECT query_id, 0 AS g, pos, row_id, false AS is_sibling FROM el UNION ALL SELECT query_id, 1, first, row_id, true FROM a0),
at AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY g, pos, row_id) AS pos, row_id, CAST(0 AS DOUBLE) AS score, is_sibling FROM a1)""".replace("at AS (", "att AS (")

AN = """
an0 AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
an1 AS (
  SELECT d.doc_id AS query_id, text AS raw, d.doc_id % 3 = 0 AS has_history, quality, CASE quality WHEN 1 THEN 'legal_rag' WHEN 0 THEN 'out_of_scope' END AS cat
  FROM documents d LEFT JOIN an0 ON an0.doc_id = d.doc_id),
an2 AS (SELECT *, CASE WHEN cat IS NULL OR NOT has_history THEN raw ELSE '» ' || raw END AS query FROM an1),
an AS (SELECT *, coalesce(cat, 'legal_rag') AS category, CASE WHEN cat IS NULL THEN raw WHEN query_id % 5 = 0 THEN query ELSE coalesce(nullif(lower(raw), ''), query) END AS retrieval FROM an2)"""
CITE = "' [Điều ' || turn || ', Khoản 2, Điểm a — Nghị định ' || conv_id || '/2024/NĐ-CP]'"
ANS = f"""
ans AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 THEN '{REFUSAL}.' WHEN conv_id % 10 = 1 THEN ' {REFUSAL} '
         ELSE text || {CITE} || CASE WHEN conv_id % 2 = 0 THEN {CITE} ELSE '' END || ' [Điều ' || turn || ' - không số]' END AS answer
  FROM conversations WHERE role = 'assistant'),
ct0 AS (SELECT conv_id, turn, unnest(list_zip(regexp_extract_all(answer, '{CITATION}'), range(0, len(regexp_extract_all(answer, '{CITATION}'))))) AS z FROM ans),
ct1 AS (
  SELECT conv_id, turn, z[2] AS i, nullif(regexp_extract({strip(ex('z[1]', CITATION, 4))}, '{CITED}'), '') AS so_hieu, {strip(ex('z[1]', CITATION, 4))} AS ten_van_ban,
         {ex('z[1]', CITATION, 1)} AS dieu_so, nullif({ex('z[1]', CITATION, 2)}, '') AS khoan_so, nullif({ex('z[1]', CITATION, 3)}, '') AS diem FROM ct0),
ct2 AS (SELECT conv_id, turn, so_hieu, dieu_so, khoan_so, diem, min(i) AS i, min_by(ten_van_ban, i) AS ten_van_ban FROM ct1 WHERE so_hieu IS NOT NULL GROUP BY ALL),
ct AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS pos, so_hieu, ten_van_ban, dieu_so, khoan_so, diem FROM ct2)"""
REFUSED = rf"regexp_replace({strip('answer')}, '\.+$', '') = '{REFUSAL}'"
PAY_COLUMNS = "page_content, chunk_id, so_hieu, ten_van_ban, loai_van_ban, co_quan_ban_hanh, ngay_ban_hanh, ngay_hieu_luc, ngay_het_hieu_luc, con_hieu_luc, chuong_so, chuong_ten, muc_so, muc_ten, dieu_so, khoan_so, diem, source_file, dieu_ten, noi_dung_dieu, noi_dung_khoan, noi_dung_diem, level, is_sibling"
L = lambda *cs: ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cs)
OUT = "\n    Xin lỗi, tôi chỉ tư vấn về Luật Giao thông Việt Nam và không giải quyết các \n    vấn đề ngoài phạm vi này. Bạn có thể hỏi tôi về mức phạt vi phạm, quy định \n    đăng ký xe, đăng kiểm, cấp giấy phép lái xe, v.v.\n"

ORACLES = {
    "tokenize": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
    "roman_to_int": rf"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, {roman('word')} AS value FROM w",
    "parse_heading": f"WITH {BLOCKS}, k AS (SELECT doc_key, block_idx, raw AS x, {KIND.replace('(x,', '(raw,')} AS t FROM blk) SELECT doc_key, CAST(block_idx AS INTEGER) AS block_idx, t AS kind, {_part(1)} AS number, {strip(_part(2))} AS rest FROM k",
    "classify_structure": f"WITH {STATE} SELECT doc_key, CAST(block_idx AS INTEGER) AS block_idx, t, eff, active, {L('dgrp', 'khoan_ord', 'diem_ord', 'chuong_ord', 'muc_ord')} FROM st",
    "structure_nodes": f"WITH {NODES} SELECT doc_key, {L('dgrp', 'khoan_ord', 'diem_ord', 'chuong_so', 'muc_so')}, chuong_ten, muc_ten, number, head, text FROM nd",
    "heading_names": f"WITH {NODES} SELECT doc_key, level, {L('chuong_ord', 'muc_ord')}, so, ten FROM names",
    "split_appendix": f"WITH {LINES} SELECT doc_key, CAST(block_idx AS INTEGER) AS block_idx, in_appendix FROM ln",
    "appendices": f"WITH {LINES},{PL} SELECT doc_key, {L('pl_idx')}, so, ten, noi_dung FROM pl",
    "chunks": f"WITH {CHUNKS} SELECT doc_key, {L('chunk_seq')}, {PAY_COLUMNS} FROM ch",
    "chunk_counts": f"WITH {CHUNKS} SELECT doc_key, count(*) AS n_chunks FROM ch GROUP BY ROLLUP (doc_key)",
    "outline": f"""WITH {NODES},
a AS (SELECT doc_key, dgrp, CAST(number AS INTEGER) AS dieu_so, substr(head, 1, 60) AS dieu_preview FROM nd WHERE khoan_ord = 0),
k AS (SELECT doc_key, dgrp, khoan_ord, CAST(max(number) FILTER (WHERE diem_ord = 0) AS INTEGER) AS khoan_so, substr(max(text) FILTER (WHERE diem_ord = 0), 1, 50) AS khoan_preview, count(*) FILTER (WHERE diem_ord > 0) AS n_diem
      FROM nd WHERE khoan_ord > 0 GROUP BY ALL)
SELECT a.doc_key, CAST(a.dgrp AS BIGINT) AS dgrp, dieu_so, dieu_preview, CAST(khoan_ord AS BIGINT) AS khoan_ord, khoan_so, khoan_preview, n_diem FROM a LEFT JOIN k ON k.doc_key = a.doc_key AND k.dgrp = a.dgrp""",
    "link_appendices": f"WITH {CHUNKS} SELECT doc_key, {L('chunk_seq')}, refs FROM pay",
    "table_markdown": """WITH r AS (
  SELECT l_orderkey, {'a': l_linenumber, 'b': l_partkey, 'c': l_returnflag, 'd': l_linestatus} AS k, CASE l_linestatus WHEN 'F' THEN 2 ELSE 3 END AS n,
         '| ' || l_linenumber || ' | ' || l_partkey || CASE l_linestatus WHEN 'F' THEN '' ELSE ' | ' || l_returnflag || ' ' || l_linestatus END || ' |' AS line
  FROM lineitem),
g AS (SELECT l_orderkey, list(line ORDER BY k) AS l, arg_min(n, k) AS n FROM r GROUP BY l_orderkey)
SELECT l_orderkey, l[1] || chr(10) || CASE n WHEN 2 THEN '| --- | --- |' ELSE '| --- | --- | --- |' END || coalesce(chr(10) || nullif(array_to_string(l[2:], chr(10)), ''), '') AS markdown FROM g""",
    "row_ids": f"WITH {CHUNKS} SELECT doc_key, {L('chunk_seq', 'row_id')} FROM pay",
    "registry_join": f"WITH {CHUNKS} SELECT doc_key, so_hieu, co_quan_ban_hanh, con_hieu_luc, count(*) AS n_blocks FROM blk JOIN gap USING (doc_key) GROUP BY ALL",
    "unregistered": f"WITH {CHUNKS} SELECT DISTINCT doc_key FROM blk WHERE doc_key NOT IN (SELECT doc_key FROM gap)",
    "payload": f"WITH {CHUNKS} SELECT {L('row_id')}, {PAY_COLUMNS}, refs AS noi_dung_tham_chieu FROM pay",
    "upsert": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id DESC) AS n FROM events),
o AS (SELECT event_id, user_id, event_type FROM e WHERE n = 1 AND event_id % 2 = 1), b AS (SELECT event_id, user_id, event_type FROM e WHERE n = 1 AND event_id % 2 = 0)
SELECT * FROM o UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM o)""",
    "points_per_source": f"WITH {CHUNKS} SELECT source_file, count(*) AS n_points FROM pay GROUP BY ROLLUP (source_file)",
    "corpus_stats": f"WITH {BM} SELECT n_docs, n_tokens, round(avgdl, 6) AS avgdl FROM cs",
    "term_stats": f"WITH {STATS} SELECT term, df, round(idf, 6) AS idf FROM ts",
    "postings": f"WITH {BM} SELECT row_id, term, tf, dl FROM po",
    "bm25_topk": f"WITH {BM} SELECT query_id, row_id, round(score, 6) AS score, rank, length(text) AS n_chars FROM bt JOIN documents ON doc_id = row_id",
    "dense_topk": f"WITH {DE} SELECT query_id, row_id, round(score, 6) AS score, rank FROM dt",
    "rrf_hybrid": f"WITH {FU} SELECT query_id, row_id, round(score, 9) AS score, dense_rank, bm25_rank FROM fu",
    "broad_topk": f"WITH {FU} {_hybrid(5)}",
    "legal_refs": f"WITH {REFS} SELECT * FROM rr",
    "doc_id": f"WITH {RQ} SELECT query_id, CASE WHEN {has('upper(text)', FULL_NUMBER)} THEN {ex('upper(text)', FULL_NUMBER, 1)} || '/' || {ex('upper(text)', FULL_NUMBER, 2)} || '/' || {ex('upper(text)', FULL_NUMBER, 3)} END AS full_number, nullif({ex('text', SHORT_DECREE, 1)}, '') AS short_number FROM rq",
    "explicit_lookup": f"WITH {REFS} SELECT * FROM el",
    "location_filter": f"""WITH {CHUNKS}
SELECT 'article' AS place, row_id, chunk_id, CAST(0 AS DOUBLE) AS score FROM pay WHERE so_hieu = '1/2024/NĐ-CP' AND dieu_so = 4
UNION ALL SELECT 'clause', row_id, chunk_id, 0 FROM pay WHERE so_hieu = '2/2024/NĐ-CP' AND dieu_so = 4 AND khoan_so = 1
UNION ALL SELECT 'point', row_id, chunk_id, 0 FROM pay WHERE so_hieu = '3/2024/NĐ-CP' AND dieu_so = 4 AND khoan_so = 1 AND diem = 'a'""",
    "sibling_map": f"WITH {CHUNKS},{SIB} SELECT * FROM sb",
    "attach_siblings": f"WITH {REFS},{ATT} SELECT * FROM att",
    "explicit_else_hybrid": f"WITH {REFS},{FU}, hy AS ({_hybrid(15)}) SELECT * FROM el UNION ALL SELECT * FROM hy WHERE query_id NOT IN (SELECT query_id FROM el)",
    "rerank": f"""WITH {FU}, h AS (SELECT f.query_id, f.pos, f.row_id, q.text AS q, d.text AS d FROM fp f JOIN bq q USING (query_id) JOIN documents d ON d.doc_id = f.row_id WHERE f.pos <= 30),
s AS (SELECT query_id, pos, row_id, q, CAST(len(list_intersect(list_distinct({tokens('q')}), list_distinct({tokens('d')}))) AS DOUBLE) AS score FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS np FROM s)
SELECT query_id, np AS pos, row_id, score, false AS is_sibling FROM p WHERE np <= CASE WHEN {has('q', BROAD)} THEN 25 ELSE 5 END""",
    "history": f"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 7 = 3 THEN '' ELSE {strip('text')} END AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN coalesce(x, '') <> '' THEN '  ' || CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || ': ' || x
  || CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN chr(10) || '    (Nguồn đã trích dẫn: [1] Điều ' || turn || ' · Khoản 2 · Nghị định)' ELSE '' END END AS line FROM t WHERE rn <= 6)
SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY turn), '(chưa có)') AS history FROM l GROUP BY conv_id""",
    "citations": f"WITH {ANS} SELECT conv_id, turn, pos, so_hieu, ten_van_ban, dieu_so, khoan_so, diem FROM ct",
    "refused": f"WITH {ANS} SELECT conv_id, turn, {REFUSED} AS refused FROM ans",
    "analyzer_defaults": f"WITH {AN} SELECT query_id, category, query, retrieval FROM an",
    "route": f"WITH {AN} SELECT query_id, category, CASE WHEN category <> 'legal_rag' THEN '{OUT}' END AS answer, CASE WHEN category <> 'legal_rag' THEN false END AS refused FROM an",
    "validity": f"""WITH {CHUNKS} SELECT row_id,
CASE WHEN NOT con_hieu_luc THEN '⚠️ Điều này đã hết hiệu lực' || CASE WHEN row_id % 2 = 0 THEN ' từ 2025-01-01' ELSE '' END END AS expired,
CASE WHEN row_id % 4 IN (0, 1) OR row_id % 8 = 2 THEN '⚠️ Điều này ' || CASE WHEN row_id % 4 = 0 THEN 'đã được sửa đổi' WHEN row_id % 4 = 1 THEN 'có thay đổi (khac)' ELSE 'đã bị bãi bỏ' END
  || CASE WHEN row_id % 3 = 0 THEN ' bởi `' || so_hieu || '`' ELSE '' END END AS changed FROM pay""",
    "l2_normalize": """SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(CAST(round(x / n * 10000) AS BIGINT) AS VARCHAR)), ' ') AS unit
FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings))""",
    "response": f"""WITH {AN},{ANS},
f AS (SELECT conv_id AS query_id, min(turn) AS turn, min_by(answer, turn) AS answer, count(*) AS n FROM ans GROUP BY conv_id),
s AS (SELECT an.query_id, query, category, f.turn, CASE WHEN category <> 'legal_rag' THEN '{OUT}' WHEN an.query_id % 11 = 0 OR n IS NULL THEN '' ELSE answer END AS answer,
        CASE WHEN category <> 'legal_rag' OR an.query_id % 11 = 0 THEN false WHEN n IS NULL THEN true ELSE {REFUSED} END AS refused FROM an LEFT JOIN f ON f.query_id = an.query_id)
SELECT query_id, sha256(answer) AS answer_sha256, CASE WHEN category = 'legal_rag' AND answer <> '' THEN (SELECT count(*) FROM ct WHERE ct.conv_id = s.query_id AND ct.turn = s.turn) ELSE 0 END AS n_sources,
       refused, category, CASE WHEN category = 'legal_rag' THEN 'local/test' ELSE '' END AS model_info, query FROM s""",
    "context": f"""WITH {REFS},{ATT},
bl AS (SELECT a.query_id, pos, '[' || CASE WHEN a.is_sibling THEN 'Ngữ cảnh bổ sung — cùng Điều' ELSE 'Nguồn ' || pos END || '] ' || ten_van_ban || ' (' || so_hieu || ') · Điều ' || dieu_so || CASE WHEN khoan_so IS NULL THEN '' ELSE ' · Khoản ' || khoan_so END
  || CASE WHEN diem IS NULL THEN '' ELSE ' · Điểm ' || diem END || chr(10) || page_content || CASE WHEN refs <> '' THEN chr(10) || '[''' || replace(replace(refs, '\\', '\\\\'), chr(10), '\\n') || ''']' ELSE '' END AS t
  FROM att a JOIN pay p ON p.row_id = a.row_id),
c AS (SELECT rq.query_id, rq.text, coalesce(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos), '(Không có ngữ cảnh nào được truy xuất.)') AS context FROM rq LEFT JOIN bl ON bl.query_id = rq.query_id GROUP BY ALL)
SELECT query_id, sha256('NGỮ CẢNH:' || chr(10) || context || chr(10) || chr(10) || 'CÂU HỎI: ' || text || chr(10) || chr(10) || 'Hãy trả lời dựa CHỈ trên ngữ cảnh trên, tuân thủ các quy tắc ở hệ thống.') AS prompt_sha256, length(context) AS n_chars FROM c""",
}


def _embedded(table: str, key: str, prefix: str) -> str:
    return f"""WITH t AS (SELECT {key} AS id, '{prefix}: ' || coalesce(text, '') AS t FROM {table}),
c AS (SELECT id, [CAST(length(t) AS DOUBLE), length(t) - length(replace(t, ' ', '')), length(t) - length(replace(t, '.', ''))] AS v FROM t)
SELECT id, array_to_string(list_transform(v, lambda x: CAST(CAST(round(CAST(CAST(x / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)), ' ') AS unit FROM c"""


_PROMPTS = f"""
lt AS (SELECT conv_id, max(turn) AS last, max_by(text, turn) AS raw FROM conversations GROUP BY conv_id),
pt AS (SELECT conv_id, turn, role, {strip('text')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations JOIN lt USING (conv_id) WHERE turn < last),
hi AS (SELECT conv_id, string_agg('  ' || CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || ': ' || x, chr(10) ORDER BY turn) AS history FROM pt WHERE rn <= 6 AND coalesce(x, '') <> '' GROUP BY conv_id),
pr AS (SELECT conv_id AS query_id, raw, history IS NOT NULL AS has_history,
              'Lịch sử hội thoại:' || chr(10) || coalesce(history, '(chưa có)') || chr(10) || chr(10) || 'Câu hỏi mới nhất: ' || raw AS prompt
       FROM lt LEFT JOIN hi USING (conv_id))"""

ORACLES |= {
    "read_blocks": r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', ' ', 'g'), chr(10)) AS l, lang, coalesce(source, '-') AS source FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_key, CAST(i - 1 AS BIGINT) AS block_idx, 'p' AS kind, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)
UNION ALL
SELECT CAST(doc_id AS VARCHAR), CAST(len(l) AS BIGINT), 't', '| ' || lang || ' | ' || source || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | n | x y |' || chr(10) || '| ' || doc_id || ' | last |' FROM d""",
    "load_registry": f"WITH {CHUNKS} SELECT doc_key, so_hieu, ten_van_ban, loai_van_ban, co_quan_ban_hanh, ngay_ban_hanh, ngay_hieu_luc, con_hieu_luc FROM reg",
    "chunk_files": f"WITH {CHUNKS} SELECT row_number() OVER (ORDER BY doc_key, chunk_seq) - 1 AS line, {PAY_COLUMNS} FROM ch",
    "reset_index": ORACLES["points_per_source"],
    "embed_passages": _embedded("documents", "doc_id", "passage"),
    "embed_queries": _embedded("benchmark", "item_id", "query"),
    "embedding_models": """WITH d AS (SELECT doc_id, ['text-embedding-3-small', 'text-embedding-3-large', 'intfloat/multilingual-e5-small', 'intfloat/multilingual-e5-base', 'intfloat/multilingual-e5-large', 'BAAI/bge-m3'][1 + doc_id % 6] AS model FROM documents)
SELECT doc_id, model, CAST([1536, 3072, 384, 768, 1024, 1024][1 + doc_id % 6] AS BIGINT) AS dim, CASE WHEN doc_id % 6 < 2 THEN 'openai' ELSE 'local' END AS provider, CASE WHEN contains(model, 'e5') THEN 'query: ' ELSE '' END AS prefix FROM d""",
    "analyzer_prompts": f"WITH {_PROMPTS} SELECT query_id, sha256(prompt) AS prompt_sha256 FROM pr",
    "analyze": f"""WITH {_PROMPTS},
v AS (SELECT *, length(prompt) % 7 = 0 AS failed FROM pr),
q AS (SELECT *, CASE WHEN failed OR NOT has_history THEN raw ELSE right(prompt, 20) END AS query FROM v)
SELECT query_id, CASE WHEN failed OR length(prompt) % 2 = 1 THEN 'legal_rag' ELSE 'out_of_scope' END AS category, query,
       coalesce(nullif(CASE WHEN NOT failed AND length(prompt) % 3 = 0 THEN right(prompt, 10) ELSE raw END, ''), query) AS retrieval, CASE WHEN failed THEN 'timeout' END AS analyzer_error
FROM q""",
    "answer": f"""WITH p AS (SELECT item_id AS query_id, item_id % 4 AS n, 'NGỮ CẢNH:' || chr(10) || '» ' || text || chr(10) || chr(10) || 'CÂU HỎI: ' || text || chr(10) || chr(10) || 'Hãy trả lời dựa CHỈ trên ngữ cảnh trên, tuân thủ các quy tắc ở hệ thống.' AS prompt FROM benchmark)
SELECT query_id, CASE WHEN n = 0 OR length(prompt) % 5 = 0 THEN '' WHEN length(prompt) % 3 = 0 THEN '{REFUSAL}.' ELSE CAST(length(prompt) AS VARCHAR) END AS answer,
       n = 0 OR (length(prompt) % 5 <> 0 AND length(prompt) % 3 = 0) AS refused, CASE WHEN n > 0 AND length(prompt) % 5 = 0 THEN 'timeout' END AS error FROM p""",
}


# Retrieval over chunks: the corpus and the questions take the places of documents and passages in the shared parts.
QS = """
qs AS (
  SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'điểm a khoản 1 Điều 4, Khoản 3 Điều 11 và Điều 15 Nghị định ' || (item_id % n) || '/2024/NĐ-CP: ' || text
                                   WHEN item_id % 3 = 1 THEN text || ' các hành vi' ELSE 'Điều 4 ' || text END AS text
  FROM benchmark, (SELECT count(*) AS n FROM documents)),
crp AS MATERIALIZED (SELECT row_id AS doc_id, page_content AS text FROM pay)"""
_CBM = BM[BM.index("tk AS (") :].replace("FROM documents)", "FROM crp)").replace("CROSS JOIN documents", "CROSS JOIN crp").replace("documents.doc_id", "crp.doc_id")
_CDE = DE.replace("SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings", "SELECT row_id, CAST(embedding AS DOUBLE[]) AS v FROM pay JOIN embeddings ON vec_id = row_id % (SELECT count(*) FROM embeddings)")
RETRIEVE = f"""{CHUNKS},{QS},
q0 AS (SELECT query_id, text, regexp_extract_all(text, '{REF}') AS refs, {ex('upper(text)', FULL_NUMBER, 1)} || '/' || {ex('upper(text)', FULL_NUMBER, 2)} || '/' || {ex('upper(text)', FULL_NUMBER, 3)} AS so_hieu FROM qs),
q1 AS (SELECT query_id, so_hieu, unnest(list_zip(refs, range(0, len(refs)))) AS z FROM q0),
rr AS (
  SELECT query_id, z[2] AS ref_idx, so_hieu, CAST({ex('z[1]', REF, 3)} AS INTEGER) AS dieu_so, TRY_CAST(nullif({ex('z[1]', REF, 2)}, '') AS INTEGER) AS khoan_so, lower(nullif({ex('z[1]', REF, 1)}, '')) AS diem
  FROM q1),
e0 AS (
  SELECT query_id, row_id, min(ref_idx) AS ref_idx
  FROM rr r JOIN pay p ON p.so_hieu = r.so_hieu AND p.dieu_so = r.dieu_so AND (r.khoan_so IS NULL OR r.khoan_so = p.khoan_so) AND (r.diem IS NULL OR r.diem = p.diem) GROUP BY ALL),
ex AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ref_idx, row_id) AS pos, row_id, CAST(0 AS DOUBLE) AS score FROM e0),
bq AS (SELECT * FROM qs WHERE query_id NOT IN (SELECT query_id FROM ex)),
{_CBM},{_CDE},{FU[FU.index("fu AS (") :]},
el AS MATERIALIZED (
  SELECT query_id, pos, row_id, score, false AS is_sibling FROM ex
  UNION ALL SELECT f.query_id, pos, row_id, score, false FROM fp f JOIN bq USING (query_id) WHERE pos <= CASE WHEN {has('text', BROAD)} THEN 25 ELSE 15 END),
{ATT}"""
ORACLES |= {
    "upsert_batches": ORACLES["upsert"],
    "bm25_blocks": f"WITH {BM} SELECT query_id, row_id, round(score, 6) AS score, rank FROM bt",
    "stats_after_upsert": f"""WITH ql AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
new AS (SELECT text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ql)
        UNION ALL SELECT concat_ws(' ', text, source) FROM documents JOIN ql USING (doc_id) WHERE quality = 1 UNION ALL SELECT text FROM benchmark),
{STATS.replace('FROM documents)', 'FROM new)')} SELECT term, df, round(idf, 6) AS idf FROM ts""",
    "retrieve": f"""WITH {RETRIEVE} SELECT a.query_id, a.pos, a.row_id, round(CASE WHEN a.is_sibling THEN 0 ELSE coalesce(e.score, 0) END, 9) AS score, a.is_sibling, chunk_id, so_hieu, dieu_so, khoan_so, diem
FROM (SELECT * EXCLUDE (score) FROM att) a JOIN pay p ON p.row_id = a.row_id LEFT JOIN el e ON e.query_id = a.query_id AND e.row_id = a.row_id""",
    "model_rerank": f"""WITH {FU}, h AS (SELECT f.query_id, f.pos, f.row_id, q.text AS q, d.text AS d FROM fp f JOIN bq q USING (query_id) JOIN documents d ON d.doc_id = f.row_id WHERE f.pos <= 30),
s AS (SELECT query_id, pos, row_id, q, -CAST(abs(length(d) - 20 * length(q)) AS DOUBLE) AS score FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS np FROM s)
SELECT query_id, np AS pos, row_id, score, false AS is_sibling FROM p WHERE np <= CASE WHEN {has('q', BROAD)} THEN 25 ELSE 5 END""",
}

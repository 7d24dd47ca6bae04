"""Schemas and fixed parameters of the reference workload."""

from __future__ import annotations

BLOCKS = "doc_key string, block_idx int, kind string, text string"
TABLE_ROWS = "array<array<struct<cell_id:string,text:string>>>"

# The metadata fields of a chunk, in order.
METADATA = (
    "chunk_id string, so_hieu string, ten_van_ban string, loai_van_ban string, co_quan_ban_hanh string, ngay_ban_hanh string, "
    "ngay_hieu_luc string, ngay_het_hieu_luc string, con_hieu_luc boolean, chuong_so int, chuong_ten string, muc_so int, muc_ten string, "
    "dieu_so int, khoan_so int, diem string, source_file string, dieu_ten string, noi_dung_dieu string, noi_dung_khoan string, "
    "noi_dung_diem string, level int, is_sibling boolean"
)
METADATA_FIELDS = [f.split()[0] for f in METADATA.split(", ")]
CHUNK = f"metadata struct<{METADATA.replace(' ', ':').replace(',:', ',')}>, page_content string, noi_dung_tham_chieu array<string>"

# Parameters of retrieval and history.
RRF_K = 60
CANDIDATES = 30
TOP_K = 5
TOP_K_RAG = 15
TOP_K_BROAD = 25
RERANK_TOP_N = 30
SIBLING_NEIGHBORS = 2
HISTORY_TURNS = 6
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
EMBED_BATCH = 50

"""Golden values and edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(("raw", "n"), [("IV", 4), ("XII", 12), ("3", 3), ("1A", 0), ("IIII", 4), ("IC", 99), ("xii", 12), ("", 0), ("99999999999", None), ("Điều", 1)])
def test_roman(spark, raw, n):
    assert one(spark, raw, T.roman_to_int) == n


@pytest.mark.parametrize(
    ("line", "want"),
    [("Chương I", ("C", "I", "")), ("Mục 1", ("M", "1", "")), ("Điều 7. Tên", ("D", "7", "Tên")), ("1. Phạt tiền", ("K", "1", "Phạt tiền")), ("a) Vượt đèn đỏ", ("P", "a", "Vượt đèn đỏ")),
     ("điều 7", ("O", None, None)), ("CHƯƠNG II – Tên", ("C", "II", "Tên"))],
)
def test_headings(spark, line, want):
    assert tuple(one(spark, line, T.parse_heading)) == want


def test_appendix_heading(spark):
    assert one(spark, "Phụ lục II Mẫu", T.appendix_number) == 2
    assert one(spark, "Phụ lục số 02", T.appendix_number) == 2
    assert one(spark, "Phụ lục ban hành kèm theo", T.appendix_number) is None


def test_refs(spark):
    text = "Khoản 8 Điều 6 Nghị định 168/2024/NĐ-CP, điểm A khoản 1 điều 7, Khoản 8 Điều 6"
    assert one(spark, text, T.full_number) == "168/2024/NĐ-CP"
    assert [tuple(r) for r in one(spark, text, T.explicit_refs)] == [(6, 8, None), (7, 1, "a")]
    assert one(spark, "nghị định 168", T.short_decree) == "168"
    assert one(spark, "nghị định số 168", T.short_decree) is None


def test_citations(spark):
    text = "x [Điều 7, Khoản 10, Điểm a — Nghị định 168/2024/NĐ-CP] [Điều 1 - không số] [Điều 7, Khoản 10, Điểm a — lại 168/2024/NĐ-CP]"
    assert [(c["so_hieu"], c["dieu_so"], c["khoan_so"], c["diem"]) for c in one(spark, text, T.citations)] == [("168/2024/NĐ-CP", "7", "10", "a")]


def test_ids_and_content(spark):
    row = spark.sql("select '168/2024/NĐ-CP' s, 7 d, 3 k, 'a' p, cast(null as int) n, cast(null as string) z")
    c = F.col
    ids = row.select(T.chunk_id(c("s"), c("d"), c("n"), c("z")), T.chunk_id(c("s"), c("d"), c("k"), c("z")), T.chunk_id(c("s"), c("d"), c("k"), c("p"))).head()
    assert list(ids) == ["168_2024_NĐ_CP_d7", "168_2024_NĐ_CP_d7_k3", "168_2024_NĐ_CP_d7_k3_da"]
    text = row.select(T.page_content(c("d"), F.lit("Tên"), F.lit(""), c("n"), F.lit(""), c("z"), F.lit(""))).head()[0]
    assert text == "Điều 7: Tên\n\n"


def test_table_markdown(spark):
    rows = spark.createDataFrame([([[("a", " x\ny "), ("b", "z"), ("b", "z")], [("c", "z"), ("d", "z")]],), ([],)], "r array<array<struct<cell_id:string,text:string>>>")
    assert [r[0] for r in rows.select(T.table_to_markdown(F.col("r"))).collect()] == ["| x y | z |\n| --- | --- |\n| z | z |", ""]


def test_refused_broad_tokens(spark):
    assert one(spark, " " + T.REFUSAL + " ", T.is_refused) and not one(spark, "Có.", T.is_refused)
    assert one(spark, "KHI NÀO phải dừng", T.is_broad) and not one(spark, "dừng xe", T.is_broad)
    assert one(spark, "Xe là của Tôi, a b; xe!", T.tokenize) == ["xe", "tôi", "xe"]
    assert one(spark, None, T.tokenize) == []


def test_models(spark):
    assert one(spark, "BAAI/bge-m3", T.embedding_dim) == 1024
    with pytest.raises(Exception, match="unknown embedding model"):
        one(spark, "other", T.embedding_dim)

"""Statute files, the registry, model jobs and their failures, on hand-made input."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.jobs.fixtures import docx
from lexforge.operators import dense as D
from lexforge.operators import retrieve as R
from lexforge.sources import documents as S


def test_read_blocks(spark, tmp_path):
    rows = [[("Mức", 2), ("Phạt", 1)], [("1", 1), ("a\nb", 1), ("c & <d>", 1)]]
    (tmp_path / "one.docx").write_bytes(docx(["Điều 1. Tên", "", "  hai"], rows))
    (tmp_path / "two.docx").write_bytes(docx([], []))
    (tmp_path / "notes.txt").write_text("no")
    got = [(r["doc_key"], r["block_idx"], r["kind"], r["text"]) for r in S.read_blocks(spark, str(tmp_path)).orderBy("doc_key", "block_idx").collect()]
    table = "| Mức | Phạt |\n| --- | --- |\n| 1 | a b | c & <d> |"
    assert got == [("one", 0, "p", "Điều 1. Tên"), ("one", 1, "p", ""), ("one", 2, "p", "  hai"), ("one", 3, "t", table), ("two", 0, "t", "")]


def test_models(spark):
    m = spark.createDataFrame([("text-embedding-3-small",), ("intfloat/multilingual-e5-base",)], "m string")
    got = m.select(T.embedding_dim(F.col("m")), T.embedding_provider(F.col("m")), T.model_prefix(F.col("m"), "passage")).collect()
    assert [tuple(r) for r in got] == [(1536, "openai", ""), (768, "local", "passage: ")]
    for f in (T.embedding_dim, T.embedding_provider):
        with pytest.raises(Exception, match="unknown embedding model"):
            m.select(f(F.lit("other"))).collect()


def test_map_model_errors(spark):
    def make():
        def model(pdf):
            if (pdf["n"] == 3).any():
                raise ValueError("three")
            return [2 * n for n in pdf["n"]]

        return model

    got = D.map_model(spark.range(6).withColumnRenamed("id", "n").coalesce(1), make, "twice", "long").orderBy("n").collect()
    assert [(r["twice"], r["error"]) for r in got] == [(0, None), (2, None), (4, None), (None, "three"), (8, None), (10, None)]


def test_model_rerank(spark):
    """A model's scores replace the hits' and order them; ties keep the old order."""
    hits = spark.createDataFrame([(1, 1, 10, 0.3, False), (1, 2, 11, 0.2, False), (1, 3, 12, 0.1, False)], "query_id long, pos int, row_id long, score double, is_sibling boolean")
    queries = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    texts = spark.createDataFrame([(10, "x"), (11, "a b"), (12, "a b")], "row_id long, page_content string")
    pairs = hits.join(texts, "row_id").join(queries, "query_id")
    scored = D.map_model(pairs, lambda: lambda pdf: [float(len(set(q.split()) & set(c.split()))) for q, c in zip(pdf["text"], pdf["page_content"], strict=True)], "new_score", "double")
    got = R.rerank(hits, scored.select("query_id", "row_id", "new_score"), queries, top_k=2).orderBy("pos").collect()
    assert [(r["row_id"], r["score"]) for r in got] == [(11, 2.0), (12, 2.0)]


def test_runs_and_merged_cells():
    """Only runs and hyperlinks count, whose tabs are text and whose page breaks are not; a cell merged over rows is in each of them."""
    import io
    import zipfile

    w = S.WORD[1:-1]
    p = (
        '<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>Điều</w:t><w:tab/><w:t>1</w:t><w:br/><w:t>a</w:t><w:br w:type="page"/><w:noBreakHyphen/></w:r>'
        "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:r><w:drawing><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:drawing></w:r></w:p>"
    )
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    top = cell("tall", '<w:gridSpan w:val="2"/><w:vMerge w:val="restart"/>') + cell("x")
    low = cell("", '<w:gridSpan w:val="2"/><w:vMerge/>') + cell("y")
    body = f"{p}<w:tbl><w:tr>{top}</w:tr><w:tr>{low}</w:tr><w:tr>{low}</w:tr><w:tr>{cell('1')}{cell('2')}{cell('3')}</w:tr></w:tbl><w:tbl><w:tr>{cell('lost', '<w:vMerge/>')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    para, table, alone = S.file_blocks(out.getvalue())
    assert para["text"] == "Điều\t1\na-link"
    assert [[(c["cell_id"], c["text"]) for c in r] for r in table["rows"]] == [
        [("0.0", "tall"), ("0.0", "tall"), ("0.1", "x")], [("0.0", "tall"), ("0.0", "tall"), ("1.1", "y")], [("0.0", "tall"), ("0.0", "tall"), ("2.1", "y")], [("3.0", "1"), ("3.1", "2"), ("3.2", "3")],
    ]
    assert alone["rows"] == [[{"cell_id": "0.0", "text": "lost"}]]

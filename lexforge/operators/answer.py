"""History, context, prompts, citations and responses as columns and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import HISTORY_TURNS
from ..sources.stage import stored
from .dense import map_model

# Texts of prompts and answers.
NO_HISTORY = "(chưa có)"
BETWEEN = "\n\n---\n\n"
NO_CONTEXT = "(Không có ngữ cảnh nào được truy xuất.)"
CHANGES = {"sua_doi": "đã được sửa đổi", "bai_bo": "đã bị bãi bỏ", "thay_the": "đã bị thay thế toàn bộ"}
OUT_OF_SCOPE = (
    "\n    Xin lỗi, tôi chỉ tư vấn về Luật Giao thông Việt Nam và không giải quyết các \n"
    "    vấn đề ngoài phạm vi này. Bạn có thể hỏi tôi về mức phạt vi phạm, quy định \n"
    "    đăng ký xe, đăng kiểm, cấp giấy phép lái xe, v.v.\n"
)

# A bound that holds at every size: row ids in a slice of points.
SLICE_ROWS = 64


def _some(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def format_turn(role: Column, text: Column, sources: Column | None = None) -> Column:
    """One turn's lines; null where the text is blank. sources: array of (dieu_so, khoan_so, ten_van_ban, so_hieu)."""
    line = F.concat(F.lit("  "), F.when(role == "user", "user").otherwise("assistant"), F.lit(": "), T.strip(text))
    if sources is not None:
        label = lambda s: F.concat_ws(
            " · ", F.when(_some(s["dieu_so"]), F.concat(F.lit("Điều "), s["dieu_so"])), F.when(_some(s["khoan_so"]), F.concat(F.lit("Khoản "), s["khoan_so"])),
            F.when(_some(s["ten_van_ban"]), s["ten_van_ban"]),
        )
        named = lambda s: F.coalesce(F.nullif(label(s), F.lit("")), s["so_hieu"], F.lit("Nguồn"))
        listed = F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), named(s))), ", ")
        line = F.concat(line, F.when((role == "assistant") & (F.size(sources) > 0), F.concat(F.lit("\n    (Nguồn đã trích dẫn: "), listed, F.lit(")"))).otherwise(""))
    return F.when(T.strip(F.coalesce(text, F.lit(""))) != "", line)


def format_history(turns: DataFrame, last: int = HISTORY_TURNS) -> DataFrame:
    """(conv_id, history): the last turns of each conversation; blank ones use up a place and are left out.

    turns: (conv_id, turn, role, text[, sources]). Only the last turns of a conversation
    are aggregated, however long it is.
    """
    recent = turns.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("rn") <= last)
    line = format_turn(F.col("role"), F.col("text"), F.col("sources") if "sources" in turns.columns else None)
    g = recent.withColumn("line", line).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("turn", "line")))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return g.select("conv_id", F.when(F.size("lines") > 0, joined).otherwise(NO_HISTORY).alias("history"))


def analyzer_prompt(history: Column, raw: Column) -> Column:
    return F.concat(F.lit("Lịch sử hội thoại:\n"), history, F.lit("\n\nCâu hỏi mới nhất: "), raw)


def answer_prompt(context: Column, query: Column) -> Column:
    return F.concat(
        F.lit("NGỮ CẢNH:\n"), context, F.lit("\n\nCÂU HỎI: "), query,
        F.lit("\n\nHãy trả lời dựa CHỈ trên ngữ cảnh trên, tuân thủ các quy tắc ở hệ thống."),
    )


def format_chunk(pos: Column, is_sibling: Column, so_hieu: Column, ten: Column, dieu: Column, khoan: Column, diem: Column, content: Column, refs: Column) -> Column:
    """A numbered source block; the appendix texts in their list form on a last line."""
    place = F.concat_ws(
        " · ", F.when(F.coalesce(dieu, F.lit(0)) != 0, F.concat(F.lit("Điều "), dieu.cast("string"))),
        F.when(khoan.isNotNull(), F.concat(F.lit("Khoản "), khoan.cast("string"))), F.when(_some(diem), F.concat(F.lit("Điểm "), diem)),
    )
    tag = F.when(is_sibling, "Ngữ cảnh bổ sung — cùng Điều").otherwise(F.concat(F.lit("Nguồn "), pos.cast("string")))
    head = F.concat(F.lit("["), tag, F.lit("] "), F.coalesce(ten, F.lit("")), F.lit(" ("), F.coalesce(so_hieu, F.lit("?")), F.lit(")"), F.when(place != "", F.concat(F.lit(" · "), place)).otherwise(""))
    # The list form quotes with ', or with " where a text holds ' and no ".
    quoted = lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(refs, lambda x: quoted(escaped(x))), ", "), F.lit("]"))
    return F.concat(head, F.lit("\n"), F.coalesce(content, F.lit("")), F.when(F.size(F.coalesce(refs, F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n"), listed)).otherwise(""))


def build_context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context): blocks of a query's hits in order; the placeholder where it has none."""
    block = format_chunk(*[F.col(c) for c in ("pos", "is_sibling", "so_hieu", "ten_van_ban", "dieu_so", "khoan_so", "diem", "page_content", "noi_dung_tham_chieu")])
    g = hits.withColumn("b", F.struct("pos", block.alias("t"))).groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    joined = F.array_join(F.transform("bs", lambda x: x["t"]), BETWEEN)
    return queries.select("query_id").join(g, "query_id", "left").select("query_id", F.coalesce(joined, F.lit(NO_CONTEXT)).alias("context"))


def contexts(queries: DataFrame, hits: DataFrame, points: DataFrame, refs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """queries with ``context``, as ``build_context`` gives it for hits (query_id, pos, row_id, is_sibling) over points whose appendix texts are in refs (row_id, refs). A question is one row of queries.

    Points are gathered in slices of ``slice_rows`` row ids, each once. A question with
    all its hits in one slice, as those of one article nearly always are, is answered
    there: its list of hits goes to the texts, and no text goes to it. Only the texts of
    the other questions are dealt out by question.
    """
    fields = ("so_hieu", "ten_van_ban", "dieu_so", "khoan_so", "diem", "page_content")
    cut = lambda c: F.floor(c / slice_rows)
    h = F.array_sort(F.collect_list(F.struct("pos", "row_id", "is_sibling")))
    lists = hits.groupBy("query_id").agg(h.alias("hs"), cut(F.min("row_id")).alias("low"), cut(F.max("row_id")).alias("high"))
    asked = stored(queries.join(lists, "query_id", "left"), "hit-lists")
    rows = points.select(cut(F.col("row_id")).alias("slice"), F.struct("row_id", *fields).alias("p"))
    rows = rows.unionByName(refs.select(cut(F.col("row_id")).alias("slice"), F.struct("row_id", "refs").alias("r")), allowMissingColumns=True)
    slices = rows.groupBy("slice").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.collect_list("r").alias("rs"))

    def block(x: Column) -> Column:
        # Row ids mostly follow each other; where they do not, the row is looked for.
        there = F.get("ps", (x["row_id"] - F.col("ps")[0]["row_id"]).cast("int"))
        p = F.when(there["row_id"] == x["row_id"], there).otherwise(F.get(F.filter("ps", lambda p: p["row_id"] == x["row_id"]), F.lit(0)))
        r = F.get(F.filter("rs", lambda r: r["row_id"] == x["row_id"]), F.lit(0))["refs"]
        return F.when(p.isNotNull(), format_chunk(x["pos"], x["is_sibling"], *[p[c] for c in fields[:5]], p["page_content"], r))

    whole = lambda blocks: F.coalesce(F.nullif(F.array_join(blocks, BETWEEN), F.lit("")), F.lit(NO_CONTEXT))
    none = asked.filter("hs is null").select(*queries.columns, F.lit(NO_CONTEXT).alias("context"))
    near = asked.filter("low = high").withColumnRenamed("low", "slice").join(slices, "slice", "left").select(*queries.columns, whole(F.transform("hs", block)).alias("context"))
    far = asked.filter("low < high").select(*queries.columns, F.explode("hs").alias("x")).withColumn("slice", cut(F.col("x.row_id")))
    parts = far.join(slices, "slice", "left").select(*queries.columns, F.struct("x.pos", block(F.col("x")).alias("t")).alias("b"))
    far = parts.groupBy(*queries.columns).agg(F.array_sort(F.collect_list("b")).alias("bs")).select(*queries.columns, whole(F.transform("bs", lambda b: b["t"])).alias("context"))
    return none.unionByName(near).unionByName(far)


def apply_analyzer_defaults(q: DataFrame) -> DataFrame:
    """q: (…, raw, has_history, category, standalone_query, retrieval_query), the last three null where the analysis failed.

    Adds the category, the query and the retrieval query that go on.
    """
    failed = F.col("category").isNull()
    query = F.when(failed | ~F.col("has_history"), F.col("raw")).otherwise(F.coalesce("standalone_query", "raw"))
    retrieval = F.when(failed, F.col("raw")).otherwise(F.coalesce("retrieval_query", "raw"))
    out = q.withColumns({"query": query, "retrieval": F.coalesce(F.nullif(retrieval, F.lit("")), query)})
    return out.withColumn("category", F.coalesce("category", F.lit("legal_rag")))


def route_by_category(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries that go on to retrieval, finished answers of all others)."""
    rag = q.filter(F.col("category") == "legal_rag")
    other = q.filter(F.col("category") != "legal_rag").withColumns({"answer": F.lit(OUT_OF_SCOPE), "refused": F.lit(False)})
    return rag, other


def empty_result_status(n_hits: Column, answer: Column, error: Column) -> Column:
    """struct(answer, refused, error): an error first, then no hits, then the answer."""
    failed, none = error.isNotNull(), F.coalesce(n_hits, F.lit(0)) == 0
    return F.struct(
        F.when(failed | none, "").otherwise(F.coalesce(answer, F.lit(""))).alias("answer"),
        F.when(failed, False).when(none, True).otherwise(F.coalesce(T.is_refused(answer), F.lit(False))).alias("refused"),
        error.alias("error"),
    )


def shape_response(r: DataFrame) -> DataFrame:
    """Final columns with their defaults."""
    empty = F.array().cast("array<struct<so_hieu:string,ten_van_ban:string,dieu_so:string,khoan_so:string,diem:string>>")
    return r.select(
        "query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("sources", empty).alias("sources"), F.coalesce("refused", F.lit(False)).alias("refused"),
        F.coalesce("category", F.lit("out_of_scope")).alias("category"), F.coalesce("model_info", F.lit("")).alias("model_info"), F.coalesce("query", "raw").alias("query"),
    )


def annotate_validity(con_hieu_luc: Column, ngay_het: Column, loai_thay_doi: Column, bi_sua_doi_boi: Column) -> Column:
    """struct(expired, changed): warnings on a cited source, null where there is none."""
    gone = F.concat(F.lit("⚠️ Điều này đã hết hiệu lực"), F.when(_some(ngay_het), F.concat(F.lit(" từ "), ngay_het)).otherwise(""))
    label = F.concat(F.lit("có thay đổi ("), loai_thay_doi, F.lit(")"))
    for k, v in CHANGES.items():
        label = F.when(loai_thay_doi == k, v).otherwise(label)
    changed = F.concat(F.lit("⚠️ Điều này "), label, F.when(_some(bi_sua_doi_boi), F.concat(F.lit(" bởi `"), bi_sua_doi_boi, F.lit("`"))).otherwise(""))
    return F.struct(F.when(~F.coalesce(con_hieu_luc, F.lit(True)), gone).alias("expired"), F.when(_some(loai_thay_doi), changed).alias("changed"))


ANALYSIS = "struct<category:string,standalone_query:string,retrieval_query:string>"


def analyze(questions: DataFrame, make) -> DataFrame:
    """(query_id, raw, history) with the analyzer's verdict: category, query and retrieval, by defaults where the model fails.

    make() gives a model from prompts (a column ``prompt``) to dicts of the three fields.
    """
    asked = questions.withColumn("prompt", analyzer_prompt(F.col("history"), F.col("raw")))
    said = map_model(asked, make, "verdict", ANALYSIS, "analyzer_error")
    fields = {c: F.col(f"verdict.{c}") for c in ("category", "standalone_query", "retrieval_query")}
    known = said.withColumns({**fields, "has_history": F.col("history") != NO_HISTORY})
    return apply_analyzer_defaults(known.drop("verdict", "prompt"))


def answer(contexts: DataFrame, make) -> DataFrame:
    """(query_id, query, context, n_hits) with answer, refused and error.

    make() gives a model from prompts to answers. Questions without hits are refused without asking it.
    """
    asked = contexts.filter("n_hits > 0").withColumn("prompt", answer_prompt(F.col("context"), F.col("query")))
    said = map_model(asked, make, "said", "string").select("query_id", "said", "error")
    s = empty_result_status(F.col("n_hits"), F.col("said"), F.col("error"))
    return contexts.join(said, "query_id", "left").withColumn("s", s).drop("said", "error").select("*", "s.*").drop("s")

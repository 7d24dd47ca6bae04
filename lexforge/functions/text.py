"""Column functions on legal text: numbers, headings, references, tokens, formatting.

Every function takes and returns Spark columns built from SQL functions, so plans
stay in generated code. Patterns use ``(?iu)`` where case is ignored, as plain
``(?i)`` does not fold Vietnamese letters, and ``(?d)`` where ``.`` stops only at \\n.
Unmatched optional groups are null. Null in, null out, unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heading shapes of statutes.
CHAPTER = r"(?iud)^Chương\s+([IVXLCDM]+|\d+)[.\s]*[-–—]?\s*(.*)"
SECTION = r"(?iud)^Mục\s+(\d+)[.\s]*[-–—]?\s*(.*)"
ARTICLE = r"(?d)^Điều\s+(\d+)\.?\s*(.*)"
CLAUSE = r"(?d)^(\d+)\.\s+(.*)"
POINT = r"(?d)^([a-zđ])\)\s+(.*)"
APPENDIX = r"(?iud)^Phụ\s+lục(?:\s+số)?(?:\s+([IVXLCDM]+|\d+[\p{L}\p{N}_]*))?\s*(.*)"
APPENDIX_MENTION = r"(?iu)Phụ\s+lục(?:\s+số)?\s+([IVXLCDM]+|\d+)"
APPENDIX_ATTACHED = r"(?iu)Phụ\s+lục\s+(?:ban\s+hành\s+)?kèm\s+theo"
# Explicit references and citations.
FULL_NUMBER = r"(?iu)(?<![\p{L}\p{N}_])(\d+)\s*/\s*(\d{4})\s*/\s*([A-ZĐ\-\d]+)(?![\p{L}\p{N}_])"
SHORT_DECREE = r"(?iu)(?:nghị\s*định|nđ|nd)\s*(\d+)"
EXPLICIT_REF = r"(?iu)(?:điểm\s+([a-zđ])\s+)?(?:khoản\s+(\d+)\s+)?điều\s+(\d+)"
CITATION = r"\[Điều\s+([\p{L}\p{N}_]+)(?:,\s*Khoản\s+([\p{L}\p{N}_]+))?(?:,\s*Điểm\s+([\p{L}\p{N}_]+))?\s*[—\-]+\s*([^\]]+)\]"
CITED_NUMBER = r"\d+/\d{4}/[A-ZĐ0-9\-]+"
# Phrases of list questions.
BROAD = (
    "(?iu)khi nào|liệt kê|có mấy|trường hợp nào|các trường hợp|những trường hợp|lỗi nào|các lỗi|những lỗi|"
    "hành vi nào|các hành vi|những hành vi|hạng nào|các hạng|những hạng|loại nào|các loại|những loại|"
    "danh sách|điều kiện|bao gồm|gồm những"
)
# Phrases that mark a clause as completing the others of its article.
COMPLETION = (
    "còn bị trừ điểm giấy phép", "bị trừ điểm giấy phép lái xe", "hình thức xử phạt bổ sung",
    "tước quyền sử dụng giấy phép", "tịch thu phương tiện", "gây tai nạn giao thông",
)
# Words left out of the token list.
STOPWORDS = (
    "là", "và", "của", "cho", "các", "có", "được", "trong", "theo", "với", "một", "khi",
    "hoặc", "từ", "này", "đó", "tại", "do", "để", "sẽ", "đã", "nếu", "bị", "bởi",
)
# Fixed value: the refusal sentence.
REFUSAL = "Thông tin này không có trong tài liệu được cung cấp."


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def group(c: Column, pattern: str, n: int) -> Column:
    """Group n of the first match, null if there is none or the group took no part."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def roman_to_int(c: Column) -> Column:
    """Digits as they are (null beyond 32 bits); else the additive and subtractive sum of Roman digits in either case, other characters counting 0."""
    digits = F.split(F.upper(c), "")
    value = lambda x: (
        F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100).when(x == "D", 500).when(x == "M", 1000).otherwise(0)
    )
    values = F.transform(digits, value)
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).otherwise(F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def heading_kind(line: Column) -> Column:
    """C, M, D, K or P by the first heading shape that fits, else O."""
    return (
        F.when(line.rlike(ARTICLE), "D").when(line.rlike(CHAPTER), "C").when(line.rlike(SECTION), "M")
        .when(line.rlike(CLAUSE), "K").when(line.rlike(POINT), "P").otherwise("O")
    )


def parse_heading(line: Column, kind: Column | None = None) -> Column:
    """struct(kind, number, rest) of a line; number is null for O, rest is stripped. A kind that is known already is not looked for again."""
    kind = heading_kind(line) if kind is None else kind
    shapes = {"C": CHAPTER, "M": SECTION, "D": ARTICLE, "K": CLAUSE, "P": POINT}
    number = rest = F.lit(None).cast("string")
    for k, p in shapes.items():
        number = F.when(kind == k, F.regexp_extract(line, p, 1)).otherwise(number)
        rest = F.when(kind == k, strip(F.regexp_extract(line, p, 2))).otherwise(rest)
    return F.struct(kind.alias("kind"), number.alias("number"), rest.alias("rest"))


def is_appendix_heading(line: Column) -> Column:
    return line.rlike(APPENDIX)


def appendix_number(line: Column) -> Column:
    return roman_to_int(group(line, APPENDIX, 1))


def appendix_title(line: Column) -> Column:
    return strip(F.regexp_extract(line, APPENDIX, 2))


def table_to_markdown(rows: Column) -> Column:
    """array<array<struct<cell_id,text>>> as a Markdown table; a cell merged over columns (same cell_id) once; no rows: empty."""
    first_of = lambda row: F.filter(row, lambda c, i: F.array_position(F.transform(row, lambda d: d["cell_id"]), c["cell_id"]) == i + 1)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    texts = F.transform(rows, lambda row: F.transform(first_of(row), lambda c: F.replace(strip(c["text"]), F.lit("\n"), F.lit(" "))))
    rule = line(F.transform(F.get(texts, 0), lambda _: F.lit("---")))
    lines = F.transform(texts, line)
    whole = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))))
    return F.when(F.size(rows) > 0, F.array_join(whole, "\n")).otherwise("")


def number_slug(c: Column) -> Column:
    return F.translate(c, "/-", "__")


def chunk_id(so_hieu: Column, dieu: Column, khoan: Column, diem: Column) -> Column:
    return F.concat(
        number_slug(so_hieu), F.lit("_d"), dieu.cast("string"),
        F.when(khoan.isNotNull(), F.concat(F.lit("_k"), khoan.cast("string"))).otherwise(""),
        F.when(F.coalesce(diem, F.lit("")) != "", F.concat(F.lit("_d"), diem)).otherwise(""),
    )


def page_content(dieu: Column, dieu_ten: Column, dieu_text: Column, khoan: Column, khoan_text: Column, diem: Column, diem_text: Column) -> Column:
    """Three pieces always joined by newlines, empty where there is no clause or point."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("Điều "), dieu.cast("string"), F.lit(": "), blank(dieu_ten), F.when(blank(dieu_text) != "", F.concat(F.lit("\n"), dieu_text)).otherwise(""))
    clause = F.when(khoan.isNotNull(), F.concat(khoan.cast("string"), F.lit(". "), blank(khoan_text))).otherwise("")
    point = F.when(diem.isNotNull(), F.concat(diem, F.lit(". "), blank(diem_text))).otherwise("")
    return F.concat_ws("\n", head, clause, point)


def level(khoan_text: Column, diem_text: Column) -> Column:
    """By text, not by structure: 3 with point text, 2 with clause text, else 1."""
    return F.when(F.coalesce(diem_text, F.lit("")) != "", 3).when(F.coalesce(khoan_text, F.lit("")) != "", 2).otherwise(1)


def tokenize(c: Column) -> Column:
    """Lower-case words without punctuation, stop words and single characters; repeats kept, null as no words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def is_broad(c: Column) -> Column:
    return c.rlike(BROAD)


def is_completion(c: Column) -> Column:
    low, out = F.lower(c), F.lit(False)
    for p in COMPLETION:
        out = out | low.contains(p)
    return out


def full_number(c: Column) -> Column:
    """The first number/year/type of the text in upper case, null if none."""
    up = F.upper(c)
    return F.when(up.rlike(FULL_NUMBER), F.concat_ws("/", *[F.regexp_extract(up, FULL_NUMBER, i) for i in (1, 2, 3)]))


def short_decree(c: Column) -> Column:
    """N of the first "decree N", null if none."""
    return group(c, SHORT_DECREE, 1)


def explicit_refs(c: Column) -> Column:
    """array<struct<dieu_so,khoan_so,diem>>: all article references in order, each once."""
    ref = lambda m: F.struct(
        F.regexp_extract(m, EXPLICIT_REF, 3).cast("int").alias("dieu_so"), group(m, EXPLICIT_REF, 2).cast("int").alias("khoan_so"),
        F.lower(group(m, EXPLICIT_REF, 1)).alias("diem"),
    )
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(EXPLICIT_REF), F.lit(0)), ref))


def citations(c: Column) -> Column:
    """array<struct<so_hieu,ten_van_ban,dieu_so,khoan_so,diem>> of bracketed citations with a document number, the first of equal places only."""
    cite = lambda m: F.struct(
        group(strip(F.regexp_extract(m, CITATION, 4)), CITED_NUMBER, 0).alias("so_hieu"), strip(F.regexp_extract(m, CITATION, 4)).alias("ten_van_ban"),
        F.regexp_extract(m, CITATION, 1).alias("dieu_so"), group(m, CITATION, 2).alias("khoan_so"), group(m, CITATION, 3).alias("diem"),
    )
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(0)), cite), lambda x: x["so_hieu"].isNotNull())
    key = lambda x: F.to_json(F.struct(x["so_hieu"], x["dieu_so"], x["khoan_so"], x["diem"]))
    keep = lambda acc, x: F.when(F.exists(acc, lambda y: key(y) == key(x)), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(found, F.array().cast("array<struct<so_hieu:string,ten_van_ban:string,dieu_so:string,khoan_so:string,diem:string>>"), keep)


def is_refused(answer: Column) -> Column:
    return F.regexp_replace(strip(answer), r"\.+$", "") == F.lit(REFUSAL.rstrip("."))


def model_prefix(model: Column, kind: str) -> Column:
    """ "passage: " or "query: " for e5 models, else nothing."""
    return F.when(F.lower(model).contains("e5"), kind + ": ").otherwise("")


# Dimension and provider of the known embedding models.
MODELS = {
    "text-embedding-3-small": (1536, "openai"), "text-embedding-3-large": (3072, "openai"),
    "intfloat/multilingual-e5-small": (384, "local"), "intfloat/multilingual-e5-base": (768, "local"),
    "intfloat/multilingual-e5-large": (1024, "local"), "BAAI/bge-m3": (1024, "local"),
}


def embedding_dim(model: Column) -> Column:
    """Dimension of a known model; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown embedding model: "), model)).cast("int")
    for name, (dim, _) in MODELS.items():
        out = F.when(model == name, dim).otherwise(out)
    return out


def embedding_provider(model: Column) -> Column:
    """Provider of a known model; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown embedding model: "), model)).cast("string")
    for name, (_, provider) in MODELS.items():
        out = F.when(model == name, provider).otherwise(out)
    return out


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))

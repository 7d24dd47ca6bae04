"""Chunks: the leaves of the hierarchy with their metadata, ids and appendix texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import METADATA_FIELDS
from ..sources.stage import stored
from .numbering import numbered
from . import structure as S
from .structure import ARTICLE, HOME


CLAUSE = [*ARTICLE, "khoan_ord"]


def leaves_of(nodes: DataFrame) -> DataFrame:
    """The nodes that are a point, a clause without points or an article without clauses."""
    is_art, is_cl = (F.col("khoan_ord") == 0), (F.col("khoan_ord") > 0) & (F.col("diem_ord") == 0)
    largest = lambda c, of: F.max(c).over(W.partitionBy(*of))
    n = nodes.withColumns({"has_khoan": largest("khoan_ord", ARTICLE) > 0, "has_diem": largest("diem_ord", CLAUSE) > 0})
    leaf = (F.col("diem_ord") > 0) | (is_cl & ~F.col("has_diem")) | (is_art & ~F.col("has_khoan"))
    return n.filter(leaf).drop("has_khoan", "has_diem")


def in_sequence(leaves: DataFrame) -> DataFrame:
    """Leaves with ``chunk_seq``, their place in the document: numbered within their article, after the counts of the articles before it, one row for each, without texts."""
    past = W.partitionBy("doc_key").orderBy("dgrp").rowsBetween(W.unboundedPreceding, -1)
    counts = leaves.groupBy(*ARTICLE).agg(F.count(F.lit(1)).alias("n"))
    begins = counts.select(*ARTICLE, F.coalesce(F.sum("n").over(past), F.lit(0)).alias("begin"))
    nth = F.row_number().over(W.partitionBy(*ARTICLE).orderBy("khoan_ord", "diem_ord")) - 1
    return leaves.withColumn("nth", nth).join(begins.hint("merge"), ARTICLE).withColumn("chunk_seq", (F.col("begin") + F.col("nth")).cast("int")).drop("begin", "nth")


def chunk_leaves(nodes: DataFrame) -> DataFrame:
    """One row per point, per clause without points, per article without clauses, with the texts above it and ``chunk_seq``."""
    return in_sequence(text_leaves(nodes))


def text_leaves(nodes: DataFrame) -> DataFrame:
    """The leaves with the texts above them; each has its article's ``info``, if the nodes have it."""
    is_art, is_cl = (F.col("khoan_ord") == 0), (F.col("khoan_ord") > 0) & (F.col("diem_ord") == 0)
    art, cl = W.partitionBy(*ARTICLE), W.partitionBy(*CLAUSE)
    of = lambda c, cond, w: F.max(F.when(cond, F.col(c))).over(w)
    n = nodes.withColumns({
        "dieu_so": of("number", is_art, art).cast("int"), "dieu_ten": of("head", is_art, art), "noi_dung_dieu": of("text", is_art, art),
        "khoan_so": F.when(F.col("khoan_ord") > 0, of("number", is_cl, cl)).cast("int"), "noi_dung_khoan": F.when(F.col("khoan_ord") > 0, of("text", is_cl, cl)),
        "diem": F.when(F.col("diem_ord") > 0, F.col("number")), "noi_dung_diem": F.when(F.col("diem_ord") > 0, F.col("text")),
        **{c: of(c, is_art, art) for c in ("info",) if c in nodes.columns},
    })
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("noi_dung_dieu", "noi_dung_khoan", "noi_dung_diem", "dieu_ten")}
    return leaves_of(n).withColumns(blank).drop("number", "head", "text")


def dealt_chunks(marked: DataFrame, registry: DataFrame, ids: bool = False, by: list[str] = HOME, blocks: DataFrame | None = None, places: DataFrame | None = None, named: bool = True) -> DataFrame:
    """``build_chunks`` (with ``ids``, ``build_numbered_chunks``) of marked lines, their texts dealt out once, by ``by``.

    What an article's chunks need besides its texts is made without them and comes with
    its heading: the place of its first chunk, its chapter and section, its document's
    registry rows. blocks: as in ``dealt_lines``; places: ``marked_places``, if they are
    known already; named: false for null chapters and sections, where nothing asks for them.
    """
    places = S.marked_places(marked) if places is None else places
    keys = stored(in_sequence(leaves_of(S.node_places(places))), "leaf-keys")
    rows = numbered_registry(keys, registry) if ids else registry
    fields = [c for c in rows.columns if c != "doc_key"]
    begins = keys.groupBy(*ARTICLE).agg(F.min("chunk_seq").alias("begin"))
    of = rows.groupBy("doc_key").agg(F.collect_list(F.struct(*fields)).alias("registered"))
    lines = S.dealt_lines(marked, places, [begins, S.article_names(marked, places, by, blocks)] if named else [begins], of, by, blocks)
    leaves = text_leaves(S.node_texts(lines.filter("active")))
    nth = F.row_number().over(W.partitionBy(*ARTICLE).orderBy("khoan_ord", "diem_ord")) - 1
    one = leaves.withColumn("nth", nth).select("*", F.explode("info.registered").alias("own")).select("*", "info.*", "own.*").withColumn("chunk_seq", (F.col("begin") + F.col("nth")).cast("int"))
    return _chunk_rows(one if named else one.withColumns({c: F.lit(None).cast(t) for c, t in {"chuong_so": "int", "chuong_ten": "string", "muc_so": "int", "muc_ten": "string"}.items()}))


def attach_registry(blocks_or_leaves: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of registered documents with the registry's fields. The registry is one row per document file; Spark chooses the join."""
    return blocks_or_leaves.join(registry, "doc_key", "inner")


def unregistered_documents(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    return blocks.select("doc_key").distinct().join(registry.select("doc_key"), "doc_key", "left_anti")


def build_chunks(leaves: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_key, chunk_seq, metadata, page_content, noi_dung_tham_chieu) for leaves of registered documents."""
    # The registry's fields come to the articles, so that the texts stay where they are.
    return _chunk_rows(leaves.join(attach_registry(leaves.select(*ARTICLE).distinct(), registry).hint("merge"), ARTICLE))


def _chunk_rows(j: DataFrame) -> DataFrame:
    """Chunks of leaves with the registry's fields."""
    field = {
        "chunk_id": T.chunk_id(F.col("so_hieu"), F.col("dieu_so"), F.col("khoan_so"), F.col("diem")),
        "con_hieu_luc": F.coalesce(F.col("con_hieu_luc"), F.lit(True)),
        "ngay_het_hieu_luc": F.lit(None).cast("string"),
        "level": T.level(F.col("noi_dung_khoan"), F.col("noi_dung_diem")),
        "is_sibling": F.lit(False),
    }
    for c in ("ten_van_ban", "loai_van_ban", "co_quan_ban_hanh", "ngay_ban_hanh", "ngay_hieu_luc"):
        field[c] = F.coalesce(F.col(c), F.lit(""))
    meta = F.struct(*[field.get(c, F.col(c)).alias(c) for c in METADATA_FIELDS])
    content = T.page_content(*[F.col(c) for c in ("dieu_so", "dieu_ten", "noi_dung_dieu", "khoan_so", "noi_dung_khoan", "diem", "noi_dung_diem")])
    # Where the registry brings row ids, a document's chunks follow each other, and the copies of one that its registry rows make.
    own = [(F.col("row_start") + F.col("chunk_seq") * F.col("copies") + F.col("copy")).alias("row_id")] if "row_start" in j.columns else []
    return j.select("doc_key", "chunk_seq", *own, meta.alias("metadata"), content.alias("page_content"), F.array().cast("array<string>").alias("noi_dung_tham_chieu"))


def build_numbered_chunks(leaves: DataFrame, registry: DataFrame) -> DataFrame:
    """``build_chunks`` with the row_id of ``assign_row_ids``. Ids come to the articles with the registry's fields, so that no text is dealt out by chunk.

    The leaves are those of ``chunk_leaves``: a document's chunk_seq runs from 0 without
    gaps. Keys alone are stored and numbered; the leaves are read twice.
    """
    return build_chunks(leaves, numbered_registry(leaves, registry))


def numbered_registry(leaves: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry's rows of documents with leaves, with row_start, the row_id of the document's first chunk, and the number and place of its registry rows."""
    keys = ["doc_key", "chunk_seq"]
    ids = numbered(stored(leaves.select(*keys).join(registry.select("doc_key"), "doc_key"), "chunk-keys"), [F.col(k) for k in keys], "row_id")
    starts = ids.groupBy("doc_key").agg(F.min("row_id").alias("row_start"))
    of = W.partitionBy("doc_key")
    rows = registry.withColumns({"copies": F.count(F.lit(1)).over(of), "copy": F.row_number().over(of.orderBy(*registry.columns)) - 1})
    return rows.join(starts.hint("merge"), "doc_key")


def link_appendices(chunks: DataFrame, appendix: DataFrame) -> DataFrame:
    """Fill noi_dung_tham_chieu: numbered mentions in order of first mention, each existing appendix of the same document once, then the unnumbered one if "attached" is said.

    Of appendices with the same number the last counts. Mentions, not chunks, are
    exploded, and texts are joined to them only at the end.
    """
    keys = ["doc_key", "chunk_seq"]
    refs = appendix_refs(chunks, appendix, keys)
    return chunks.drop("noi_dung_tham_chieu").join(refs, keys, "left").withColumn(
        "noi_dung_tham_chieu", F.coalesce("refs", F.array().cast("array<string>"))
    ).drop("refs")


def appendix_refs(chunks: DataFrame, appendix: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, refs) of the chunks that refer to appendices of their document; keys: columns that tell a chunk."""
    last = appendix.groupBy("doc_key", "so").agg(F.max(F.struct("pl_idx", "ten", "noi_dung")).alias("a")).select("doc_key", "so", "a.ten", "a.noi_dung")
    raw = F.transform(F.regexp_extract_all("page_content", F.lit(T.APPENDIX_MENTION), F.lit(1)), lambda x: F.struct(x.alias("raw"), F.lit(True).alias("numbered")))
    attached = F.when(F.col("page_content").rlike(T.APPENDIX_ATTACHED), F.array(F.struct(F.lit("kèm theo").alias("raw"), F.lit(False).alias("numbered"))))
    said = F.concat(raw, F.coalesce(attached, F.array().cast("array<struct<raw:string,numbered:boolean>>")))
    of = list(dict.fromkeys(["doc_key", *keys]))
    m = chunks.select(*of, F.posexplode(said).alias("pos", "m"))
    m = m.select(*of, "pos", "m.raw", F.when(F.col("m.numbered"), T.roman_to_int(F.col("m.raw"))).alias("so"))
    first = m.groupBy(*of, "so").agg(F.min(F.struct("pos", "raw")).alias("p"))
    hit = first.join(last, (first["doc_key"] == last["doc_key"]) & first["so"].eqNullSafe(last["so"])).select(
        *[first[k] for k in keys], "p.pos", F.concat(F.lit("Phụ lục "), "p.raw", F.lit(": "), "ten", F.lit(" "), "noi_dung").alias("ref")
    )
    return hit.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per document and, with a null doc_key, in total."""
    return chunks.rollup("doc_key").agg(F.count(F.lit(1)).alias("n_chunks"))


def assign_row_ids(chunks: DataFrame) -> DataFrame:
    """Dense 0-based row_id in order of (doc_key, chunk_seq), by sorted ranges and their exact counts; neither a document nor a key's prefix is ever one task.

    Keys alone are stored and numbered; chunks get the numbers by a join, so columns
    that are not asked for are never read. The chunks are read twice: they must be the
    same both times, as those made from stored lines are.
    """
    keys = ["doc_key", "chunk_seq"]
    ids = numbered(stored(chunks.select(*keys), "chunk-keys"), [F.col(k) for k in keys], "row_id")
    # Rows of one key are numbered one after another.
    first = ids.groupBy(*keys).agg(F.min("row_id").alias("row_id"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("row_id")) - 1
    # Plain keys, so that chunks which a join has dealt out by them stay where they are.
    return chunks.join(first.hint("merge"), keys).withColumn("row_id", F.col("row_id") + nth)


def flatten_payload(chunks: DataFrame) -> DataFrame:
    """The 25 flat payload columns, with row_id where the chunks have one."""
    own = [c for c in ("row_id",) if c in chunks.columns]
    return chunks.select(*own, "page_content", "metadata.*", "noi_dung_tham_chieu")


def points_per_source(payload: DataFrame) -> DataFrame:
    """Points per source file and, with null, in total."""
    return payload.rollup("source_file").agg(F.count(F.lit(1)).alias("n_points"))

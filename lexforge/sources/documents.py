"""Reading statute files and the registry."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import TABLE_ROWS

# Fixed value: the name space of word-processing files.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RAW_BLOCKS = f"doc_key string, source_file string, block_idx int, kind string, text string, rows {TABLE_ROWS}"


# What the elements of a run stand for, besides its text.
IN_RUN = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "-"}


def _run_text(run: ElementTree.Element) -> str:
    """Text of a run's own elements; a page or column break is none."""
    out = []
    for e in run:
        name = e.tag.removeprefix(WORD)
        if name == "t":
            out.append(e.text or "")
        elif name == "br":
            out.append("\n" if e.get(f"{WORD}type", "textWrapping") == "textWrapping" else "")
        else:
            out.append(IN_RUN.get(name, ""))
    return "".join(out)


def _text(p: ElementTree.Element) -> str:
    """Text of a paragraph's runs and hyperlinks. Tab stops, text boxes and tracked insertions are no part of it."""
    runs = (r for child in p for r in ([child] if child.tag == f"{WORD}r" else child.findall(f"{WORD}r") if child.tag == f"{WORD}hyperlink" else []))
    return "".join(map(_run_text, runs))


def table_rows(tbl: ElementTree.Element) -> list[list[dict]]:
    """Cells of a table's rows, one for each column of its grid: a cell merged over columns or rows appears wherever it reaches, with one cell_id."""
    rows: list[list[dict]] = []
    for r, tr in enumerate(tbl.findall(f"{WORD}tr")):
        cells: list[dict] = []
        for c, tc in enumerate(tr.findall(f"{WORD}tc")):
            span, merge = tc.find(f"{WORD}tcPr/{WORD}gridSpan"), tc.find(f"{WORD}tcPr/{WORD}vMerge")
            columns = int(span.get(f"{WORD}val", "1")) if span is not None else 1
            above = rows[-1][len(cells) : len(cells) + columns] if rows else []
            if merge is not None and merge.get(f"{WORD}val", "continue") == "continue" and len(above) == columns:
                cells += above
            else:
                cells += [{"cell_id": f"{r}.{c}", "text": "\n".join(_text(p) for p in tc.findall(f"{WORD}p"))}] * columns
        rows.append(cells)
    return rows


def file_blocks(content: bytes) -> list[dict]:
    """Paragraphs and tables of one file's body, in order."""
    body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(content)).open("word/document.xml")).getroot().find(f"{WORD}body")
    out = []
    for child in body if body is not None else []:
        if child.tag == f"{WORD}p":
            out.append({"kind": "p", "text": _text(child), "rows": None})
        elif child.tag == f"{WORD}tbl":
            out.append({"kind": "t", "text": None, "rows": table_rows(child)})
    return out


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, source_file, block_idx, kind, text) of all .docx files of a directory; a table's text is its Markdown.

    Files are read by Spark, one file per row, and decoded in the tasks.
    """
    return decode_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path))


def decode_files(found: DataFrame) -> DataFrame:
    """The blocks of files (path, content)."""
    files = found.select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [{"doc_key": os.path.basename(p).removesuffix(".docx"), "source_file": p, "block_idx": i, **b} for i, b in enumerate(file_blocks(content))]
                if rows:
                    yield pd.DataFrame(rows)

    raw = files.mapInPandas(decode, RAW_BLOCKS)
    text = F.when(F.col("kind") == "t", T.table_to_markdown(F.coalesce("rows", F.array().cast(TABLE_ROWS)))).otherwise(F.col("text"))
    return raw.select("doc_key", "source_file", "block_idx", "kind", text.alias("text"))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry as JSON lines: doc_key (file stem) and the seven document fields."""
    fields = "so_hieu string, ten_van_ban string, loai_van_ban string, co_quan_ban_hanh string, ngay_ban_hanh string, ngay_hieu_luc string, con_hieu_luc boolean"
    return spark.read.schema(f"doc_key string, {fields}").json(path)

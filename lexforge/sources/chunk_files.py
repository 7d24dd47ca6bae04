"""Chunk files and the point table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import CHUNK

# Fixed value: chunks repeat the texts above them, so their files shrink about tenfold. Readers tell it by the name.
COMPRESSION = "gzip"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines are skipped by the reader."""
    return spark.read.schema(CHUNK).json(path)


def read_chunks_per_document(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, chunk_seq, ...) from ``write_chunks_per_document``: keys as they were written, places from the files themselves."""
    return spark.read.schema(f"chunk_seq long, {CHUNK}, doc_key string").json(path)


def write_chunks_per_document(chunks: DataFrame, path: str) -> None:
    """JSON lines document by document, in chunk order: a file holds whole documents, one after another.

    A line holds its document and its place, so that neither rests on the names or the
    order of files. The number of files follows the size of the table, not the number of
    documents: a directory for each is made, committed and listed one at a time.
    Chunks that are dealt out by document already stay where they are.
    """
    ordered = chunks.repartition("doc_key").sortWithinPartitions("doc_key", "chunk_seq")
    ordered.select("doc_key", F.col("chunk_seq").cast("long").alias("chunk_seq"), "metadata", "page_content", "noi_dung_tham_chieu").write.mode("overwrite").option("compression", COMPRESSION).json(path)


def merge_chunks(chunks: DataFrame, path: str) -> None:
    """All chunks as JSON lines in order of document and place: a range sort, so part files follow each other."""
    ordered = chunks.orderBy("doc_key", "chunk_seq")
    ordered.select("metadata", "page_content", "noi_dung_tham_chieu").write.mode("overwrite").option("compression", COMPRESSION).option("ignoreNullFields", "false").json(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Merged chunks with ``line``, their 0-based number over all part files in order of name.

    Lines are numbered by the task that reads their split of a file, and splits begin
    after the counts of those before: no text is stored or dealt out for it.
    """
    split = ["file_name", "file_block_start"]
    whole = spark.read.schema(CHUNK).json(path).select("*", *[f"_metadata.{c}" for c in split]).filter("metadata is not null")
    counts = whole.groupBy(*split).agg(F.count(F.lit(1)).alias("n"))
    # One row for each split of a file.
    before = W.partitionBy(F.lit(1)).orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    j = whole.mapInArrow(_nth_of_split, f"{CHUNK}, file_name string, file_block_start long, nth long").join(F.broadcast(offsets), split)
    return j.select((F.col("offset") + F.col("nth")).alias("line"), "metadata", "page_content", "noi_dung_tham_chieu")


def _nth_of_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with 0, 1, ... for the rows of each split; a task reads a split whole and in order, whichever others it has."""
    last, done = None, 0
    for b in batches:
        if not len(b):
            continue
        name, start = b.column("file_name"), b.column("file_block_start")
        other = pc.or_(pc.not_equal(name[1:], name[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.flatnonzero(other) + 1])
        nth = np.arange(len(b)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(b)]])))
        first, end = (name[0].as_py(), start[0].as_py()), (name[-1].as_py(), start[-1].as_py())
        if first == last:
            nth[: begins[1] if len(begins) > 1 else len(b)] += done
        last, done = end, int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth, pa.int64())], [*b.schema.names, "nth"])


def upsert_points(existing: DataFrame, incoming: DataFrame, key: str = "row_id", version: str | None = None) -> DataFrame:
    """incoming over existing by key; other existing rows stay. Of incoming rows with one key, that with the largest version stays."""
    if version:
        last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))
        incoming = incoming.withColumn("__n", last).filter("__n = 1").drop("__n")
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def reset_index(points: DataFrame, path: str) -> None:
    """Replace the stored points."""
    points.write.mode("overwrite").option("compression", "zstd").parquet(path)

"""Target-distribution importance resampling over hashed n-grams, by CRC combination.

Features of a text are its runs of one to three words, hashed by CRC-32 into buckets.
A word's CRC is computed once. The CRC of "a b" follows from those of "a" and " b": it
is the first, shifted by the length of the second, XOR the second; to shift a CRC by n
zero bytes is a product with a fixed 32 x 32 matrix over GF(2). So the n-grams of a
batch are two shifts per word over arrays, and no n-gram string is ever made.

1. Bucket counts of the corpus and of the target: a task emits one row per bucket.
2. The gain of a bucket is the scaled log ratio of its smoothed shares; there are
   ``buckets`` of them, whatever the corpus, so they go to the tasks as one array.
3. Documents are weighed by the gains of their features; Gumbel noise drawn from a
   hash of the id turns the k largest scores into a sample without replacement.
4. Ranks come from sorted ranges and their exact counts, not from one window.

Defined results: null and wordless texts have no feature and weight 0, in the corpus as
in the target; an empty target or corpus counts as all buckets alike; a document with
fewer than ``least_words`` words is weighed, never drawn; ids are hashed in their text
form, a null one as empty; equal scores go by the smaller id, nulls last; repeated rows
are documents of their own; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import materialize
from .fill_in_middle import pieces

# Fixed value: the polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320

SHORT = 64  # lengths below are shifted by one table, longer ones by powers of two on top
BY_TABLE = 24  # words up to this many bytes are hashed together, byte by byte
PIECE = 4 << 20


def _byte_table() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, np.uint32(POLYNOMIAL) ^ (v >> np.uint32(1)), v >> np.uint32(1))
    return v


BYTE = _byte_table()


def _times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of a 32 x 32 matrix with vectors; the matrix is given by its products with each byte at each of four places."""
    return matrix[0][v & 255] ^ matrix[1][(v >> np.uint32(8)) & 255] ^ matrix[2][(v >> np.uint32(16)) & 255] ^ matrix[3][v >> np.uint32(24)]


def _matrices() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifts by 0 .. SHORT - 1 bytes, and by SHORT, 2 SHORT, 4 SHORT ... bytes."""
    at = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    short = []
    for _ in range(SHORT + 1):
        short.append(at)
        at = BYTE[at & 255] ^ (at >> np.uint32(8))
    powers = [short.pop()]
    while len(powers) < 26:
        powers.append(_times(powers[-1], powers[-1]))
    return np.stack(short), powers


MATRIX, POWERS = _matrices()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after ``length`` more zero bytes."""
    # The low part of all lengths at once: one gather for each byte of the CRC.
    base = (length & (SHORT - 1)) << 10
    flat = MATRIX.reshape(-1)
    out = flat[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[base + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    high = length // SHORT
    bit = 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _times(POWERS[bit], out[odd])
        high, bit = high >> 1, bit + 1
    return out


def _word_bytes() -> np.ndarray:
    """A byte's place in a word: itself, lower case for A-Z, and 0 for what separates words."""
    t = np.zeros(256, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[low : high + 1] = np.arange(low, high + 1)
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


IN_WORD = _word_bytes()


def word_crcs(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of every word (first byte and length in data)."""
    crc = np.full(len(first), 0xFFFFFFFF, dtype=np.uint32)
    short = np.flatnonzero(length <= BY_TABLE)
    order = short[np.argsort(-length[short], kind="stable")]
    at, left, c = first[order], length[order], crc[order]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))  # words longer than j come first
        c[:n] = BYTE[(c[:n] ^ data[at[:n] + j]) & 255] ^ (c[:n] >> np.uint32(8))
    crc[order] = c
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > BY_TABLE):
        crc[i] = zlib.crc32(data[first[i] : first[i] + length[i]])
    return crc


SPACE = np.uint32(zlib.crc32(b" "))


def ngram_crcs(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """CRCs of the n-grams (n = 1, 2, 3) that begin at each word of all texts together, the words' first number and end in each text.

    Entry i of the n-th array is the run from word i on; only those that end within a
    text are features, those before ``end - n + 1``.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = IN_WORD[np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]]] if held is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = data != 0
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # A text's border ends a word that its neighbour seems to go on with.
    border = offsets[(offsets > 0) & (offsets < len(data))]
    begins[border] = inside[border + 1]
    ends[border - 1] = inside[border]
    first = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - first
    one = word_crcs(data, first, length)
    spaced = shift(np.full(len(one), SPACE), length) ^ one
    two = shift(one[:-1], length[1:] + 1) ^ spaced[1:]
    three = shift(two[:-1], length[2:] + 1) ^ spaced[2:] if len(one) > 2 else two[:0]
    number = np.searchsorted(first, offsets)
    return [one, two, three], number[:-1], number[1:]


def _rows(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__utf8"))


def feature_counts(df: DataFrame, text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; empty buckets may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for lo, many in pieces(b.column(0), PIECE):
                grams, begin, end = ngram_crcs(b.column(0).slice(lo, many))
                for n, g in enumerate(grams):
                    # Runs that a text has are a range; +1 where one begins, -1 behind it.
                    edge = np.zeros(len(g) + 1, dtype=np.int64)
                    stop = np.maximum(end - n, begin)
                    some = stop > begin
                    np.add.at(edge, begin[some], 1)
                    np.add.at(edge, stop[some], -1)
                    total += np.bincount(g[np.cumsum(edge[:-1]) > 0] % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    return _rows(df, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """Scaled log ratios of the smoothed shares of each bucket in the target and in the corpus: ``buckets`` numbers, so small by nature."""

    def counts(df: DataFrame, col: str) -> list[int]:
        out = [0] * buckets
        for bucket, n in feature_counts(df, col, buckets).collect():
            out[bucket] = n
        return out

    s, t = counts(corpus, text_col), counts(target, target_col)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight and score (weight with Gumbel noise)."""
    rows = _rows(docs, text_col, F.col(id_col).alias("doc_id"))
    schema = rows.select("doc_id").withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")}).schema
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, many in pieces(b.column(1), PIECE):
                grams, begin, end = ngram_crcs(b.column(1).slice(lo, many))
                features, weight = np.zeros(many, dtype=np.int64), np.zeros(many, dtype=np.int64)
                for n, g in enumerate(grams):
                    upto = np.concatenate([[0], np.cumsum(gains[g % buckets])])
                    stop = np.maximum(end - n, begin)
                    features += stop - begin
                    some = np.flatnonzero(stop > begin)
                    weight[some] += upto[stop[some]] - upto[begin[some]]
                columns = [b.column(0).slice(lo, many), *map(pa.array, (end - begin, features, weight))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    weighed = rows.mapInArrow(run, schema)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and, where it is drawn, its rank from 1."""
    gains = bucket_gains(docs, target, text_col, target_col, buckets)
    scored = materialize(weigh(docs, gains, id_col, text_col, seed).withColumn("may", F.col("n_words") >= least_words), "importance")
    draw = scored.filter("may").count() * percent // 100
    ranked = numbered(scored, [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id")], "place", 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") <= draw), F.col("place")).alias("rank"))

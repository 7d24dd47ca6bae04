"""Encoding whole texts with a public tokenizer, and exact length statistics.

The tokenizer file is a parameter. A tokenizer whose pre-tokenizer drops white
space gives a text the concatenated ids of its white-space separated chunks, so
chunks are encoded once per worker and looked up after that; any other tokenizer
encodes whole texts. Of the cache, what was not used since a fixed number of new
entries goes, which costs time, never exactness.

Token counts: documents are aggregated to an exact histogram of encoded lengths;
suffix sums over it answer totals, quantiles and truncated totals for every limit.

Defined results: null text counts as empty and has length 0; empty table gives an
empty result; repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pieces

#: New entries of the cache until those not used among them are dropped; at most twice as many are held.
CACHE_ENTRIES = 300_000


class Encoder(dict):
    """Chunk of UTF-8 bytes -> its ids as unsigned 32-bit numbers in the machine's (little-endian) order."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        config = json.loads(self.tokenizer.to_str())
        probe = self._whole("Ab c9,  d\n'll é")
        self.by_chunk = probe == b"".join(self._whole(x) for x in ("Ab", "c9,", "d", "'ll", "é")) and "Removed" in json.dumps(config["pre_tokenizer"])
        # Within a chunk, letters of this range have no normal form but lower case, and a
        # run of them is one unit, as is what follows it, if no apostrophe takes part.
        steps = [s["type"] for s in (config.get("normalizer") or {}).get("normalizers", [])]
        self.by_unit = self.by_chunk and steps == ["NFC", "Replace", "Lowercase"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        if unit.isalpha() and (unit.isascii() or max(unit) < "\u0130"):
            mapped = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        return self._whole(unit)

    def __missing__(self, chunk: bytes) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self._chunk(chunk.decode("utf-8", "replace"))
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got

    def _chunk(self, text: str) -> bytes:
        if self.by_unit and (text.isascii() or max(text) < "\u0130"):
            lower = text.lower()
            bare = lower.rstrip(".,!?;:|%&*$#")
            # An all-letter unit and the punctuation after it, or either alone; else the chunk as it is.
            if bare != lower and bare.isalpha():
                return self[bare.encode()] + self[lower[len(bare) :].encode()]
            return self[lower.encode()] if lower != text else self._unit(text)
        return self._unit(text)

    def ids(self, data: bytes) -> bytes:
        """Ids of a whole text, as bytes."""
        if self.by_chunk:
            return b"".join(map(self.__getitem__, data.split()))
        return self._whole(data.decode("utf-8", "replace"))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def utf8(column: str):
    """The text as bytes, null as empty, for a zero-copy hand-over to Arrow."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the carried columns and n_tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, utf8(text_col).alias("__utf8"))
    schema = rows.drop("__utf8").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in (x for batch in batches for x in pieces(batch)):
            n = pa.array([len(enc.ids(x)) // 4 for x in b.column("__utf8").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(lengths, schema)


def length_histogram(lengths: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, n_tokens, n_docs), partly aggregated before the shuffle."""
    return lengths.groupBy(*groups, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


LIMITS = (512, 1024, 2048, 4096, 8192)
SHARES = (0.5, 0.9, 0.99)


def length_report(histogram: DataFrame, limits: tuple[int, ...] = LIMITS, shares: tuple[float, ...] = SHARES, block: int = 1024) -> DataFrame:
    """One row for every context limit: those given and every length that occurs.

    limit, n_docs (of exactly this length), docs_upto and tokens_upto (not longer),
    docs_over and tokens_over (longer), truncated_total (tokens left when every text is
    cut at the limit), total_docs, total_tokens, cum_share (share of documents not
    longer) and q50, q90, ...: the quantiles of the cut lengths, for each share the
    smallest length that at least so many documents do not exceed.

    What is longer is a suffix sum over the histogram, taken in two steps, blocks of
    lengths and then within a block, so no task sees the whole histogram, however long
    texts are. An empty histogram gives an empty report.
    """
    spark = histogram.sparkSession
    # Two branches below read it: stored, so that the texts are encoded once.
    histogram = materialize(histogram, "histogram")
    some = histogram.select(F.lit(True).alias("some")).limit(1)
    given = spark.createDataFrame([(int(n),) for n in limits], "n_tokens long").join(F.broadcast(some)).select("n_tokens", F.lit(0).cast("long").alias("n_docs"))
    every = histogram.select(F.col("n_tokens").cast("long").alias("n_tokens"), "n_docs").unionByName(given).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    h = materialize(every.withColumn("block", F.floor(F.col("n_tokens") / block)), "lengths")
    tokens = F.col("n_docs") * F.col("n_tokens")
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    longer = W.partitionBy(F.lit(1)).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    blocks = sums.select(
        "block", F.coalesce(F.sum("d").over(longer), F.lit(0)).alias("d1"), F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("t1"),
        F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"),
    )
    after = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    suffix = lambda c: F.coalesce(F.sum(c).over(after), F.lit(0))
    r = h.join(blocks, "block").select(
        F.col("n_tokens").alias("limit"), "n_docs", (F.col("d1") + suffix("n_docs")).alias("docs_over"), (F.col("t1") + suffix(tokens)).alias("tokens_over"), "total_docs", "total_tokens"
    )
    r = r.withColumns({"docs_upto": F.col("total_docs") - F.col("docs_over"), "tokens_upto": F.col("total_tokens") - F.col("tokens_over")})
    r = materialize(r.withColumns({"truncated_total": F.col("tokens_upto") + F.col("docs_over") * F.col("limit"), "cum_share": F.col("docs_upto") / F.col("total_docs")}), "limits")
    names = [f"q{round(100 * q)}" for q in shares]
    # One row.
    cuts = r.agg(*[F.min(F.when(F.col("docs_upto") >= q * F.col("total_docs"), F.col("limit"))).alias(n) for q, n in zip(shares, names, strict=True)])
    return r.join(F.broadcast(cuts)).select(*r.columns, *[F.least("limit", n).alias(n) for n in names])

"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word boundaries) and itself,
hashed to buckets; its vector is the mean of their embeddings, a text's vector the
mean over all its words, and a linear softmax on it gives the probability. Buckets'
embeddings and the softmax are trained jointly in numpy, so a misspelling that was
never seen shares the vectors of the n-grams it has in common with known words.

Training takes a bounded sample of labelled rows: at most ``max_positive`` and
``max_negative`` of them, the first by a seeded hash of the id. Every n-gram of the
sample has a vector of its own. What it adds to a text is scaled: by the spread of
its weights, and by a smooth function of Welch's t between the classes,
t ** 8 / (t ** 8 + ``typical_t`` ** 8), so that n-grams which differ no more than by
chance learn slowly and are not learned by heart. The statistics are summed by Spark,
one row a bucket, and one task fits the sample: the driver gets the model alone.

Scoring covers every whole text: for a trained model a bucket's part of the logit is
one number, so the model sent to the tasks is one array of ``buckets`` numbers, and a
text's logit is the mean over its words. Word scores are cached per worker up to a
fixed number.

Defined results: null and empty texts have no word and get the score of the bias
alone; a null or missing label is not learned from; repeated rows are scored alike;
an id labelled twice counts once per label row; without labels of both kinds every
text gets the class that there is (0 if none); an empty table gives an empty result;
ids may be of any type; a column named like the score is replaced by ``score`` and kept
by ``drop_toxic``; other columns are kept and not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, pieces
from .tokens import utf8

#: Words that a task keeps in a dictionary; arrays of their buckets take more room each, so a quarter as many.
CACHE_WORDS = 240_000


@dataclass(frozen=True)
class ToxicityModel:
    """part[b]: what bucket b adds to the logit of a word that has it; bias: the logit without words."""

    part: np.ndarray
    bias: float
    n_min: int = 3
    n_max: int = 6


def held_out(id_col: str) -> Column:
    """True for ids whose crc32 (of the decimal text) is divisible by 5; these labels are never learned."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def normal_word(chunk: bytes) -> str:
    """Lower case, without leading and trailing characters that are neither letters nor digits (unless nothing else is there)."""
    word = chunk.decode("utf-8", "replace").lower()
    if word.isalnum():
        return word
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end] or word


def word_buckets(word: str, buckets: int, n_min: int, n_max: int) -> list[int]:
    """Buckets of the n-grams of a word with its boundaries, and of the word itself."""
    crc, marked = zlib.crc32, f"<{word}>"
    if marked.isascii():  # the same grams, cut from bytes at once
        m = marked.encode()
        return [crc(m) % buckets, *[crc(m[i : i + n]) % buckets for n in range(n_min, n_max + 1) for i in range(len(m) - n + 1)]]
    return [crc(marked.encode()) % buckets, *[crc(marked[i : i + n].encode()) % buckets for n in range(n_min, n_max + 1) for i in range(len(marked) - n + 1)]]


def _bags(batches: Iterator[pa.RecordBatch], buckets: int, n_min: int, n_max: int):
    """(doc_id, toxic, distinct buckets, weights) of each text; the weights of a text with words sum to 1."""
    known: dict[bytes, np.ndarray] = {}
    for b in (piece for batch in batches for piece in pieces(batch)):
        for doc_id, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words, parts = text.split(), []
            for w in words:
                got = known.get(w)
                if got is None:
                    if len(known) >= CACHE_WORDS // 4:
                        known.clear()
                    got = known[w] = np.array(word_buckets(normal_word(w), buckets, n_min, n_max), dtype=np.int32)
                parts.append(got)
            if not parts:
                yield doc_id, toxic, np.zeros(0, np.int32), np.zeros(0)
                continue
            sizes = np.array([len(p) for p in parts])
            idx, back = np.unique(np.concatenate(parts), return_inverse=True)
            yield doc_id, toxic, idx, np.bincount(back, weights=np.repeat(1.0 / sizes, sizes)) / len(words)


def bucket_statistics(texts: DataFrame, buckets: int, n_min: int, n_max: int) -> DataFrame:
    """(bucket, toxic, n, total, squares) over (doc_id, toxic, utf8): documents with the bucket, sum of weights and of their squares."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 3, buckets))
        for _, toxic, idx, w in _bags(batches, buckets, n_min, n_max):
            sums[toxic, 0, idx] += 1
            sums[toxic, 1, idx] += w
            sums[toxic, 2, idx] += w * w
        for toxic in (0, 1):
            at = np.flatnonzero(sums[toxic, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(np.full(len(at), toxic), pa.int32()), *[pa.array(sums[toxic, k, at]) for k in range(3)]],
                ["bucket", "toxic", "n", "total", "squares"],
            )

    rows = texts.mapInArrow(partial, "bucket int, toxic int, n double, total double, squares double")
    return rows.groupBy("bucket", "toxic").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def bucket_scales(statistics: DataFrame, n_docs: tuple[int, int], buckets: int, typical_t: float, typical_docs: int) -> np.ndarray:
    """What each bucket's weight is multiplied by, from at most two rows of statistics a bucket."""
    rows = statistics.toPandas()
    n, total, squares = (np.zeros((2, buckets)) for _ in range(3))
    for out, column in ((n, "n"), (total, "total"), (squares, "squares")):
        out[rows["toxic"], rows["bucket"]] = rows[column]
    of = np.array(n_docs)[:, None]
    mean = total / of
    variance = np.maximum(0, squares / of - mean * mean)
    t = np.abs(mean[1] - mean[0]) / np.sqrt((variance / of).sum(axis=0) + 1e-12)
    docs = n.sum(axis=0)
    trust = t**8 / (t**8 + typical_t**8) * docs / (docs + typical_docs)
    return trust / (np.sqrt(variance.sum(axis=0) / 2) + 1e-6) / math.sqrt(max((trust * trust).sum(), 10) / 10)


def features(texts: DataFrame, buckets: int, n_min: int, n_max: int) -> DataFrame:
    """(doc_id, toxic, idx, weight): the buckets of each text and their weights, as little-endian arrays."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, idx, weight = zip(*[(i, y, at.astype("<i4").tobytes(), w.astype("<f4").tobytes()) for i, y, at, w in _bags(iter([b]), buckets, n_min, n_max)], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(labels, pa.int32()), pa.array(idx, pa.binary()), pa.array(weight, pa.binary())], ["doc_id", "toxic", "idx", "weight"]
            )

    return texts.mapInArrow(make, "doc_id string, toxic int, idx binary, weight binary")


def fit(idx: list[np.ndarray], weight: list[np.ndarray], label: np.ndarray, scale: np.ndarray, dim: int = 4, epochs: int = 5, batch: int = 32, rate: float = 0.02, seed: int = 7) -> tuple[np.ndarray, float]:
    """Joint training of embeddings and softmax by Adam. Returns each bucket's part of the logit and the bias."""
    rng = np.random.default_rng(seed)
    buckets = len(scale)
    table = np.zeros((buckets, dim), dtype=np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, out, bias)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        lr = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            cols = np.concatenate([idx[r] for r in rows])
            w = np.concatenate([weight[r] for r in rows]) * scale[cols]
            owner = np.repeat(np.arange(len(rows)), [len(idx[r]) for r in rows])
            hidden = np.stack([np.bincount(owner, weights=w * table[cols, k], minlength=len(rows)) for k in range(dim)], axis=1).astype(np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            g_hidden = p @ out.T
            g_table = np.stack([np.bincount(cols, weights=w * g_hidden[owner, k], minlength=buckets) for k in range(dim)], axis=1).astype(np.float32)
            step += 1
            for param, grad, (m, v) in zip((table, out, bias), (g_table, hidden.T @ p, p.sum(axis=0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return scale * (table @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0])


def train(
    docs: DataFrame, labels: DataFrame, max_positive: int = 1500, max_negative: int = 4500, buckets: int = 1 << 17, n_min: int = 3, n_max: int = 6,
    typical_t: float = 4.0, typical_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = 7,
) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out("__id") & F.col("toxic").isin(0, 1))
    pick = lambda value, most: usable.filter(F.col("toxic") == value).orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(most)
    sample = pick(1, max_positive).unionByName(pick(0, max_negative))
    # At most max_positive + max_negative rows: the proven bound of this broadcast.
    found = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    texts = materialize(found.select(F.col("__id").cast("string").alias("doc_id"), "toxic", utf8("__text").alias("utf8")), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return ToxicityModel(np.zeros(buckets), math.inf if 1 in n else -math.inf, n_min, n_max)
    scale = bucket_scales(bucket_statistics(texts, buckets, n_min, n_max), (n[0], n[1]), buckets, typical_t, typical_docs)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True))
        label = np.array([r[1] for r in rows], dtype=np.int64)
        part, bias = fit([np.frombuffer(r[2], "<i4") for r in rows], [np.frombuffer(r[3], "<f4") for r in rows], label, scale, seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([part.astype("<f8").tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["part", "bias"])

    # One task fits the bounded sample; the driver gets the model alone.
    fitted = features(texts, buckets, n_min, n_max).repartition(1).mapInArrow(learn, "part binary, bias double").first()
    # The sample has another share of toxic rows than all labelled rows; the bias is put back to theirs.
    every = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    shift = math.log(every[1] / every[0]) - math.log(n[1] / n[0])
    return ToxicityModel(np.frombuffer(fitted["part"], "<f8"), fitted["bias"] + shift, n_min, n_max)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with all columns and ``score_col``, a probability from the text alone."""
    text = utf8(text_col)
    (given,) = fresh(docs, "utf8")
    rows = docs.withColumn(given, text).drop(score_col)
    held = [c for c in rows.columns if c != given]
    rows = rows.select(*[f"`{c}`" for c in held], given)
    schema = rows.drop(given).withColumn(score_col, F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = model.part.tolist()
        plain: dict[str, float] = {}  # chunks that differ in punctuation or case share a word

        class Words(dict):
            def __missing__(self, chunk: bytes) -> float:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                w = normal_word(chunk)
                got = plain.get(w)
                if got is None:
                    if len(plain) >= CACHE_WORDS:
                        plain.clear()
                    at = word_buckets(w, len(part), model.n_min, model.n_max)
                    plain[w] = got = sum([part[i] for i in at]) / len(at)
                self[chunk] = got
                return got

        word = Words()
        for b in batches:
            logits = []
            for text in (t for piece in pieces(b) for t in piece.column(len(held)).to_pylist()):
                chunks = text.split()
                logits.append(model.bias + (sum(map(word.__getitem__, chunks)) / len(chunks) if chunks else 0.0))
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-np.array(logits, dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(held)], pa.array(p)], [*held, score_col])

    return rows.mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with their columns."""
    (toxicity,) = fresh(docs, "toxicity")
    return score(docs, model, text_col, toxicity).filter(F.col(toxicity) < threshold).drop(toxicity)

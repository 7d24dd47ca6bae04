"""Best-fit packing of token sequences by a configuration linear program.

Documents are encoded, ended with one id, and cut only where they exceed the
capacity. What decides the packing is the histogram of piece lengths, which has at
most ``capacity`` rows whatever the corpus, so that alone is solved in one place:

* a configuration says how many pieces of each length share a sequence. The covering
  program (fewest sequences, in fractions, so that every length's pieces are placed) is
  solved by multiplicative weights: every length has a weight, the best configurations
  for the current weights are priced by knapsack dynamic programming over capacities,
  each is taken as often as the least supplied of its lengths allows, and lengths so
  placed weigh less. When all are placed, the pass is over. Lengths that ended in
  poorly filled sequences weigh more in the next pass, and passes are averaged. Any
  weights give a lower bound (their total over the best price); passes end when the
  average is within ``gap`` of the best bound, or no longer improves;
* the fractional solution is rounded: each configuration, the most used first, is
  taken its nearest whole number of times, as far as pieces are left, and the rest of
  the histogram goes, longest first, to the fullest open sequence that still takes it
  (best fit), holes in the configurations included.

The solution is a table of runs: "pieces number r0.. of length n go to sequences
s0.., k in each, from offset o". Pieces get their number within their length from
counts of (length, part), where part is a hash of the document: no task ranks all
pieces of one length. Assigning a piece is then a lookup by its number.

Defined results: null and empty texts are one piece with only the end id; a
document of exactly ``capacity`` ids is one piece; rows that share an id are packed
as separate documents; ids may be of any type; an empty table gives an empty result; other columns
are not read; sequences are filled gapless from offset 0.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .common import pieces as runs_of
from .tokens import encoder, utf8

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; ``row`` tells apart rows that share an id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("utf8"), F.xxhash64(id_col, text_col).alias("row"))
    step, tail = 4 * capacity, end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in (x for batch in batches for x in runs_of(batch)):
            at, nth, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = enc.ids(text) + tail
                for p, s in enumerate(range(0, len(ids), step)):
                    part = ids[s : s + step]
                    at.append(k)
                    nth.append(p)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), b.column(2).take(at)],
                [*COLUMNS, "row"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long")


# ---- the program over the histogram -----------------------------------------------------


class Prices:
    """Most valuable configurations for given weights: unbounded knapsack over all capacities."""

    def __init__(self, lengths: np.ndarray, weight: np.ndarray, capacity: int):
        # last[c] is the length that the best filling of c takes first, or 0 if it leaves room.
        self.best, self.last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
        fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
        for c in range(1, capacity + 1):
            self.best[c] = self.best[c - 1]
            if fits[c]:
                value = self.best[c - lengths[: fits[c]]] + weight[: fits[c]]
                j = value.argmax()
                if value[j] > self.best[c]:
                    self.best[c], self.last[c] = value[j], lengths[j]

    def filling(self, c: int, counts: dict[int, int]) -> dict[int, int]:
        """The best filling of c, added to the counts."""
        while c > 0:
            n = int(self.last[c])
            if n:
                counts[n] = counts.get(n, 0) + 1
            c -= n or 1
        return counts


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, weight: np.ndarray, epsilon: float) -> tuple[dict[tuple, float], float, np.ndarray]:
    """One pass: fractions of configurations that place every piece, the lower bound of these weights, and how well each length's sequences are filled."""
    left, weight = counts.astype(float), weight.copy()
    place = {n: i for i, n in enumerate(lengths.tolist())}
    used: dict[tuple, float] = {}
    fill, bound = np.zeros(len(lengths)), None
    while True:
        open_ = np.flatnonzero(left > 1e-9)
        if len(open_) == 0:
            return used, bound or 0.0, fill / np.maximum(counts, 1)
        prices = Prices(lengths[open_], weight[open_], capacity)
        if bound is None:
            bound = float((weight * counts).sum() / prices.best[capacity])
        value = weight[open_] + prices.best[capacity - lengths[open_]]
        # For each length the best configuration with it, the best of all first; nearly as good ones are used at the same prices.
        spent = 0
        for i in np.argsort(-value, kind="stable"):
            j = open_[i]
            if spent == 128 or value[i] < (1 - epsilon / 2) * prices.best[capacity]:
                break
            a = prices.filling(capacity - int(lengths[j]), {int(lengths[j]): 1})
            at = np.array([place[n] for n in a])
            n = np.array(list(a.values()))
            times = float((left[at] / n).min())
            if times <= 1e-9:
                spent += 1  # one of its lengths has been placed since the prices were made
                continue
            left[at] -= n * times
            left[at[left[at] <= 1e-9]] = 0
            key = tuple(sorted(zip(lengths[at].tolist(), n.tolist(), strict=True), reverse=True))
            used[key] = used.get(key, 0.0) + times
            fill[at] += n * times * float((n * lengths[at]).sum()) / capacity
            weight[at] *= np.exp(-epsilon * n * times / counts[at])


def solve_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, epsilon: float = 0.2, gap: float = 0.002) -> tuple[dict[tuple, float], float]:
    """({configuration ((length, count), ...): fraction}, lower bound on the sequences); lengths ascending."""
    weight, best, bound, total, passes = lengths / capacity, None, 0.0, {}, 0
    while True:
        used, low, fill = cover(lengths, counts, capacity, weight, epsilon)
        passes += 1
        bound = max(bound, low)
        for key, times in used.items():
            total[key] = total.get(key, 0.0) + times
        mean = {key: times / passes for key, times in total.items()}
        before, best = (sum(best.values()) if best else np.inf), min((x for x in (best, used, mean) if x), key=lambda x: sum(x.values()), default={})
        now = sum(best.values())
        if now <= (1 + gap) * bound or now > (1 - gap / 4) * before:
            return best, bound
        weight = weight * np.exp(epsilon * (1 - fill))


def round_down(program: dict[tuple, float], lengths: np.ndarray, counts: np.ndarray):
    """([(configuration as {length: count}, copies)], what is left of the counts)."""
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    out = []
    for key, times in sorted(program.items(), key=lambda x: (-x[1], x[0])):
        copies = min([int(times + 0.5), *(left[n] // k for n, k in key)])
        if copies:
            out.append((dict(key), copies))
            for n, k in key:
                left[n] -= k * copies
    return out, np.array([left[n] for n in lengths.tolist()], dtype=np.int64)


def best_fit(open_bins: list, lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list:
    """Add the rest, longest first, to the fullest sequences that take it. Sequences of equal content move together.

    open_bins: [(free, content, copies)], content a list of (length, count). Returns the same, final.
    """
    groups: dict[int, list] = {}
    for free, content, copies in open_bins:
        groups.setdefault(free, []).append((content, copies))
    frees = sorted(groups)

    def put(free, content, copies):
        if free not in groups:
            groups[free] = []
            bisect.insort(frees, free)
        groups[free].append((content, copies))

    for j in np.argsort(-lengths, kind="stable"):
        n, left = int(lengths[j]), int(demand[j])
        while left:
            at = bisect.bisect_left(frees, n)
            if at == len(frees):
                k = capacity // n
                if left >= k:
                    put(capacity - k * n, [(n, k)], left // k)
                if left % k:
                    put(capacity - (left % k) * n, [(n, left % k)], 1)
                break
            free = frees[at]
            content, copies = groups[free].pop()
            if not groups[free]:
                del groups[free]
                del frees[at]
            k = min(free // n, left)
            full = min(copies, left // k)
            put(free - k * n, [*content, (n, k)], full)
            left -= k * full
            if copies > full:
                put(free, content, copies - full)
    return [(free, content, copies) for free, items in groups.items() for content, copies in items]


def plan_runs(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 0.002) -> pd.DataFrame:
    """From the histogram, lengths ascending. Runs of pieces: length, first (number within the length), n_pieces, each (pieces of this length in a sequence), sequence, offset."""
    program, _ = solve_program(lengths, counts, capacity, gap=gap)
    configured, rest = round_down(program, lengths, counts)
    bins = [(capacity - sum(n * k for n, k in c.items()), list(c.items()), copies) for c, copies in configured]
    bins = best_fit(bins, lengths, rest, capacity)
    runs, taken, sequence = [], dict.fromkeys(map(int, lengths), 0), 0
    for _, content, copies in bins:
        offset = 0
        for n, k in content:
            runs.append((n, taken[n], k * copies, k, sequence, offset))
            taken[n] += k * copies
            offset += n * k
        sequence += copies
    assert all(taken[int(n)] == int(c) for n, c in zip(lengths, counts, strict=True))
    return pd.DataFrame(runs, columns=["length", "first", "n_pieces", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


# ---- assignment -------------------------------------------------------------------------


ROWS_IN_PART = 50_000


def pack(pieces: DataFrame, capacity: int = 2048, gap: float = 0.002) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset."""
    # Pieces of a length are numbered in parts of about ROWS_IN_PART, however many pieces have it.
    by_length = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows, as lengths run from 1 to the capacity.
    histogram = by_length.toPandas().sort_values("length")
    if histogram.empty:
        return pieces.drop("row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    runs = plan_runs(histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), capacity, gap)
    parts = 1 + int(histogram["n"].max()) // ROWS_IN_PART
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(parts)))
    cells = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "row")) - 1
    numbered = pieces.withColumn("nth", nth.cast("long")).join(base, ["length", "part"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    table = {n: g.drop(columns="length").to_numpy(np.int64).T for n, g in runs.groupby("length")}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[lo:hi]
                n = int(length[at[0]])
                first, _, each, seq, off = table[n]
                k = np.searchsorted(first, number[at], side="right") - 1
                r = number[at] - first[k]
                sequence[at] = seq[k] + r // each[k]
                offset[at] = off[k] + r % each[k] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    out = numbered.select(*COLUMNS, F.col("number").alias("sequence_id"), F.col("number").alias("offset")).schema
    return numbered.mapInArrow(assign, out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", gap: float = 0.002) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(materialize(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity, gap)

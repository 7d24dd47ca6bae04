"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by (source, exact length, part), where part is the top of
   a seeded hash: that histogram is what moves, not the documents.
2. A source's target is its weight's share of the total, stopped at ``max_repeats``
   times its size, the excess being reshared by weight (water filling in closed
   form over the sources, one row each).
3. A source takes every document floor(target / size) times; the remaining budget
   is fitted on its length counts: first the same fraction of each length, then the
   longest lengths that still fit, then bounded-knapsack dynamic programming over what
   is left. If no choice of the documents left meets it, some of those taken are given
   back, twice as many words each time, until the sum is met. Memory does not follow the
   budget, see ``exchangeable``: of each length only so many need to be given back, and
   the sum is the closest to the budget that any choice of documents has. Only if even
   these have more than ``MOST_SUMS`` sums (many sizes, all of thousands of words, that
   after MOST_SUMS words of exchange still miss the budget) is it the closest found.
4. The documents to take of one length are the first by seeded hash. Their quota is
   dealt over the parts of the histogram, about ``rows_in_part`` documents each, so a
   length that a third of all rows share is ranked in many separate groups.

Results depend on ids, lengths and the seed alone, so reruns agree.

Defined results: null text has size 0 and is never taken (0 words); null source is
a source of its own, ordered last; rows equal in id and size are ranked in any
order, which leaves the result the same; a source without words has target 0; ids may be
of any type; an empty table gives an empty result; extra columns are not looked at by
``mixture_plan`` and are all kept by ``mix_documents``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, row_hash, text_of, word_count

CYCLE = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights=CYCLE, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(src, source_size, target) from (src, source_size): one row per source.

    With sources in order of max_repeats * size / weight, the capped ones are a
    prefix; the level of the others is what the prefix leaves, by weight. The table
    has one row per source, so one sorted window over it is small by nature.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = W.orderBy(F.col("src").isNull(), "src")
    w = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    w = w.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = W.partitionBy(F.lit(1))
    by = W.partitionBy(F.lit(1)).orderBy("ratio", F.col("src").isNull(), "src")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level)
    # The first source in this order that its level does not fill fixes the level of all after it.
    fixed = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    return w.select("src", "source_size", F.least("cap", F.coalesce(fixed, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words sum to the budget or, if no choice does, to the largest sum below it."""
    take = np.zeros(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    # ``budget / total`` of the documents, spread evenly over it in order of length, in whole numbers.
    passed = 0
    for i in order[::-1]:
        if lengths[i] > 0:
            before, passed = passed, passed + int(counts[i])
            take[i] = passed * budget // total - before * budget // total
    left = budget - int((lengths * take).sum())
    while left < 0:  # too much: give back the shortest document that makes up for it, or else the longest
        taken = np.flatnonzero((take > 0) & (lengths > 0))
        enough = taken[lengths[taken] >= -left]
        back = enough[np.argmin(lengths[enough])] if len(enough) else taken[np.argmax(lengths[taken])]
        take[back] -= 1
        left += int(lengths[back])
    for i in order:
        n = int(lengths[i])
        if 0 < n <= left:
            more = min(int(counts[i] - take[i]), left // n)
            take[i] += more
            left -= more * n
    if left == 0:
        return take
    goal = budget // (unit := int(np.gcd.reduce(lengths[lengths > 0]))) * unit  # sums are multiples of the lengths' common divisor
    if left == budget - goal:
        return take
    miss, best = budget - goal, (left, take)
    longest = int(lengths.max())
    room = 12 * int(lengths[lengths > 0].min())
    cap = exchangeable(lengths, counts, take, unit)
    enough = left + int((cap * lengths).sum())
    while room < min(enough, budget, total - budget + longest, MOST_SUMS * unit):
        # Documents are given back, short and long ones in turn: both open sums that the others lack.
        given, freed = take.copy(), left
        ends = [i for i in order if lengths[i] > 0 and given[i]]
        while ends and freed < room:
            for i in (ends[-1], ends[0]):
                if given[i] and freed < room:
                    given[i] -= 1
                    freed += int(lengths[i])
            ends = [i for i in (ends[0], *ends[1:-1], ends[-1]) if given[i]] if len(ends) > 1 else [i for i in ends if given[i]]
        chosen, met = subset_sum(lengths, counts - given, freed)
        best = min(best, (freed - met, given + chosen), key=lambda x: x[0])
        if best[0] == miss:
            return best[1]
        room = 2 * max(room, freed)
    # No more sums can be opened than the smallest of these has.
    most = MOST_SUMS * unit
    if budget <= min(most, total - budget + longest):
        return subset_sum(lengths, counts, budget)[0]
    if total - budget + longest <= most:
        return np.where(lengths > 0, counts, 0) - subset_sum(lengths, counts, total - budget + longest, total - budget)[0]
    if enough <= most:
        return take - cap + subset_sum(lengths, counts - take + cap, enough)[0]
    return best[1]


MOST_SUMS = 1 << 22


def exchangeable(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, unit: int) -> np.ndarray:
    """How many documents of each length of a choice ``take``, to which no more fits, must be given back at most to reach the best choice.

    Let L be the longest length and let documents be added to the choice while the sum
    is at most the budget, else given back, until it is the best choice. All sums on the
    way lie within L of the budget. If a sum came twice, the steps between could be left
    out, so the way has at most 2 L steps (in units of the lengths' common divisor), half
    of them additions, and gives back L * L at most. Nor is a length given back that is
    also added: what goes is covered by the other lengths that come, but for L.
    """
    w = lengths // unit
    longest = int(w.max())
    spare = np.minimum(counts - take, 2 * longest) * w
    others = int(spare.sum()) - spare + longest
    return np.minimum(take, np.minimum(np.minimum(longest * longest, others) // np.maximum(w, 1) + 1, 2 * longest)) * (w > 0)


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int, least: int | None = None) -> tuple[np.ndarray, int]:
    """(documents of each length, their sum), by dynamic programming over sums: the largest sum up to the budget or, if ``least`` is given, the smallest from there."""
    unit = int(np.gcd.reduce(lengths[lengths > 0])) if (lengths > 0).any() else 1
    lengths, budget = lengths // unit, budget // unit  # sums are multiples of it
    least = None if least is None else -(-least // unit)
    goal = budget if least is None else least
    by = np.full(budget + 1, -1, dtype=np.int32)  # the length that a sum was first reached with
    by[0] = len(lengths)
    for i in np.argsort(lengths, kind="stable"):
        n, spare = int(lengths[i]), int(counts[i])
        if n == 0 or n > budget or spare == 0 or by[goal] >= 0:
            continue
        # Sums that are equal but for multiples of n are a column; a sum is reached from the last one above it, at most ``spare`` rows away.
        rows = -(-(budget + 1) // n)
        open_ = np.zeros(rows * n, dtype=bool)
        open_[: budget + 1] = by >= 0
        spare = min(spare, rows)
        row = np.arange(rows, dtype=np.int32)[:, None]
        last = np.where(open_.reshape(rows, n), row, np.int32(-spare - rows))
        np.maximum.accumulate(last, axis=0, out=last)
        new = (row - last <= spare).reshape(-1)[: budget + 1] & (by < 0)
        by[new] = i
    reached = np.flatnonzero(by >= 0)
    at = met = int(reached[-1] if least is None else reached[np.searchsorted(reached, least)])
    take = np.zeros(len(lengths), dtype=np.int64)
    while at > 0:
        i = int(by[at])
        take[i] += 1
        at -= int(lengths[i])
    return take, met * unit


FITTED = "src string, size long, full long, quota long, source_size long, target double"


def _fit_sources(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one source from its length histogram."""
    pdf = pdf.sort_values("size", kind="stable")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    target, whole = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    full = int(target // whole) if whole else 0
    quota = fit_budget(lengths, counts, round(target - full * whole))
    return pd.DataFrame({"src": pdf["src"].to_numpy(), "size": lengths, "full": full, "quota": quota, "source_size": whole, "target": target})


def mixture_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=CYCLE,
    share: float = 1.5,
    max_repeats: int = 2,
    seed: int = 17,
    rows_in_part: int = 50_000,
) -> DataFrame:
    """One row per document: doc_id, src, size, source_size, target, times (how often the mix takes it)."""
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("src"), word_count(text_of(text_col)).alias("size"))
    sized = materialize(sized.withColumn("rank", rank), "mix-sizes")
    most = sized.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    sized = sized.withColumn("part", F.shiftrightunsigned("rank", 40) % (1 + most // rows_in_part))
    cells = materialize(sized.groupBy("src", "size", "part").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    targets = source_targets(cells.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_repeats)
    lengths = cells.groupBy("src", "size").agg(F.sum("n").alias("n"))
    same = lambda a, b: a["src"].eqNullSafe(b["src"])
    fitted = (
        lengths.join(targets, same(lengths, targets)).drop(targets["src"])
        .groupBy("src").applyInPandas(_fit_sources, FITTED)
    )
    joined = cells.join(fitted, same(cells, fitted) & (cells["size"] == fitted["size"])).drop(fitted["src"], fitted["size"])
    before = W.partitionBy("src", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    spare = F.col("quota") - F.coalesce(F.sum("n").over(before), F.lit(0))
    cell_quota = joined.select("src", "size", "part", "full", "source_size", "target", F.greatest(F.lit(0), F.least("n", spare)).alias("quota"))
    # Every (source, length, part) has one row here, so the join below is on keys of at most a part's rows.
    plan = sized.join(cell_quota.hint("merge"), same(sized, cell_quota) & (sized["size"] == cell_quota["size"]) & (sized["part"] == cell_quota["part"]))
    plan = plan.drop(cell_quota["src"], cell_quota["size"], cell_quota["part"])
    nth = F.row_number().over(W.partitionBy("src", "size", "part").orderBy("rank", "doc_id"))
    times = F.when(F.col("size") > 0, F.col("full") + (nth <= F.col("quota")).cast("long")).otherwise(F.lit(0))
    return plan.withColumn("times", times.cast("long")).select("doc_id", "src", "size", "source_size", "target", "times")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: rows of ``docs`` with all columns, each as often as the plan takes it.

    Rows that share id, source and size get the numbers that the plan has for them,
    larger ones first, in order of a hash of all their columns.
    """
    named, src, size, times, nth = fresh(docs, "id", "src", "size", "times", "nth")
    # Plain keys, the same for the join and for the numbering: the texts are shuffled once.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    plan = mixture_plan(docs, id_col, text_col, source_col, **options)
    plan = plan.select(key("doc_id").alias(named), key("src").alias(src), F.col("size").alias(size), "times")
    plan = plan.groupBy(named, src, size).agg(F.sort_array(F.collect_list("times"), asc=False).alias(times)).filter(F.get(times, F.lit(0)) > 0)
    keyed = docs.withColumns({named: key(id_col), src: key(source_col), size: word_count(text_of(text_col)), nth: row_hash(docs)})
    joined = keyed.join(plan.hint("merge"), [named, src, size])
    number = F.row_number().over(W.partitionBy(named, src, size).orderBy(nth))
    counted = joined.withColumn(nth, number).withColumn(nth, F.get(times, F.col(nth) - 1).cast("int")).filter(F.col(nth) > 0)
    return counted.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(nth)))).select(*[f"`{c}`" for c in docs.columns])

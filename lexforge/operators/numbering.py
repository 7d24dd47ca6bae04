"""Numbering the rows of a table in a total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import stored

# Bits of a row's place within its partition in monotonically_increasing_id.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """rows with dense numbers from ``start`` in ``order``; rows that are equal in it are numbered in any order.

    Rows are dealt into ranges of the order and sorted within each; the sorted ranges
    are stored, so ranges and places stay what they are when a task is run again. A
    range begins after the exact counts of all ranges before it: one row per range.
    """
    at = "__at"
    while at in {c.lower() for c in rows.columns}:
        at += "_"
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranges.withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(at), PLACE_BITS)
    counts = kept.groupBy(part.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(F.lit(1)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # One row per range, as many as the exchange has partitions.
    offsets = counts.select(F.col("range").alias(f"{at}range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{at}offset"))
    j = kept.withColumn(f"{at}range", part).join(F.broadcast(offsets), f"{at}range")
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return j.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(f"{at}offset") + place + F.lit(start)).alias(name))

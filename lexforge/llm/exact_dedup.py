"""Exact deduplication by a tree of merges over digest runs.

Every document is dealt to one of ``runs`` leaf runs. A run is one task's partition,
sorted by digest, in which equal digests are folded to one entry with the identifier
that stays and a count. Runs then meet in binomial rounds: in round r, ``fan_in`` runs
that agree in all but one digit of their number exchange slices, each going on with the
entries whose digest has that digit, and merge what they got. After as many rounds as a
run number has digits, every run holds one slice of all digests. Every round is merged
by all tasks, so no task ever holds the whole table. A merge takes place only where the
SHA-256 digest, the length and an independent 64-bit hash all agree, so an identifier is
retained only when verified at every level.

A text that holds a third of all rows is spread over all runs and is folded there
before it moves, so it contributes at most one entry per run to the next round.
The number of rounds is the logarithm of the number of runs.

Everything is DataFrame operations; only digests and ids are shuffled.

Defined results: null text counts as empty; a group in which every id is null
keeps the null id; rows equal in id and text are one document stored more than
once, of which exactly one row is kept (by ``exact_dedup`` that with the smallest hash of
all columns); ids may be of any type that has an order; an empty table gives an empty
result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, power_at_least, row_hash, shuffle_width, text_of

KEY = ["digest", "n_chars", "check"]


def _best(column: str, home: str, keep: str):
    """The entry that stays: that with the best id, if there is one, and of those the first run."""
    entry = lambda known, run: F.struct(known.alias("known"), F.col(column).alias("keep_id"), run.alias("home"))
    if keep == "largest":
        return F.max(entry(F.col(column).isNotNull(), -F.col(home)))
    return F.min(entry(F.col(column).isNull(), F.col(home)))


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars, check): one thin row per document."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.length(text).alias("n_chars"),
        F.xxhash64(text).alias("check"),
    )


def dedup_decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8, runs: int | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the digest columns.

    keep: "smallest" or "largest", which identifier of equal texts stays.
    runs: number of runs at the leaves; by default the shuffle width, raised to a power of fan_in.
    """
    rounds = power_at_least(fan_in, runs or shuffle_width(docs.sparkSession))
    total = fan_in**rounds
    # Rows without an id are dealt by the part of the scan they are in, as they would share a run.
    leaf = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(F.spark_partition_id())).otherwise(F.xxhash64("doc_id")), F.lit(total))
    leaves = materialize(digest_table(docs, id_col, text_col).withColumn("run", leaf), "digests")
    # A task holds whole runs; the merges below find their rows where they are.
    sorted_runs = lambda rows: rows.repartition("run").sortWithinPartitions("run", *KEY)
    first = sorted_runs(leaves).groupBy("run", *KEY).agg(_best("doc_id", "run", keep).alias("best"), F.count(F.lit(1)).alias("group_size"))
    level = first.select("run", *KEY, "best.keep_id", F.col("run").alias("home"), "group_size")
    slice_ = F.pmod(F.col("check"), F.lit(total))
    for r in range(rounds):
        digit = fan_in**r
        # The run's digit r becomes the digest's.
        other = F.col("run") + (F.floor(slice_ / digit) % fan_in - F.floor(F.col("run") / digit) % fan_in) * digit
        merged = sorted_runs(level.withColumn("run", other)).groupBy("run", *KEY).agg(_best("keep_id", "home", keep).alias("best"), F.sum("group_size").alias("group_size"))
        level = merged.select("run", *KEY, "best.keep_id", F.abs("best.home").alias("home"), "group_size")
    # The way back down: each leaf run has one entry of a text, however many rows that has.
    found = first.select("run", *KEY).join(level.drop("run").hint("merge"), KEY)
    marked = leaves.join(found.hint("merge"), ["run", *KEY])
    once = F.row_number().over(W.partitionBy("run", *KEY, "doc_id").orderBy("doc_id")) == 1
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("run") == F.col("home")) & once
    return marked.withColumn("kept", kept).drop("run", "home")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each distinct text."""
    named, digest, nth = fresh(docs, "id", "digest", "nth")
    # The join and the choice of one row use the same plain keys, so the texts are shuffled once.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    stay = dedup_decisions(docs, id_col, text_col, keep, fan_in).filter("kept").select(key("doc_id").alias(named), F.col("digest").alias(digest)).distinct()
    keyed = docs.withColumns({named: key(id_col), digest: F.unhex(F.sha2(text_of(text_col), 256)), nth: row_hash(docs)})
    joined = keyed.join(stay.hint("merge"), [named, digest], "left_semi")
    first = F.row_number().over(W.partitionBy(named, digest).orderBy(nth))
    return joined.withColumn(nth, first).filter(F.col(nth) == 1).select(*[f"`{c}`" for c in docs.columns])

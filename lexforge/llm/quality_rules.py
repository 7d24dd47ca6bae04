"""Quality rules: one projection compiled from a table of thresholds.

``measures`` gives exact per-document measures (length, symbols, stop words,
lines, repeated word windows) as Spark expressions; ``compile_rules`` turns a
threshold table into one boolean expression per rule and their conjunction. No
user function and no shuffle: a document is judged by itself, in one projection.

Repeated windows are found by sorting the window hashes of the text, so a long
text costs n log n, never n squared.

Defined results: a null text has no word and fails the length rule; a text
without words has ratio 0 for every ratio; empty table gives empty result; other
columns of the input are left alone (``measures`` selects only id and text).
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of, word_array

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be this an a "
    "der die das und den von zu mit sich ist des im nicht ein eine auf für "
    "le la les de des et en un une du que est pour dans qui pas par sur avec "
    "el los las y del se por con no su para es lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must be within [low, high]; either bound may be None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# Base rules come first; the rest is the method's own verdict.
BASE_RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("few_repeats", "repeat_percent", high=50),
)
METHOD_RULES = (
    Rule("mean_word_length", "mean_word_chars", low=2, high=16),
    Rule("symbols_per_word", "symbol_ratio", high=0.2),
    Rule("stop_word_share", "stop_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("shouting", "upper_ratio", high=0.6),
)


def _stripped_length(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """doc_id and exact counts and ratios of its whole text."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    split = base.select("doc_id", "t", word_array(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    gram = lambda w, i: F.struct(F.xxhash64(w, *[F.get("w", i + k) for k in range(1, window)]).alias("h"), i.alias("i"))
    grams = F.when(n >= window, F.sort_array(F.slice(F.transform("w", gram), 1, n - (window - 1)))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    sized = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        (F.length("t") - _stripped_length(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        _stripped_length(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        grams.alias("g"),
    )
    same = lambda x, i: x["h"].eqNullSafe(F.get("g", i - 1)["h"]) | x["h"].eqNullSafe(F.get("g", i + 1)["h"])
    starts = sized.withColumn("p", F.sort_array(F.transform(F.filter("g", lambda x, i: same(x, i)), lambda x: x["i"]))).drop("g")
    # Windows cover at most `window` words each, less where the next repeated window begins earlier.
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")),
    )["n"]
    out = starts.withColumn("n_repeat_words", covered).drop("p")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "repeat_percent": 100 * ratio("n_repeat_words", "n_words"),
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "stop_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "upper_ratio": ratio("n_upper", "n_letters"),
        }
    )


def compile_rules(rules) -> Column:
    """True where every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            verdict = verdict & (F.col(r.measure) <= F.lit(r.high))
    return verdict


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base_rules=BASE_RULES, rules=METHOD_RULES) -> DataFrame:
    """measures plus base_failed, one column per rule and the verdict ``kept``."""
    m = measures(docs, id_col, text_col)
    # In exact numbers, so that the boundary case is exact; a limit may have decimals.
    base_failed = ~compile_rules([r for r in base_rules if r.measure != "repeat_percent"])
    for r in base_rules:
        if r.measure == "repeat_percent":
            base_failed = base_failed | (100 * F.col("n_repeat_words") > F.lit(Decimal(str(r.high))) * F.col("n_words"))
    return m.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))

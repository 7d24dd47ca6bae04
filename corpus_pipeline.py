"""A training-corpus pipeline of five of the operators, over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a
stage keeps to the shared folder and hands the next one the stored table. Columns that
a stage does not read are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import exact_dedup, mixture, near_dedup, packing, toxicity
from lexforge.llm.common import materialize
from lexforge.llm.queries import table, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts get the score of the bias alone; without labels of both kinds
    all or none go; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every distinct text, that with the largest id.

    Null counts as empty text; null ids stay only where a text has no other; an empty
    table stays empty.
    """
    return exact_dedup.exact_dedup(docs, keep="largest")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates, that with the smallest id.

    Null and wordless texts are one class; null ids are documents like others, and stay
    only where a class has no other; an empty table stays empty.
    """
    return near_dedup.near_dedup(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice.

    Texts without words are never taken; a null source is a source of its own, the last
    in order; an empty table stays empty.
    """
    return mixture.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences.

    Each row is packed, also one that the mix repeats; an empty text is its end id; an
    empty table gives no piece.
    """
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: Training and the budget fitting are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

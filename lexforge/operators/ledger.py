"""Model calls that are asked once: results kept under the hash of model and prompt.

A ledger is a table (key, value, error) at a path, only ever added to. Prompts that it
has an answer for are not asked again, equal prompts of one run are asked once, and a
run goes in waves: the results of a wave are written before the next is asked, so what
a lost job must ask again is one wave at most. Prompts that failed stay open: they are
asked again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import stored
from .dense import map_model


def prompt_key(prompt: Column, model: str) -> Column:
    """Key of a prompt to a model; a null prompt has none and is not asked."""
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}"), prompt), 256)


def read_ledger(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """(key, value, error); empty where nothing was asked yet."""
    schema = f"key string, value {value_type}, error string"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def ask(df: DataFrame, prompt: Column, model: str, make: Callable[[], Callable[[pd.DataFrame], list]], path: str, out_col: str, out_type: str, error_col: str = "error", waves: int = 1) -> DataFrame:
    """df with the model's value for each row's prompt and, where it failed, the error.

    make() gives a model from prompts (a column ``prompt``) to values; ``model`` names it
    with all that its answers depend on. Prompts are joined back by key, so rows that
    share one are as many as they were.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__key", prompt_key(prompt, model))
    asked = keyed.select(F.col("__key").alias("key"), prompt.alias("prompt")).filter("key is not null").groupBy("key").agg(F.first("prompt").alias("prompt"))
    known = read_ledger(spark, path, out_type).filter("error is null").select("key")
    todo = stored(asked.join(known, "key", "left_anti"), "prompts")
    for wave in range(waves):
        part = todo.filter(F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(waves)) == wave)
        said = map_model(part, make, "value", out_type)
        said.select("key", "value", "error").write.mode("append").parquet(path)
    # A prompt may have failed before it was answered: an answer comes first.
    last = read_ledger(spark, path, out_type).groupBy("key").agg(F.max_by(F.struct("value", "error"), F.col("error").isNull()).alias("r"))
    found = last.select(F.col("key").alias("__key"), F.col("r.value").alias(out_col), F.col("r.error").alias(error_col))
    return keyed.join(found, "__key", "left").drop("__key")

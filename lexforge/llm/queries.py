"""The registered queries of the training-data operators.

Each query reads whole tables, calls one operator with production parameters and
derives the columns of its contract from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_in_middle, importance, mixture, near_dedup, packing, quality_rules, secrets, substring_dedup, tokens, toxicity, url_filters, warc
from .common import keep_until_release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer of the contracts; only its path is used."""
    return public_tokenizers.path("word_bpe_49k.json")


# ---- op1: best-fit packing --------------------------------------------------------------


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


# ---- op2: URL filters -------------------------------------------------------------------

#: Dated list entries made from the hosts that occur: which hosts are listed, and when,
#: follows from the smallest page id of a host.
LIST_ENTRIES = """
SELECT 'ads' AS list_name, domain, '/' AS prefix, date_add(DATE'2024-01-01', CAST(k % 200 AS INT)) AS at, 'add' AS action FROM hosts WHERE k % 3 = 0
UNION ALL
SELECT 'ads', domain, '/', date_add(DATE'2024-01-01', CAST(k % 200 + 60 AS INT)), 'remove' FROM hosts WHERE k % 3 = 0
UNION ALL
SELECT 'ads', domain, '/', date_add(DATE'2024-01-01', CAST(k % 200 + 120 AS INT)), 'add' FROM hosts WHERE k % 6 = 0
UNION ALL
SELECT 'spam', domain, '/en', date_add(DATE'2024-01-01', CAST(k % 100 AS INT)), 'add' FROM hosts WHERE k % 3 = 1
"""


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")))
    hosts = pages.groupBy(url_filters.url_host(F.col("url")).alias("domain")).agg(F.min("page_id").alias("k")).filter("domain is not null")
    entries = spark.sql(LIST_ENTRIES.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)
    return url_filters.judge_captures(captures, entries).withColumn("fetched_at", F.col("fetched_at").cast("string"))


# ---- op3: toxicity ----------------------------------------------------------------------


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


# ---- op4: exact dedup -------------------------------------------------------------------


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = exact_dedup.dedup_decisions(table(spark, sf_dir, "documents"), keep="largest")
    return decisions.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


# ---- op5: MinHash near-dedup ------------------------------------------------------------


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), least=0.8, bands=24, picks=4, k=5)
    return found.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


# ---- op6: quality rules -----------------------------------------------------------------


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ---- op7: token counts ------------------------------------------------------------------


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokens.token_lengths(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.length_report(tokens.length_histogram(lengths))


# ---- op8: mixing sources ----------------------------------------------------------------


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixture.mixture_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


# ---- op9: substring dedup ---------------------------------------------------------------


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=20, with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


# ---- op10: secret scans -----------------------------------------------------------------


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _, findings = secrets.scan_versions(table(spark, sf_dir, "documents"))
    found = secrets.findings_by_path(paths, findings)
    mark = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind_order"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind_order"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, mark), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", mark), ",").alias("spans"),
    )


# ---- op11: fill-in-middle transformation -------------------------------------------------


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


# ---- op12: target-distribution importance resampling ------------------------------------


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, buckets=10_000, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# ---- op13: WARC -------------------------------------------------------------------------


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = keep_until_release(warc.archive_path(spark))
    warc.write_archive(table(spark, sf_dir, "pages"), path, least=100)
    read = warc.read_archive(spark, path, least=100)
    return read.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {
    "op1_pack_sequences": op1_pack_sequences,
    "op2_url_filters": op2_url_filters,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_mix_sources": op8_mix_sources,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_warc": op13_warc,
}

"""Secret scanning with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The
ledger says which (blob, rule version) pairs were scanned and what was found. A
scan takes one copy of each blob that has an unseen pair, evaluates only the unseen
rules on it, and the findings are joined back to every path that has the blob.

Matching is built-in Spark: the pieces between matches (``split``) and the matches
(``regexp_extract_all``) of the same pattern alternate, so their lengths add up to
exact code-point positions of leftmost non-overlapping matches.

Only digests, ids and the text of one copy per blob are shuffled; a blob that a
third of all rows share is scanned once and joined back over salted keys.

Defined results: null text counts as empty; empty text has no finding; rows equal
in id and text are scanned once and each gets the findings; a null id is a path
like any other; an empty table gives empty results; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, materialize, text_of


@dataclass(frozen=True)
class SecretRule:
    """A pattern; ``value_group`` must have at least ``min_value`` characters, else the match is dropped."""

    kind: str
    version: int
    pattern: str
    value_group: int = 0
    min_value: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds in their order. For access and hex the least length is
# inside the pattern, which finds the same matches, as both are whole runs.
BASE = (
    SecretRule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    SecretRule("hex", 1, r"[0-9a-f]{32,}"),
)
# The method's own kinds, after the base ones.
EXTRA = (
    SecretRule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA


def _hits(text: Column, rule: SecretRule) -> Column:
    """Array of (gap, len, val): code points before a match since the last one, in it, and in its value; a last entry has no match."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    gap = lengths(F.split(text, rule.pattern))
    found = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    value = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group))) if rule.value_group else found
    return F.arrays_zip(gap.alias("gap"), found.alias("len"), value.alias("val"))


def path_blobs(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob): the content address of every version."""
    return versions.select(F.col(id_col).alias("doc_id"), F.sha2(text_of(text_col), 256).alias("blob"))


def unseen_pairs(paths: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, doc_id of one copy, todo array<string>) for blobs with a pair that the ledger lacks.

    ledger: (blob, rule) with one row per scanned pair, or None.
    """
    every = F.array(*[F.lit(r.key) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "doc_id", todo.alias("todo")).filter(F.size("todo") > 0)


def scan_blobs(versions: DataFrame, todo: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(blob, rule, kind, kind_order, start, end) of all findings of the unseen pairs."""
    # The join and the choice of one row use the same plain keys, so the texts are shuffled once.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    texts = versions.select(key(id_col).alias("__id"), text_of(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    one = texts.join(todo.select("blob", "todo", key("doc_id").alias("__id")), ["__id", "blob"])
    one = one.withColumn("__nth", F.row_number().over(W.partitionBy("__id", "blob").orderBy("__id"))).filter("__nth = 1")
    per_rule = [
        F.struct(
            F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(k).alias("kind_order"), F.lit(r.min_value).alias("least"),
            F.when(F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern), _hits(F.col("text"), r)).alias("hits"),
        )
        for k, r in enumerate(rules)
    ]
    with_hits = one.select("blob", F.explode(F.array(*per_rule)).alias("r")).filter("r.hits is not null")
    rows = with_hits.select("blob", "r.rule", "r.kind", "r.kind_order", "r.least", F.posexplode("r.hits").alias("i", "h"))
    upto = W.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("h.gap") + F.coalesce("h.len", F.lit(0))).over(upto)
    placed = rows.select("blob", "rule", "kind", "kind_order", "least", "h.len", "h.val", end.alias("end"))
    return placed.filter("len is not null and val >= least").select(
        "blob", "rule", "kind", "kind_order", (F.col("end") - F.col("len")).alias("start"), "end"
    )


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES):
    """Bring the ledger up to date with ``versions``.

    ledger: (blob, rule) scanned so far; known: findings so far. Returns
    (paths, ledger, findings): (doc_id, blob) of every version, all scanned pairs
    and the findings of the rules in force, new ones included. Findings of a version
    of a rule that is no longer in force are left out; their pairs stay in the ledger.
    """
    paths = materialize(path_blobs(versions, id_col, text_col), "paths")
    todo = materialize(unseen_pairs(paths, ledger, rules), "unseen")
    found = materialize(scan_blobs(versions, todo, id_col, text_col, rules), "findings")
    scanned = todo.select("blob", F.explode("todo").alias("rule"))
    return paths, scanned if ledger is None else ledger.unionByName(scanned), found if known is None else in_force(known, rules).unionByName(found)


def in_force(findings: DataFrame, rules=RULES) -> DataFrame:
    """Findings of the given versions of the rules, with the kinds' present order."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    return findings.filter(F.col("rule").isin([r.key for r in rules])).withColumn("kind_order", order[F.col("rule")])


def scan_into(versions: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Scan what the ledger stored at ``path`` lacks, add it there, and return every path of ``versions`` with its findings.

    Findings are added before their pairs: a scan that breaks off in between is done
    again, and what it finds twice is read once.
    """
    spark = versions.sparkSession
    pairs_schema, found_schema = "blob string, rule string", "blob string, rule string, kind string, kind_order int, start bigint, end bigint"
    for name, schema in (("findings", found_schema), ("ledger", pairs_schema)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")
    ledger = spark.read.schema(pairs_schema).parquet(f"{path}/ledger").distinct()
    paths = materialize(path_blobs(versions, id_col, text_col), "paths")
    todo = materialize(unseen_pairs(paths, ledger, rules), "unseen")
    scan_blobs(versions, todo, id_col, text_col, rules).write.mode("append").parquet(f"{path}/findings")
    todo.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{path}/ledger")
    return findings_by_path(paths, spark.read.schema(found_schema).parquet(f"{path}/findings").distinct(), rules)


def findings_by_path(paths: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, blob, found): every path with the findings of its blob by the rules in force, an array in order of start, then kind."""
    per_blob = in_force(findings, rules).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind_order", "end", "kind"))).alias("found"))
    joined = lookup(paths, per_blob, ["blob"], ["doc_id"])
    empty = F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>")
    return joined.withColumn("found", F.coalesce("found", empty))
